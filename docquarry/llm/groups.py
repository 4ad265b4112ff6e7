"""Arrow batches of a sorted partition, cut at the borders of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Yield (table, borders) so that each group of equal ``key`` lies in one table.

    The rows must come sorted by ``key`` (a long without nulls). ``borders`` has the first row of each
    group and the number of rows. Memory: a batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and keys[0] != last:
            yield _cut(held, key)
            held = []
        first = int(np.searchsorted(keys, keys[-1]))  # where the batch's last group begins
        if first and (held or first):
            yield _cut([*held, batch.slice(0, first)], key)
            held = []
        held.append(batch.slice(first))
        last = keys[-1]
    if held:
        yield _cut(held, key)


def _cut(held: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    keys = table.column(key).to_numpy()
    borders = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    return table, borders


def binary_matrix(column: pa.ChunkedArray, dtype: str, width: int) -> np.ndarray:
    """A column of binaries of equal length as a matrix."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(chunk, pa.ChunkedArray):
        chunk = pa.concat_arrays(chunk.chunks) if chunk.num_chunks else pa.array([], chunk.type)
    size = np.dtype(dtype).itemsize * width
    offset_type = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
    offsets = np.frombuffer(chunk.buffers()[1], offset_type)[chunk.offset : chunk.offset + len(chunk) + 1]
    if len(chunk) == 0:
        return np.zeros((0, width), dtype)
    data = np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    assert len(data) == size * len(chunk), "binaries of another length"
    return data.view(dtype).reshape(len(chunk), width) if data.flags.aligned else np.frombuffer(data.tobytes(), dtype).reshape(len(chunk), width)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    octets = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return octets[offsets[0] : offsets[-1]], offsets - offsets[0]
