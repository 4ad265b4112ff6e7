"""Frequent lines removed by probing a sharded minimal perfect hash.

Blocks of documents keep a dictionary of their distinct line keys. The hashes of all blocks meet by shard; each shard becomes
an index: a minimal perfect hash, and by its numbers an array of fingerprints and one of document counts. Blocks then
send their distinct hashes to the shards as packed arrays, which probe the index, and get back which of them are frequent. No line
is a row of any shuffle: a line that a third of all documents hold is one entry per block, as any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.perfect import PerfectHash, build
from docquarry.llm.tables import Scratch, short_batches


@dataclass(frozen=True)
class LineParameters:
    """Index size is bounded by ``shard_lines``, a block's dictionary by ``block_octets`` and the longest text."""

    least_documents: int = 10  # that hold a key which goes
    least_chars: int = 1  # code points of a key that may go
    block_octets: int = 16 << 20  # of texts that share a dictionary of lines; raise it with the memory of executors
    shard_lines: int = 2_000_000  # block entries of a shard of the index; raise it with the memory of executors


#: Stripped at both ends of a line.
_WHITE = " \t\n\x0b\x0c\r"


def line_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(borders of each text's lines, the number of each line's key, distinct keys) of texts without nulls."""
    lists = pc.split_pattern(texts, "\n")
    borders = lists.offsets.to_numpy().astype(np.int64)
    keys = pc.ascii_lower(pc.ascii_trim(lists.flatten(), characters=_WHITE)).dictionary_encode()
    return borders - borders[0], keys.indices.to_numpy().astype(np.int64), keys.dictionary


def key_hashes(keys: list[str]) -> np.ndarray:
    """128 bits of BLAKE2b for each key, as two columns."""
    octets = b"".join([hashlib.blake2b(k.encode(), digest_size=16).digest() for k in keys])
    return np.frombuffer(octets, "<u8").reshape(-1, 2)


_BLOCK_SCHEMA = "block long, doc_id long, text string, ordinals binary, n long, hashes binary, counts binary, own binary"
_BLOCK_TYPES = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("ordinals", pa.binary()), ("n", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("own", pa.binary())])


def _blocks(docs: DataFrame, p: LineParameters) -> DataFrame:
    """Rows of two kinds: documents with the numbers of their lines in the block's dictionary (n null), and a row per block
    with its dictionary: hashes sorted, documents of the block that hold each key, and each key's number."""

    def block(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        texts = pa.concat_arrays(table.column("text").chunks) if table.column("text").num_chunks != 1 else table.column("text").chunk(0)
        borders, ordinals, keys = line_keys(texts)
        lines = np.diff(borders)
        owner = np.repeat(np.arange(len(lines)), lines)
        once = np.unique(owner * len(keys) + ordinals)
        counts = np.bincount(once % len(keys), minlength=len(keys)).astype("<u4")
        fit = np.flatnonzero(pc.utf8_length(keys).to_numpy() >= p.least_chars)
        hashes = key_hashes(keys.take(pa.array(fit)).to_pylist())
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        fit = fit[order]
        packed = ordinals.astype("<u4")
        for at in range(0, len(lines), 1024):
            to = min(at + 1024, len(lines))
            columns = [pa.array([number] * (to - at)), table.column("doc_id").slice(at, to - at).combine_chunks(), texts.slice(at, to - at), pa.array([packed[borders[k] : borders[k + 1]].tobytes() for k in range(at, to)], pa.binary())]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(to - at, t) for t in _BLOCK_TYPES.types[4:])], schema=_BLOCK_TYPES)
        row = [number, None, None, None, len(fit), hashes[order].tobytes(), counts[fit].tobytes(), fit.astype("<u4").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES.types)], schema=_BLOCK_TYPES)

    def run(batches):
        first, made, held, octets = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            octets += batch.column("text").nbytes
            if octets >= p.block_octets:
                yield from block(held, first + made)
                made, held, octets = made + 1, [], 0
        if held:
            yield from block(held, first + made)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, _BLOCK_SCHEMA)


def _sharded(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, block, hashes, counts, own): each block's dictionary, cut at the borders of the shards."""
    edges = np.array([-(-(k << 64) // shards) for k in range(1, shards)], np.uint64)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                hashes = np.frombuffer(batch.column("hashes")[k].as_buffer(), "<u8").reshape(-1, 2)
                counts, own = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u4") for c in ("counts", "own"))
                cuts = np.r_[0, np.searchsorted(hashes[:, 0], edges), len(hashes)]
                some = np.flatnonzero(np.diff(cuts))
                for at in range(0, len(some), 256):
                    part = some[at : at + 256]
                    ranges = list(zip(cuts[part].tolist(), cuts[part + 1].tolist()))
                    columns = [pa.array(part), pa.array([batch.column("block")[k].as_py()] * len(part)), *(pa.array([x[a:b].tobytes() for a, b in ranges], pa.binary()) for x in (hashes, counts, own))]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "hashes", "counts", "own"])

    rows = blocks.where("n is not null").select("block", "hashes", "counts", "own")
    return rows.mapInArrow(run, "shard long, block long, hashes binary, counts binary, own binary")


def _added(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the sums of their counts."""
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.lexsort((h[:, 1], h[:, 0]))
    h, c = h[order], c[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]).any(1)])
    return h[first], np.add.reduceat(c, first)


def _count_type(least: int) -> str:
    """The smallest counter that can hold the threshold; counts beyond it stay at its end."""
    return next(t for t in ("<u1", "<u2", "<u4") if least <= np.iinfo(t).max)


def index_lines(sharded: DataFrame, p: LineParameters) -> DataFrame:
    """(shard, sizes, bits, fingerprints, counts): a perfect hash of a shard's distinct hashes with two arrays by its numbers.

    A task adds up the dictionaries of a shard as they come; it holds the shard's distinct hashes and as many more.
    """
    kind = _count_type(p.least_documents)

    def entry(shard: int, hashes: list, counts: list) -> pa.RecordBatch:
        h, c = _added(hashes, counts)
        sizes, words = build(h[:, 0], h[:, 1])
        at = PerfectHash(sizes, words).numbers(h[:, 0], h[:, 1])
        prints, kept = np.zeros(len(h), "<u4"), np.zeros(len(h), kind)
        prints[at] = h[:, 1] >> np.uint64(32)
        kept[at] = np.minimum(c, np.iinfo(kind).max)
        columns = [pa.array([shard], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (sizes, words, prints, kept))]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "sizes", "bits", "fingerprints", "counts"])

    def run(batches):
        shard, hashes, counts, rows, distinct = None, [], [], 0, 0
        for batch in batches:
            ids = batch.column("shard").to_pylist()
            for k, own in enumerate(ids):
                if own != shard:
                    if hashes:
                        yield entry(shard, hashes, counts)
                    shard, hashes, counts, rows, distinct = own, [], [], 0, 0
                hashes.append(np.frombuffer(batch.column("hashes")[k].as_py(), "<u8").reshape(-1, 2))
                counts.append(np.frombuffer(batch.column("counts")[k].as_py(), "<u4").astype(np.int64))
                rows += len(counts[-1])
                if rows > 2 * distinct + 500_000:
                    h, c = _added(hashes, counts)
                    hashes, counts, rows, distinct = [h], [c], len(h), len(h)
        if hashes:
            yield entry(shard, hashes, counts)

    parts = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sharded.select("shard", "hashes", "counts").repartition(parts, "shard").sortWithinPartitions("shard")
    return rows.mapInArrow(run, "shard long, sizes binary, bits binary, fingerprints binary, counts binary")


def _frequent(index: DataFrame, sharded: DataFrame, p: LineParameters) -> DataFrame:
    """(block, ordinals): the numbers of a block's keys that the index counts in ``least_documents``.

    Each shard's index comes before the blocks that probe it, so a task holds one index and a batch of probes.
    """
    kind = _count_type(p.least_documents)
    nothing = F.lit(None).cast("binary")
    asked = sharded.select("shard", F.lit(1).alias("role"), "block", "hashes", "own", nothing.alias("sizes"), nothing.alias("bits"), nothing.alias("fingerprints"), nothing.alias("counts"))
    held = index.select("shard", F.lit(0).alias("role"), F.lit(None).cast("long").alias("block"), nothing.alias("hashes"), nothing.alias("own"), "sizes", "bits", "fingerprints", "counts")

    def run(batches):
        table = prints = counts = None
        for batch in batches:
            blocks, out = [], []
            for k, role in enumerate(batch.column("role").to_pylist()):
                if role == 0:
                    sizes, bits, prints, counts = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("sizes", "<i8"), ("bits", "<u8"), ("fingerprints", "<u4"), ("counts", kind)))
                    table = PerfectHash(sizes, bits)
                    continue
                hashes = np.frombuffer(batch.column("hashes")[k].as_buffer(), "<u8").reshape(-1, 2)
                at = table.numbers(hashes[:, 0], hashes[:, 1])
                known = (at >= 0) & (prints[at] == (hashes[:, 1] >> np.uint64(32)).astype(np.uint32))
                found = known & (counts[at] >= p.least_documents)
                if found.any():
                    blocks.append(batch.column("block")[k].as_py())
                    out.append(np.frombuffer(batch.column("own")[k].as_buffer(), "<u4")[found].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(out, pa.binary())], names=["block", "ordinals"])

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = held.unionByName(asked).repartition(parts, "shard").sortWithinPartitions("shard", "role", "block")
    return rows.mapInArrow(run, "block long, ordinals binary")


def _cleaned(blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """Documents without their frequent lines; those of a block follow its frequent numbers."""
    asked = frequent.select("block", F.lit(0).alias("role"), "ordinals", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    texts = blocks.where("n is null").select("block", F.lit(1).alias("role"), "ordinals", "doc_id", "text")

    def run(batches):
        at, gone = None, np.zeros(0, bool)  # of the block, which numbers are frequent
        for batch in batches:
            roles, owners, ordinals, texts = (batch.column(c) for c in ("role", "block", "ordinals", "text"))
            kept, lines, dropped, rows = [], [], [], []
            for k, (role, owner) in enumerate(zip(roles.to_pylist(), owners.to_pylist())):
                own = np.frombuffer(ordinals[k].as_buffer(), "<u4")
                if owner != at:
                    at, gone = owner, np.zeros(0, bool)
                if role == 0:
                    if len(own) and own.max() >= len(gone):
                        gone = np.r_[gone, np.zeros(int(own.max()) + 1 - len(gone), bool)]
                    gone[own] = True
                    continue
                text = texts[k].as_py()
                out = gone[np.minimum(own, len(gone) - 1)] & (own < len(gone)) if len(gone) else np.zeros(len(own), bool)
                n = int(out.sum())
                if n:
                    parts = text.split("\n")
                    text = "\n".join([parts[j] for j in np.flatnonzero(~out).tolist()])
                kept.append(text)
                lines.append(len(own))
                dropped.append(n)
                rows.append(k)
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = asked.unionByName(texts).repartition(parts, "block").sortWithinPartitions("block", "role")
    return rows.mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long")


def drop_frequent_lines(docs: DataFrame, p: LineParameters = LineParameters()) -> DataFrame:
    r"""(doc_id, text, n_lines, n_dropped) for every row of ``docs`` (doc_id, text): the text without its frequent lines.

    A text is split at \n; a line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at
    least ``least_chars`` code points that ``least_documents`` rows hold lose all their lines; the others stay, joined by \n.
    Keys are told apart by 128 bits of BLAKE2b. All keys are in the index, so no probe meets a stranger's entry.

    A null or empty text is one empty line. Every row is a document, also with a repeated or null doc_id, and comes back.
    Lines and texts may be of any length that a row can have. An empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "lines")
    blocks = scratch.save(_blocks(docs, p), "blocks")
    entries = blocks.where("n is not null").agg(F.sum("n")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // p.shard_lines))
    sharded = _sharded(blocks, shards)
    index = scratch.save(index_lines(sharded, p), "index")
    frequent = scratch.save(_frequent(index, sharded, p), "frequent")
    scratch.drop("index")
    return _cleaned(blocks, frequent)
