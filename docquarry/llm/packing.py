"""Best-fit packing of tokenised documents into sequences of fixed length.

Best-fit over run-length encoded sizes, in place of distributed bulk-synchronous sweeps (README gives figures of both):
documents and gaps are sorted by size, each size class of documents is matched with the smallest gaps that hold it, ranks say
which document takes which gap, the gaps shrink, and the next class follows. Sizes are whole numbers up to the sequence length, so the sorted documents and gaps are kept
run-length encoded: a run is a size and an interval of ranks. The sweep's state is thus bounded by the
sequence length, however many documents there are; documents learn their run and place in one pass.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.groups import text_buffers, whole_groups
from docquarry.llm.ranks import rank_within
from docquarry.llm.tables import Scratch, short_batches

#: Words whose ids a worker remembers, in each of two generations.
_REMEMBERED = 500_000
#: Of an octet: 1 a small letter, 2 a full stop or comma, 3 ASCII white space.
_KINDS = np.zeros(256, np.uint8)
_KINDS[97:123], _KINDS[[44, 46]], _KINDS[[32, *range(9, 14)]] = 1, 2, 3


def _plain_words(texts: pa.Array) -> pa.Array:
    """``texts`` with ASCII capitals lower-cased and a space before a full stop or comma that ends a word after a letter.

    Neither changes the ids, and both leave fewer distinct words. Texts that may hold special tokens stay as they are.
    """
    texts = texts.fill_null("")
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    octets, offsets = text_buffers(texts)
    if not len(octets):
        return texts
    kind = _KINDS[octets]
    ends = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
    after = np.minimum(ends + 1, len(octets) - 1)
    begins = offsets[np.searchsorted(offsets, ends, "right") - 1]  # of the text that the mark is in
    last = np.isin(ends + 1, offsets)
    at = ends[(last | (kind[after] == 3)) & (begins < ends)]
    spaced = np.insert(octets, at, 32)
    moved = (offsets + np.searchsorted(at, offsets)).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(moved), pa.py_buffer(spaced))


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins words across white space.

    A text's ids are those of its words in turn, so repeated words are encoded once. Holds for tokenizers
    that drop white space and lower the case (checked on load).
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        whole = "Ab cd. \x01 ef,\n\n 'x\tg"
        parts = [t for w in ("ab", "cd", ".", "\x01", "ef", ",", "'x", "g") for t in self.tokenizer.encode(w, add_special_tokens=False).ids]
        if self.tokenizer.encode(whole, add_special_tokens=False).ids != parts:
            raise ValueError("this tokenizer heeds white space or case; words can't be encoded one by one")
        (self.mark,) = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.read = 0  # words of this task
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def rest(self) -> None:
        """After a task: memory for many more words than a task reads does not pay, and idle workers would hold it."""
        if len(self.new) + len(self.old) > 8 * self.read:
            self.new, self.old = {}, {}
        self.read = 0

    def _encode_words(self, words: list[bytes]) -> None:
        """Many words in one call, parted by a mark that stands between white space and so is a token of its own."""
        new = self.new
        for at in range(0, len(words), 2_000):
            part = words[at : at + 2_000]
            text = b" \x01 ".join(part)
            marks = []
            if text.count(b"\x01") == len(part) - 1:
                octets = self._ids(text)
                marks = (4 * np.flatnonzero(octets == self.mark)).tolist()
                octets = octets.tobytes()
            if len(marks) == len(part) - 1:
                for word, low, high in zip(part, [0, *(m + 4 for m in marks)], [*marks, len(octets)]):
                    new[word] = octets[low:high]
            else:  # a word holds the mark
                for word in part:
                    new[word] = self._ids(word).tobytes()

    def _ids(self, text: bytes) -> np.ndarray:
        """Ids of one text; the call that keeps no offsets."""
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, from memory or encoded now."""
        if len(self.new) > _REMEMBERED:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = [w for w in words if w not in new]
        new.update((w, old[w]) for w in missing if w in old)
        self._encode_words([w for w in missing if w not in new])
        return list(map(new.__getitem__, words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); nulls are empty.

        Arrow splits at ASCII white space and finds the distinct words, so Python sees each of those once a call.
        """
        split = pc.ascii_split_whitespace(_plain_words(texts))
        coded = split.flatten().dictionary_encode()
        self.read += len(coded)
        known = self._known(coded.dictionary.cast(pa.binary()).to_pylist())
        pool = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - n), n)
        place += np.arange(len(place))
        words = np.cumsum(np.r_[0, pc.list_value_length(split).to_numpy(zero_copy_only=False)])
        return pool[place], np.diff(np.r_[0, ends][words])


_loaded: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, sequence_length: int, end_id: int = 0, ids: bool = False, id_col: str = "doc_id", text_col: str = "text", place: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids][, place]): each text's ids and ``end_id``, cut at ``sequence_length``.

    ``ids`` adds the ids themselves as array<int>, ``place`` a long of each document. Null texts are empty, which gives one
    piece of length 1.
    """
    short_batches(docs.sparkSession)
    with_place = place is not None
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids + ", place long" * with_place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer_path)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found, counts = encoder.encode(part.column(1))
                    stops = np.cumsum(counts + 1)
                    octets = np.insert(found, np.cumsum(counts), end_id).astype("<u4", copy=False)
                    pieces = -(-(counts + 1) // sequence_length)
                    doc = np.repeat(np.arange(len(counts)), pieces)
                    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    start = piece * sequence_length
                    length = np.minimum(sequence_length, (counts + 1)[doc] - start)
                    low = (stops - counts - 1)[doc] + start
                    view = memoryview(octets).cast("B")
                    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + length).tolist())]
                    columns = [part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, low + length].astype(np.int32)), pa.array(octets.astype(np.int32))))
                        names.append("ids")
                    if with_place:
                        columns.append(part.column(2).take(pa.array(doc)))
                        names.append("place")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            encoder.rest()

    placed = [] if place is None else [place.cast("long").alias("place")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *placed).mapInArrow(run, schema)


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, documents a sequence, offset) for counts of documents by length.

    From the longest class down, documents fill the smallest gaps that hold one, as many as go into
    each, then open new sequences. Within a run documents take sequences in the order of their ranks.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sizes in ascending order
    stock: dict[int, deque[tuple[int, int]]] = {}  # size of gap: (first sequence, sequences)
    opened = 0

    def put(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in stock:
                stock[size] = deque()
                bisect.insort(gaps, size)
            stock[size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        if not 0 < length <= capacity:
            raise ValueError(f"no sequence holds {length} tokens")
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                size = gaps[at]
                first, n = stock[size].popleft()
                if not stock[size]:
                    del stock[size], gaps[at]
            else:
                size, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = size // length
            full = min(n, left // each)
            offset = capacity - size
            if full:
                runs.append((length, rank, first, each, offset))
                rank, left = rank + full * each, left - full * each
                put(size - each * length, first, full)
            if full < n and left and left < each:
                runs.append((length, rank, first + full, each, offset))
                put(size - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(size, first + full, n - full)
    return runs


def _look_up(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of documents by length and rank, from sorted runs."""
    starts = table[:, 0] << 46 | table[:, 1]
    own = table[np.searchsorted(starts, length << 46 | rank, "right") - 1] if len(length) else table[:0]
    ahead = rank - own[:, 1]
    return own[:, 2] + ahead // own[:, 3], own[:, 4] + ahead % own[:, 3] * length


def assign_sequences(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (doc_id, piece, length, ...).

    Collected are counts by length (at most ``capacity`` rows) only.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(best_fit_runs(counts, capacity))
    table = np.array(runs, np.int64).reshape(-1, 5)
    ranked = rank_within(pieces, "length", F.struct("doc_id", "piece"), [F.col("doc_id"), F.col("piece")], sum(counts.values()))
    names = [*pieces.columns, "sequence_id", "offset"]
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = _look_up(table, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), pa.array(sequence), pa.array(offset)], names=names)

    return ranked.select(*pieces.columns, "rank").mapInArrow(run, schema)


def assign_in_windows(pieces: DataFrame, capacity: int, window_docs: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with ``place``, the document's number in an order that is to be kept.

    Each ``window_docs`` consecutive documents are packed by best fit among themselves, and their sequences are numbered
    after those of the windows before. A task sees one window at a time.
    """
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = pieces.withColumn("window", F.floor(F.col("place") / window_docs).cast("long"))
    rows = own.repartition(parts, "window").sortWithinPartitions("window", "length", "place", "piece")
    names = [c for c in pieces.columns if c != "place"]
    schema = T.StructType([*(f for f in pieces.schema.fields if f.name != "place"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in whole_groups(batches, "window"):
            for low, high in zip(borders[:-1].tolist(), borders[1:].tolist()):
                part = table.slice(low, high - low).combine_chunks()
                length = part.column("length").to_numpy()
                lengths, first, counts = np.unique(length, return_index=True, return_counts=True)
                runs = np.array(sorted(best_fit_runs(dict(zip(lengths.tolist(), counts.tolist())), capacity)), np.int64).reshape(-1, 5)
                sequence, offset = _look_up(runs, length, np.arange(len(length)) - np.repeat(first, counts))
                sequence += part.column("window")[0].as_py() << 32
                yield from pa.table([*(part.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]).to_batches()

    return rows.mapInArrow(run, schema)


def stored_places(docs: DataFrame) -> Column:
    """Where a row stands in its table: number of the file and row in the file for Parquet tables, else Spark's row id."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        row = F.monotonically_increasing_id()  # its upper 31 bits are the partition
        return F.shiftleft(F.shiftright(row, 33), 36) + row.bitwiseAND(F.lit((1 << 33) - 1))
    part = lambda pattern: F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long"), F.lit(0))
    return F.shiftleft(part(r"^part-(\d+)"), 42) + F.shiftleft(part(r"-c(\d+)"), 36) + F.col("_metadata.row_index")


def _numbered(pieces: DataFrame) -> DataFrame:
    """``place`` as numbers from 0: each file's documents follow those of the files before. One row a file meets in one task."""
    file = F.shiftright("place", 36)
    files = pieces.where("piece = 0").groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    starts = files.select(F.col("file").alias("file2"), "least", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return pieces.join(starts, file == F.col("file2")).withColumn("place", F.col("place") - F.col("least") + F.col("before")).select(*pieces.columns)


def pack_in_order(docs: DataFrame, tokenizer_path: str, sequence_length: int = 2048, end_id: int = 0, ids: bool = False, window_docs: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``pack``, but keeps the order in which ``docs`` is stored: by windows of ``window_docs`` documents.

    sequence_id rises with the order of the windows, so a mix that the rows' order holds is still there in the sequences,
    window by window. It opens at most one sequence a window more than a best fit over all would.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(token_pieces(docs, tokenizer_path, sequence_length, end_id, ids, id_col, text_col, stored_places(docs)), "pieces")
    return assign_in_windows(_numbered(pieces), sequence_length, window_docs)


def pack(docs: DataFrame, tokenizer_path: str, sequence_length: int = 2048, end_id: int = 0, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``docs`` with their sequence and place in it: the columns of ``token_pieces``, sequence_id, offset.

    Every document comes back whole: only those above ``sequence_length`` tokens are cut. Sequences are gapless
    from offset 0. Null and empty texts are one end token. Repeated rows are packed as often as they occur; null
    ids come back null. An empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(token_pieces(docs, tokenizer_path, sequence_length, end_id, ids, id_col, text_col), "pieces")
    return assign_sequences(pieces, sequence_length, scratch)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the training sequences themselves, from ``pack`` with ``ids``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
