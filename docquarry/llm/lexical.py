"""Ranked lexical search by Block-Max WAND over an inverted index in shards of documents.

A shard holds some documents, numbered by doc_id, and for each term its postings in blocks of fixed size: gaps and frequencies packed in 1, 2
or 4 octets each, beside them the last document and the greatest impact of every block. A search moves shallow pointers over these two
arrays only; blocks whose impacts can't sum above the k-th best score so far are passed without being decompressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.groups import text_buffers
from docquarry.llm.tables import Scratch, short_batches


@dataclass(frozen=True)
class LexicalParameters:
    """A shard's texts have ``shard_octets`` or are one longer text; raise it with the memory of executors."""

    top: int = 20
    block: int = 128  # postings
    shard_octets: int = 8 << 20
    queries_together: int = 256  # that search a shard in one task
    small_terms: int = 200_000  # so many terms of queries, and no more, are broadcast to the index's rows


_TERM = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all terms of the texts in a row, terms of each text): runs of ASCII letters and digits and of other code points."""
    octets, offsets = text_buffers(texts)
    solid = _TERM[octets]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(octets))]
    begins[edges] = solid[edges]
    ends[edges - 1] = solid[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=bounds[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(_LOWER[octets[solid]].tobytes()))
    return words, np.diff(np.searchsorted(starts, offsets))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""

    def run(batches):
        for batch in batches:
            counts = terms_of(batch.column("text"))[1]
            yield pa.RecordBatch.from_arrays([pa.array([int((counts > 0).sum())]), pa.array([int(counts.sum())])], names=["n", "l"])

    n, terms = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return n or 0, terms or 0


_WIDTHS = ((1, "<u1"), (2, "<u2"), (4, "<u4"))


def _widths(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Octets that hold each block's values."""
    most = np.maximum.reduceat(values, starts)
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.uint8)


def pack_postings(owner: np.ndarray, docs: np.ndarray, tf: np.ndarray, most: np.ndarray, size: int) -> Iterator[tuple]:
    """For each term (``owner``, ascending; ``docs`` ascending in it): (term, df, last document of each block, its greatest
    impact, octets of its gaps and frequencies, packed blocks)."""
    firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    ends = np.r_[firsts[1:], len(owner)]
    blocks = -(-(ends - firsts) // size)
    upto = np.cumsum(blocks)
    within = np.arange(upto[-1]) - np.repeat(upto - blocks, blocks)
    starts = np.repeat(firsts, blocks) + size * within
    stops = np.minimum(starts + size, np.repeat(ends, blocks))
    gaps = np.diff(docs, prepend=0)
    gaps[firsts] = docs[firsts]
    last, best = docs[stops - 1].astype("<i4"), np.maximum.reduceat(most, starts).astype("<u4")
    widths = np.stack([_widths(gaps, starts), _widths(tf, starts)], 1)
    cast = {(k, w): values.astype(t) for k, values in enumerate((gaps, tf)) for w, t in _WIDTHS}
    packed = [cast[0, a][x:y].tobytes() + cast[1, b][x:y].tobytes() for (a, b), x, y in zip(widths.tolist(), starts.tolist(), stops.tolist())]
    at = 0
    for term, df, n in zip(owner[firsts].tolist(), (ends - firsts).tolist(), blocks.tolist()):
        s = slice(at, at + n)
        yield term, df, last[s].tobytes(), best[s].tobytes(), widths[s].tobytes(), b"".join(packed[s])
        at += n


class Postings:
    """A term's blocks in a shard; ``block`` decompresses one and keeps it."""

    def __init__(self, df: int, last: bytes, most: bytes, widths: bytes, data: bytes, size: int):
        self.last, self.most = np.frombuffer(last, "<i4").astype(np.int64), np.frombuffer(most, "<u4").astype(np.int64)
        self.widths, self.data = np.frombuffer(widths, np.uint8).reshape(-1, 2).astype(np.int64), data
        self.sizes = np.minimum(size, df - size * np.arange(len(self.last)))
        self.starts = np.r_[0, np.cumsum(self.sizes * self.widths.sum(1))]
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts)"""
        found = self.open.get(k)
        if found is None:
            n, (a, b), at = int(self.sizes[k]), self.widths[k].tolist(), int(self.starts[k])
            gaps = np.frombuffer(self.data, f"<u{a}", n, at).astype(np.int64)
            docs = np.cumsum(gaps) + (self.last[k - 1] if k else 0)
            found = self.open[k] = docs, impact(np.frombuffer(self.data, f"<u{b}", n, at + a * n).astype(np.int64), m[docs])
        return found


def block_max_wand(lists: list[tuple[Postings, int]], m: np.ndarray, top: int, together: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``top`` best above 0, best first, ties by number.

    Where any list's block ends, a stretch of documents ends: in it every list stands in one block, so the sum of the blocks' greatest
    impacts bounds its scores. A list of a single block is opened at once: its pointer knows its next document, so it counts only
    in stretches that hold one. The few stretches of the greatest bounds are scored first; their k-th best score is a threshold to start
    from. Then pointers go over stretches in the order of documents: the next pivots are the next stretches with bounds above the
    threshold, ``together`` at a time. Only their blocks are decompressed.
    """
    ends = np.unique(np.concatenate([p.last for p, _ in lists]))
    bound = np.zeros(len(ends), np.int64)
    places = []
    for p, weight in lists:
        at = np.searchsorted(p.last, ends)  # the shallow pointer of the list at each stretch
        places.append(at)
        if len(p.last) == 1:
            docs, impacts = p.block(0, m)
            most = np.zeros(len(ends), np.int64)
            np.maximum.at(most, np.searchsorted(ends, docs), impacts)
            bound += weight * most
            continue
        inside = at < len(p.last)
        bound[inside] += weight * p.most[at[inside]]
    stretch = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))  # of each document

    def scored(live: np.ndarray) -> np.ndarray:
        chosen = np.zeros(len(ends), bool)
        chosen[live] = True
        scores = np.zeros(len(stretch), np.int64)
        for (p, weight), at in zip(lists, places):
            blocks = at[live]
            for k in np.unique(blocks[blocks < len(p.last)]).tolist():
                docs, impacts = p.block(k, m)
                ok = chosen[stretch[docs]]
                scores[docs[ok]] += weight * impacts[ok]
        return scores

    first = scored(np.argsort(-bound, kind="stable")[:together])
    # equal scores are still wanted, as their documents may come earlier
    floor = max(0, int(np.partition(first, -top)[-top]) - 1) if len(first) >= top else 0
    best_docs, best, pointer = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while True:
        live = np.flatnonzero(bound[pointer:] > floor)[:together] + pointer
        if not len(live):
            return best_docs, best
        scores = scored(live)
        found = np.flatnonzero(scores > floor)
        best_docs, best = np.r_[best_docs, found], np.r_[best, scores[found]]
        order = np.lexsort((best_docs, -best))[:top]
        best_docs, best = best_docs[order], best[order]
        if len(best) == top:  # later documents need more
            floor = max(floor, int(best[-1]))
        pointer = int(live[-1]) + 1


_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("last", pa.binary()), ("most", pa.binary()), ("widths", pa.binary()), ("data", pa.binary())])
_INDEX_TYPES = "shard long, term string, df long, last binary, most binary, widths binary, data binary"


@dataclass(frozen=True)
class LexicalIndex:
    """``rows``: a row per shard and term, and one per shard with its documents (term null; data: ids, m; last: which ids are null)."""

    rows: DataFrame
    documents: int  # with a term
    terms: int  # of all documents


def build_index(docs: DataFrame, scratch: Scratch, p: LexicalParameters = LexicalParameters()) -> LexicalIndex:
    """Index of every row of ``docs`` (doc_id, text), written below the shared folder; a shard is built by one task from its own rows."""
    n, total = _statistics(docs)

    def shard(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending")])).combine_chunks()
        ids, texts = (pa.concat_arrays(table.column(c).chunks) for c in ("doc_id", "text"))
        words, counts = terms_of(texts)
        del table, texts
        m = 75 + (25 * counts * n) // max(total, 1)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        row = [number, None, len(counts), known.astype(np.uint8).tobytes(), None, None, ids.fill_null(0).to_numpy().astype("<i8").tobytes() + m.astype("<i8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _INDEX.types)], schema=_INDEX)
        if not len(words):
            return
        coded = words.dictionary_encode()
        keys = coded.indices.to_numpy().astype(np.int64) * len(counts)
        keys += np.repeat(np.arange(len(counts)), counts)
        names, rows = coded.dictionary, []
        del words, coded
        keys, tf = np.unique(keys, return_counts=True)
        owner, at = np.divmod(keys, len(counts))
        del keys
        for row in pack_postings(owner, at, tf, impact(tf, m[at]), p.block):
            rows.append(row)
            if len(rows) == 4096:
                yield out(number, names, rows)
                rows = []
        if rows:
            yield out(number, names, rows)

    def out(number: int, names: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        term, *rest = zip(*rows)
        columns = [pa.array([number] * len(rows), pa.int64()), names.take(pa.array(term)), *(pa.array(c, t) for c, t in zip(rest, _INDEX.types[2:]))]
        return pa.RecordBatch.from_arrays(columns, schema=_INDEX)

    def run(batches):
        first, made, held, octets = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            octets += batch.column("text").nbytes
            if octets >= p.shard_octets:
                yield from shard(held, first + made)
                made, held, octets = made + 1, [], 0
        if held:
            yield from shard(held, first + made)

    short_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return LexicalIndex(scratch.save(source.mapInArrow(run, _INDEX_TYPES), "index"), n, total)


def _asked(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, item_id, term, times): the terms of each row of ``items``; ``query`` numbers the rows."""

    def run(batches):
        for batch in batches:
            words, counts = terms_of(batch.column("text"))
            place = np.repeat(np.arange(batch.num_rows), counts)
            own = pa.table({"place": place, "term": words}).group_by(["place", "term"]).aggregate([([], "count_all")]).combine_chunks()
            rows = own.column("place")
            columns = [batch.column("query").take(rows.combine_chunks()), batch.column("item_id").take(rows.combine_chunks()), own.column("term").combine_chunks(), own.column("count_all").combine_chunks()]
            columns = [c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "query long, item_id long, term string, times long")


def _weight(n: int) -> Column:
    return F.floor(1000 * F.log((2 * F.lit(n).cast("double") + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")


def search(index: LexicalIndex, items: DataFrame, scratch: Scratch, p: LexicalParameters = LexicalParameters(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query, item_id, rank, doc_id, score): the ``top`` best documents of each row of ``items`` (``id_col``, ``text_col``).

    Shards are searched on their own, by blocks of queries; a query's best of all shards are ranked in the end. Terms reach the index's
    rows by a join, so nothing of a shard is read but its documents and the terms that are asked for.
    """
    spark = items.sparkSession
    asked = scratch.save(_asked(items, id_col, text_col), "asked")
    terms = scratch.save(asked.select(F.col("term").alias("_term")).distinct(), "terms")
    wanted = F.broadcast(terms) if terms.count() <= p.small_terms else terms
    hit = scratch.save(index.rows.join(wanted, F.col("term") == F.col("_term")).drop("_term"), "hit")
    weights = hit.groupBy("term").agg(F.sum("df").alias("df")).select(F.col("term").alias("_term"), _weight(index.documents).alias("w"))
    blocks = max(1, -(-asked.select("query").distinct().count() // p.queries_together))
    dealt = asked.join(weights, F.col("term") == F.col("_term")).where("w > 0").withColumn("together", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    uses = dealt.groupBy("term", "together").agg(F.collect_list(F.struct("query", "item_id", (F.col("w") * F.col("times")).alias("weight"))).alias("uses"))
    uses = scratch.save(uses.select(F.col("term").alias("_term"), "together", "uses"), "uses")
    postings = hit.join(uses, F.col("term") == F.col("_term")).drop("_term")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))
    shards = index.rows.where("term is null").withColumn("together", every).withColumn("uses", F.lit(None).cast(uses.schema["uses"].dataType))

    def run(table: pa.Table) -> pa.Table:
        names = ["query", "item_id", "doc_id", "score"]
        types = [pa.int64()] * 4
        queries: dict[int, list[tuple[Postings, int]]] = {}
        item, ids, known, m = {}, None, None, None
        for row in table.to_pylist():
            if row["term"] is None:
                both = np.frombuffer(row["data"], "<i8")
                ids, m, known = both[: len(both) // 2], both[len(both) // 2 :], np.frombuffer(row["last"], np.uint8)
                continue
            own = Postings(row["df"], row["last"], row["most"], row["widths"], row["data"], p.block)
            for use in row["uses"]:
                queries.setdefault(use["query"], []).append((own, use["weight"]))
                item[use["query"]] = use["item_id"]
        out = [[], [], [], []]
        for query, lists in sorted(queries.items()):
            docs, scores = block_max_wand(lists, m, p.top)
            out[0] += [query] * len(docs)
            out[1] += [item[query]] * len(docs)
            out[2] += [i if k else None for i, k in zip(ids[docs].tolist(), known[docs].tolist())]
            out[3] += scores.tolist()
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number, as few octets are much work here
    grouped = postings.unionByName(shards).repartition(parts, "shard", "together").groupBy("shard", "together").applyInArrow(run, "query long, item_id long, doc_id long, score long")
    best = scratch.save(grouped, "best")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.top).select("query", "item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, p: LexicalParameters = LexicalParameters()) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text) its ``top`` best rows of ``docs`` (doc_id, text).

    Terms are runs of ASCII letters and digits and of code points beyond ASCII, A-Z lower-cased, of whole texts. With N documents that
    have a term, L terms in all, n in a document and df documents with a term: w = floor(1000 ln((2N + 2) / (2df + 1))),
    m = 75 + 25nN div L, and the score sums w (10**9 tf div (1000tf + 12m)) over the item's terms, repeats included.

    Only scores above 0 are returned, equal ones by doc_id. Null and empty texts have no terms. Every row of ``docs`` is a document of its own,
    also with a repeated doc_id or a null one (which comes last among equals); every row of ``items`` is a query, so rows with one item_id
    each have their ranks. Texts may be as long as a row can be. Empty tables give an empty result; extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lexical")
    found = search(build_index(docs, scratch, p), items, scratch, p)
    return found.select("item_id", "rank", "doc_id", "score")
