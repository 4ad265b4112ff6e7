"""Keyword retrieval over several indexes, evidence packs and the corpus map."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docquarry.operators.ordered import fold

#: What a hit of each index weighs.
WEIGHTS = (("document_title", 3.0), ("document_body", 1.0), ("document_chunk", 1.5), ("code_symbol", 2.0))
BOOSTS = {"exact_symbol": 2.5, "path_hint": 1.6, "title_term": 1.3}


def term_score(terms: list[str], *columns: str) -> Column:
    """Number of (column, term) pairs that match, case ignored."""
    hits = [F.contains(F.lower(F.col(c)), F.lit(t.lower())).cast("int") for c in columns for t in terms]
    return sum(hits[1:], hits[0])


def search_index(rows: DataFrame, kind: str, terms: list[str], columns: list[str], key: str, limit: int = 20) -> DataFrame:
    """(kind, ordinal, id, score, rank): the best ``limit`` rows of one index; each task keeps its own best first."""
    place = [k for k, _ in WEIGHTS].index(kind)
    found = rows.select(F.col(key).alias("id"), term_score(terms, *columns).cast("double").alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # of at most ``limit`` rows
    return ranked.select(F.lit(kind).alias("kind"), F.lit(place).alias("ordinal"), "id", (F.col("score") * WEIGHTS[place][1]).alias("score"), "rank")


def merge(parts: list[DataFrame], limit: int = 20) -> DataFrame:
    """Hits of all indexes by weighted score, ties in the order of the indexes and of their ranks."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.orderBy(F.desc("score"), "ordinal", "rank").limit(limit)


def boosted(hits: DataFrame, symbols: list[str], hints: list[str], terms: list[str]) -> DataFrame:
    """Adds boosted: score times a factor per exact symbol, per path hint in the locator and per term in the title."""
    last = F.element_at(F.split("title", r"\."), -1)
    n = lambda conditions: sum((c.cast("int") for c in conditions), F.lit(0))
    exact = n(F.col("is_symbol") & ((F.col("title") == s) | (last == s)) for s in symbols)
    path = n(F.contains(F.lower("locator"), F.lit(h.lower())) for h in hints)
    title = n(F.contains(F.lower("title"), F.lit(t.lower())) for t in terms)
    factor = F.pow(F.lit(BOOSTS["exact_symbol"]), exact) * F.pow(F.lit(BOOSTS["path_hint"]), path) * F.pow(F.lit(BOOSTS["title_term"]), title)
    return hits.withColumn("boosted", F.round(F.col("score") * factor, 6))


def best_per_locator(hits: DataFrame, by: list[str], locator: str = "locator", score: str = "score", order: str = "seq") -> DataFrame:
    """The best hit of each locator, the earlier on a tie."""
    others = [c for c in hits.columns if c not in (*by, locator)]
    best = hits.groupBy(*by, locator).agg(F.max_by(F.struct(*others), F.struct(F.col(score), -F.col(order))).alias("_b"))
    return best.select(*by, locator, "_b.*")


def pack_evidence(items: DataFrame, by: str, max_items: int = 12, char_budget: int = 8000, per_document: int = 3) -> DataFrame:
    """(by, position, locator, truncated): items of (by, locator, document_id, score, size) in order, under the limits.

    An item beyond its document's share or the budget is skipped and smaller ones still fit; a full pack stops. The
    fold runs over each pack's array of candidates inside one expression; what precedes a pack is bounded by
    the hits that a request asks for.
    """
    ordered = items.groupBy(by).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("k"), "locator", F.coalesce("document_id", "locator").alias("doc"), F.col("size").cast("long").alias("size")))).alias("c"))
    fold = F.expr(f"""
        aggregate(c, named_struct('kept', cast(array() as array<string>), 'docs', cast(array() as array<string>), 'n', 0L, 'cut', false, 'full', false),
          (s, x) -> if(s.full, s,
            if(size(filter(s.docs, d -> d = x.doc)) >= {per_document}, named_struct('kept', s.kept, 'docs', s.docs, 'n', s.n, 'cut', true, 'full', false),
            if(size(s.kept) >= {max_items}, named_struct('kept', s.kept, 'docs', s.docs, 'n', s.n, 'cut', true, 'full', true),
            if(s.n + x.size > {char_budget}, named_struct('kept', s.kept, 'docs', s.docs, 'n', s.n, 'cut', true, 'full', false),
            named_struct('kept', array_append(s.kept, x.locator), 'docs', array_append(s.docs, x.doc), 'n', s.n + x.size, 'cut', s.cut, 'full', false))))))""")
    return ordered.select(by, fold.alias("s")).select(by, F.posexplode("s.kept").alias("position", "locator"), F.col("s.cut").alias("truncated"))


def corpus_map(docs: DataFrame, group: Column, order: Column, language: Column, groups: int = 20, samples: int = 3) -> DataFrame:
    """(group, documents, languages, samples): largest groups first; languages in order of first sight, the first samples.

    Only the first row of each language and the first ``samples`` rows of a group are gathered, after sums by key.
    """
    own = docs.select(group.alias("group"), order.alias("o"), language.alias("language"))
    counts = own.groupBy("group").agg(F.count(F.lit(1)).alias("documents"))
    firsts = own.where("language is not null").groupBy("group", "language").agg(F.min("o").alias("o")).groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "language"))), lambda x: x["language"]), ",").alias("languages"))
    ranked = own.withColumn("_n", F.row_number().over(Window.partitionBy("group").orderBy("o"))).where(F.col("_n") <= samples)
    heads = ranked.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda x: x.cast("string")), ",").alias("samples"))
    return counts.join(firsts, "group", "left").join(heads, "group").orderBy(F.desc("documents"), "group").limit(groups)


def snapshot_fingerprint(docs: DataFrame, by: str, key: Column, digest: Column, header: str) -> DataFrame:
    """(by, fingerprint, documents): SHA-256 over a header and the sorted ``key TAB digest`` lines of a snapshot.

    The lines pass through a running digest in order, so a snapshot may have any number of documents.
    """
    lines = docs.select(by, F.concat(key, F.lit("\t"), digest, F.lit("\n")).alias("line"))

    def step(state, rows):
        texts = [t for t in rows.column("line").to_pylist() if t is not None]
        state["digest"].update("".join(texts).encode())
        state["documents"] += rows.num_rows
        return []

    start = lambda: {"digest": hashlib.sha256(header.encode()), "documents": 0}
    finish = lambda state: [{"fingerprint": state["digest"].hexdigest(), "documents": state["documents"]}]
    return fold(lines, [by], ["line"], start, step, finish, StructType.fromDDL("fingerprint string, documents long"))


def best_with_reasons(hits: DataFrame, by: list[str], locator: str = "locator", order: str = "seq") -> DataFrame:
    """As ``best_per_locator``, with ``reasons``: why any hit of the locator was found, in the order of first sight."""
    firsts = hits.groupBy(*by, locator, "reason").agg(F.min(order).alias("_o")).groupBy(*by, locator)
    reasons = firsts.agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "reason"))), lambda x: x["reason"]).alias("reasons"))
    return best_per_locator(hits.drop("reason"), by, locator, order=order).join(reasons, [*by, locator])


def pack_queries(requests: DataFrame, by: str) -> DataFrame:
    """(by, position, text, kinds): a request's title and questions ask all indexes, its symbols the code index; blanks are left out."""
    texts = F.concat(F.array(F.struct("title", F.lit("all").alias("kinds"))), F.transform("questions", lambda q: F.struct(q.alias("title"), F.lit("all").alias("kinds"))), F.transform("symbols", lambda s: F.struct(s.alias("title"), F.lit("code_symbol").alias("kinds"))))
    each = requests.select(by, F.posexplode(texts).alias("position", "q")).where("trim(q.title) <> ''")
    return each.select(by, "position", F.col("q.title").alias("text"), F.col("q.kinds").alias("kinds"))


def evidence_packs(hits: DataFrame, by: str, rerank: Callable[[DataFrame], DataFrame] | None = None, **limits: int) -> DataFrame:
    """The packs of ``pack_evidence`` from the best hit of each locator; ``rerank`` may give the candidates other scores before the limits."""
    best = best_per_locator(hits, [by])
    return pack_evidence(best if rerank is None else rerank(best), by, **limits)
