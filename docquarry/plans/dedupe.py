"""Queries on duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import dedupe
from docquarry.sources.stage import Stage
from docquarry.sources.tables import table


def _near_pairs(spark, sf_dir):
    """Pairs of first arrivals; exact copies are collapsed before."""
    docs = table(spark, sf_dir, "documents")
    firsts = dedupe.exact_verdicts(docs).where("kind = 'unique'").select("doc_id")
    pairs = dedupe.near_pairs(dedupe.long_sketches(docs, firsts, Stage(spark, "pairs")))
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


def _verdicts(spark, sf_dir):
    return dedupe.verdicts(table(spark, sf_dir, "documents")).withColumn("similarity", F.round("similarity", 6))


QUERIES = {
    "near_dedup": _verdicts,
    "exact_dedup": lambda spark, sf_dir: dedupe.exact_verdicts(table(spark, sf_dir, "documents")),
    "near_dedup_pairs": _near_pairs,
}

_PAIRS = r"""
    n AS (SELECT doc_id, text, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS f FROM documents),
    u AS (SELECT * FROM n QUALIFY doc_id = min(doc_id) OVER (PARTITION BY f)),
    w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM u WHERE length(f) >= 200),
    g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
    k AS (SELECT doc_id, list_sort(list_transform(g, lambda s: substring(sha256(s), 1, 16)))[1:256] AS k FROM g),
    e AS (SELECT doc_id, unnest(k) AS h FROM k),
    i AS (SELECT x.doc_id AS a, y.doc_id AS b, list(x.h) AS shared FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
    v AS (SELECT a, b, shared, least(len(p.k), len(q.k)) AS m, list_sort(list_distinct(list_concat(p.k, q.k)))[1:least(len(p.k), len(q.k))] AS universe FROM i JOIN k p ON p.doc_id = a JOIN k q ON q.doc_id = b),
    t AS (SELECT a, b, len(list_intersect(shared, universe)) / m AS similarity FROM v), s AS (SELECT * FROM t WHERE similarity >= 0.85)"""

ORACLE = {
    "exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS fp FROM documents),
        f AS (SELECT *, min(doc_id) OVER (PARTITION BY fp) AS first FROM n)
        SELECT doc_id, fp, CASE WHEN doc_id <> first THEN 'exact' ELSE 'unique' END AS kind,
               CASE WHEN doc_id <> first THEN first END AS original
        FROM f""",
    "near_dedup_pairs": f"""WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM s""",
    "near_dedup": f"""
        WITH RECURSIVE {_PAIRS},
        before_b AS (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS i FROM s GROUP BY b),
        r AS (SELECT 0 AS i, []::BIGINT[] AS gone UNION ALL
              SELECT r.i + 1, CASE WHEN len(list_filter(before, lambda a: NOT list_contains(gone, a))) > 0 THEN list_append(gone, b) ELSE gone END FROM r JOIN before_b AS o ON o.i = r.i + 1),
        gs AS (SELECT arg_max(gone, i) AS gone FROM r),
        o AS (SELECT b, a AS original, similarity FROM s, gs WHERE list_contains(gone, b) AND NOT list_contains(gone, a) QUALIFY row_number() OVER (PARTITION BY b ORDER BY similarity DESC, a) = 1),
        x AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS first FROM n)
        SELECT doc_id, CASE WHEN doc_id <> first THEN 'exact' WHEN b IS NOT NULL THEN 'near' ELSE 'unique' END AS kind,
               coalesce(original, CASE WHEN doc_id <> first THEN first END) AS original, round(CASE WHEN doc_id <> first THEN 1.0::DOUBLE ELSE similarity END, 6) AS similarity
        FROM x LEFT JOIN o ON b = first""",
}
