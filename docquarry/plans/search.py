"""Queries on retrieval, evidence and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import dedupe, search
from docquarry.sources.tables import table

_TERMS = ["tion", "ouer", "license", "pathetic"]


def _like(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", search.term_score(_TERMS, "text", "source").alias("score"))
    return own.where("score > 0")


def _merged(spark, sf_dir):
    docs, pages, bench = (table(spark, sf_dir, t) for t in ("documents", "pages", "benchmark"))
    parts = [search.search_index(pages, "document_title", _TERMS, ["url"], "page_id"), search.search_index(docs, "document_body", _TERMS, ["text"], "doc_id"), search.search_index(bench, "document_chunk", _TERMS, ["text"], "item_id")]
    return search.merge(parts).select("kind", "id", "score", "rank")


_HITS = """
    SELECT page_id AS seq, concat('https://h.example/', page_id % 40, '/guide') AS locator, CASE WHEN page_id % 3 = 0 THEN concat('pkg.mod', page_id % 4, '.run') ELSE concat('Guide to load ', page_id % 5) END AS title,
           page_id % 3 = 0 AS is_symbol, CAST(page_id % 7 AS DOUBLE) AS score, concat('c', page_id % 6) AS chapter, CAST(page_id % 9 AS STRING) AS document_id, page_id * 37 % 2500 AS size
    FROM pages"""


def _hits(spark, sf_dir):
    return spark.sql(_HITS.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))


def _boost(spark, sf_dir):
    return search.boosted(_hits(spark, sf_dir), ["run", "pkg.mod1.run"], ["/1", "GUIDE"], ["load", "mod2"]).select("seq", "boosted")


def _pack(spark, sf_dir):
    best = search.best_per_locator(_hits(spark, sf_dir), ["chapter"])
    return search.pack_evidence(best, "chapter").select("chapter", F.col("position").alias("position"), "locator", "truncated")


def _best(spark, sf_dir):
    return search.best_per_locator(_hits(spark, sf_dir), ["chapter"]).select("chapter", "locator", "seq", "score")


def _map(spark, sf_dir):
    return search.corpus_map(table(spark, sf_dir, "documents"), F.coalesce("source", F.lit("(root)")), F.col("doc_id"), F.col("lang"))


def _snapshot(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search.snapshot_fingerprint(docs, "source", F.col("doc_id").cast("string"), dedupe.fingerprint(F.col("text")), "snapshot-v1\n")


QUERIES = {"search_like": _like, "search_merged": _merged, "evidence_boost": _boost, "evidence_best": _best, "evidence_pack": _pack, "corpus_map": _map, "snapshot_fingerprint": _snapshot}


def _score(*columns: str) -> str:
    return " + ".join(f"contains(lower({c}), '{t}')::INT" for c in columns for t in _TERMS)


def _index(name: str, kind: str, columns: list[str], key: str) -> str:
    place = [k for k, _ in search.WEIGHTS].index(kind)
    return f"SELECT '{kind}' AS kind, {place} AS ordinal, {key} AS id, ({_score(*columns)})::DOUBLE * {search.WEIGHTS[place][1]} AS score, row_number() OVER (ORDER BY ({_score(*columns)}) DESC, {key})::INT AS rank FROM {name} WHERE {_score(*columns)} > 0 QUALIFY rank <= 20"


ORACLE = {
    "search_like": f"SELECT doc_id, ({_score('text', 'source')})::INT AS score FROM documents WHERE {_score('text', 'source')} > 0",
    "search_merged": f"""WITH e AS (({_index("pages", "document_title", ["url"], "page_id")}) UNION ALL ({_index("documents", "document_body", ["text"], "doc_id")}) UNION ALL ({_index("benchmark", "document_chunk", ["text"], "item_id")}))
        SELECT kind, id, score, rank FROM e ORDER BY e.score DESC, ordinal, e.rank LIMIT 20""",
    "evidence_boost": f"""WITH h AS ({_HITS})
        SELECT seq, round(score * pow(2.5, (is_symbol AND (title = 'run' OR string_split(title, '.')[-1] = 'run'))::INT + (is_symbol AND (title = 'pkg.mod1.run' OR string_split(title, '.')[-1] = 'pkg.mod1.run'))::INT)
               * pow(1.6, contains(lower(locator), '/1')::INT + contains(lower(locator), 'guide')::INT) * pow(1.3, contains(lower(title), 'load')::INT + contains(lower(title), 'mod2')::INT), 6) AS boosted FROM h""",
    "evidence_best": f"WITH h AS ({_HITS}) SELECT chapter, locator, seq, score FROM h QUALIFY row_number() OVER (PARTITION BY chapter, locator ORDER BY score DESC, seq) = 1",
    "evidence_pack": f"""
        WITH RECURSIVE h AS ({_HITS}), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY chapter, locator ORDER BY score DESC, seq) = 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY score DESC, locator) AS i FROM b),
        f AS (SELECT chapter, 0::BIGINT AS i, []::VARCHAR[] AS kept, []::VARCHAR[] AS docs, 0::BIGINT AS n, false AS cut, false AS done FROM (SELECT DISTINCT chapter FROM o)
              UNION ALL
              SELECT f.chapter, o.i, CASE WHEN ok THEN list_append(kept, o.locator) ELSE kept END, CASE WHEN ok THEN list_append(docs, o.document_id) ELSE docs END, CASE WHEN ok THEN f.n + o.size ELSE f.n END, cut OR NOT ok, done OR (NOT over AND len(kept) >= 12)
              FROM f JOIN (SELECT *, 1 AS one FROM o) o ON o.chapter = f.chapter AND o.i = f.i + 1,
              LATERAL (SELECT len(list_filter(f.docs, lambda d: d = o.document_id)) >= 3 AS over) v, LATERAL (SELECT NOT v.over AND len(f.kept) < 12 AND f.n + o.size <= 8000 AS ok) w
              WHERE NOT done),
        e AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY chapter ORDER BY i DESC) = 1)
        SELECT chapter, (generate_subscripts(kept, 1) - 1)::INT AS position, unnest(kept) AS locator, cut AS truncated FROM e""",
    "corpus_map": """
        WITH d AS (SELECT coalesce(source, '(root)') AS "group", doc_id, lang FROM documents),
        l AS (SELECT "group", lang, min(doc_id) AS o FROM d WHERE lang IS NOT NULL GROUP BY ALL), g AS (SELECT "group", string_agg(lang, ',' ORDER BY o) AS languages FROM l GROUP BY ALL),
        s AS (SELECT "group", string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS samples FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY doc_id) <= 3) GROUP BY ALL),
        c AS (SELECT "group", count(*) AS documents FROM d GROUP BY ALL)
        SELECT c."group", documents, languages, samples FROM c LEFT JOIN g USING ("group") JOIN s USING ("group") ORDER BY documents DESC, 1 LIMIT 20""",
    "snapshot_fingerprint": r"""
        WITH l AS (SELECT source, doc_id::VARCHAR || chr(9) || sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) || chr(10) AS line FROM documents)
        SELECT source, sha256('snapshot-v1' || chr(10) || string_agg(line, '' ORDER BY line)) AS fingerprint, count(*) AS documents FROM l GROUP BY source""",
}
