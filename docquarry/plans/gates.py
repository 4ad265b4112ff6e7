"""Queries on gates, pruning, first writes and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import gates
from docquarry.sources import bundles
from docquarry.sources.stage import Stage
from docquarry.sources.tables import table

_BLOCKS = """SELECT p_partkey % 40 AS chapter, p_partkey AS position, CASE WHEN p_partkey % 3 = 0 THEN 'markdown' ELSE 'code' END AS type, CASE WHEN p_partkey % 3 = 0 THEN concat('text ', p_partkey, CASE WHEN p_partkey % 4 = 0 THEN ' ```' ELSE '' END, CASE WHEN p_partkey % 6 = 0 THEN ' GHP_x' ELSE '' END) END AS markdown,
    CASE WHEN p_partkey % 2 = 0 THEN 'Python' ELSE 'ts' END AS language, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'x = 1' WHEN 1 THEN 'import os' WHEN 2 THEN 'def (' WHEN 3 THEN 'a.b()' ELSE 'api_key = 2' END AS code, p_partkey % 7 = 0 AS illustrative, p_partkey % 4 AS cited FROM part"""
_USES = "SELECT l_suppkey AS document, concat('c', l_partkey % 60) AS citation_id FROM lineitem"
_CITATIONS = "SELECT o_custkey % 100 AS document, concat('c', o_orderkey % 50) AS citation_id, concat('s', o_orderkey % 7) AS snapshot_id FROM orders"
_APPROVED = "SELECT s_suppkey AS document, concat('s', s_suppkey % 7) AS snapshot_id FROM supplier"
_FACTS = "SELECT p_partkey % 50 AS chapter, p_partkey AS fact_id, CASE WHEN p_partkey % 3 = 0 THEN 'teaching_abstraction' ELSE 'fact' END AS kind, p_partkey % 9 AS a, p_partkey % 14 AS b FROM part"
_PACK = "SELECT s_suppkey AS chapter, s_suppkey % 8 AS low FROM supplier"
_WRITES = "SELECT o_custkey AS project, o_orderstatus AS kind, concat('h', o_orderkey % 3) AS sha256, o_orderkey AS seq, o_totalprice AS provenance FROM orders"
_LOCATORS = "SELECT o_custkey % 8 AS document, concat('c', o_custkey % 80) AS citation_id, concat('src/\"a', o_custkey % 80, '\".py') AS locator FROM orders"
_KNOWN = "SELECT c_custkey AS project, 'O' AS kind, concat('h', c_custkey % 3) AS sha256 FROM customer"


def _sql(spark, sf_dir, sql):
    name = sql.rsplit(" FROM ", 1)[1].split()[0]
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def _blocks(spark, sf_dir):
    return _sql(spark, sf_dir, _BLOCKS).withColumn("citation_ids", F.expr("CASE WHEN cited > 0 THEN transform(sequence(1, cited), i -> concat('e', i)) ELSE cast(array() as array<string>) END"))


def _pruned(spark, sf_dir):
    facts = _sql(spark, sf_dir, _FACTS).selectExpr("chapter", "fact_id", "kind", "array(concat('e', a), concat('e', b)) AS citation_ids")
    pack = _sql(spark, sf_dir, _PACK).selectExpr("chapter", "array(concat('e', low), concat('e', low + 1)) AS citation_ids")
    return gates.prune(facts, pack).withColumn("citation_ids", F.array_join("citation_ids", ","))


def _document_tables(spark, sf_dir):
    blocks = _blocks(spark, sf_dir).withColumn("document", F.col("chapter") % 8)
    chapters = blocks.select("document", "chapter").distinct().selectExpr("document", "chapter", "chapter AS ordinal", "concat('Chapter ', chapter) AS title", "CASE WHEN chapter % 3 = 0 THEN 'In short.' ELSE '' END AS summary")
    documents = spark.range(8).selectExpr("id AS document", "concat('Book ', id) AS title", "'About it.' AS description")
    return documents, chapters, blocks


def _bundle(spark, sf_dir):
    return gates.markdown_bundle(*_document_tables(spark, sf_dir))


def _archives(spark, sf_dir):
    """Bundles written as archives and read back."""
    documents, chapters, blocks = _document_tables(spark, sf_dir)
    exercises = chapters.where("chapter % 5 = 1").selectExpr("document", "chapter", "0 AS position", "concat('Why ', chapter, '?') AS prompt", "CASE WHEN chapter % 2 = 0 THEN 'So.' END AS solution")
    parts = gates.bundle_parts(documents, chapters, blocks, exercises)
    diagrams = chapters.where("chapter % 4 = 0").selectExpr("document", "concat('d', chapter) AS slug", "concat('<svg>', title, '</svg>') AS svg")
    cited = _sql(spark, sf_dir, _LOCATORS).where("document < 7").distinct()
    files = bundles.tutorial_files(parts, diagrams, cited)
    return _digests(bundles.save_bundles(spark, files, Stage(spark, "bundles").folder))


def _exports(spark, sf_dir):
    documents, chapters, _ = _document_tables(spark, sf_dir)
    text = F.expr("CASE chapter % 4 WHEN 0 THEN concat('# Own ', chapter) WHEN 1 THEN concat(' text ', chapter, ' ') END")
    drafts = chapters.withColumn("slug", F.concat(F.lit("s"), "chapter")).withColumn("markdown", text)
    return _digests(bundles.save_bundles(spark, bundles.run_files(documents, drafts), Stage(spark, "exports").folder))


def _digests(read):
    return read.select("document", "name", F.length("part").alias("chars"), F.sha2(F.col("part").cast("binary"), 256).alias("sha256"))


QUERIES = {
    "block_gates": lambda spark, sf_dir: gates.block_findings(_blocks(spark, sf_dir)),
    "citation_gates": lambda spark, sf_dir: gates.citation_findings(*(_sql(spark, sf_dir, s) for s in (_USES, _CITATIONS, _APPROVED))),
    "prune_references": _pruned,
    "artifact_first_write": lambda spark, sf_dir: gates.keep_first(_sql(spark, sf_dir, _WRITES), _sql(spark, sf_dir, _KNOWN), ["project", "kind", "sha256"], "seq"),
    "markdown_bundle": _bundle,
    "bundle_archives": _archives,
    "run_export": _exports,
}

ORACLE = {
    "block_gates": rf"""
        WITH b AS ({_BLOCKS}), p AS (SELECT *, type = 'code' AND language = 'Python' AS py FROM b)
        SELECT chapter, position, 'code.syntax' AS finding FROM p WHERE py AND code = 'def (' UNION ALL SELECT chapter, position, 'code.unverified' FROM p WHERE type = 'code' AND language = 'ts' AND NOT illustrative
        UNION ALL SELECT chapter, position, 'code.untraceable' FROM p WHERE py AND NOT illustrative AND cited > 0 AND code IN ('x = 1', 'def (', 'api_key = 2') AND NOT contains(code, 'def ')
        UNION ALL SELECT chapter, position, 'markdown.unclosed-fence' FROM p WHERE type = 'markdown' AND contains(markdown, '```')
        UNION ALL SELECT chapter, position, 'secret.marker' FROM p WHERE (type = 'markdown' AND contains(markdown, 'GHP_')) OR (type = 'code' AND code = 'api_key = 2')""",
    "citation_gates": f"""
        WITH u AS ({_USES}), c AS ({_CITATIONS}), a AS ({_APPROVED})
        SELECT DISTINCT document, citation_id, 'citation.unknown' AS finding FROM u ANTI JOIN c USING (document, citation_id) UNION ALL SELECT DISTINCT document, citation_id, 'citation.out-of-scope' FROM c ANTI JOIN a USING (document, snapshot_id)""",
    "prune_references": f"""
        WITH f AS ({_FACTS}), p AS ({_PACK}), j AS (SELECT f.*, list_transform(list_filter([a, b], lambda x: x IN (low, low + 1)), lambda x: 'e' || x) AS c FROM f LEFT JOIN p USING (chapter))
        SELECT chapter, fact_id, kind, coalesce(array_to_string(c, ','), '') AS citation_ids, coalesce(len(c), 0) > 0 OR kind <> 'fact' AS kept FROM j""",
    "artifact_first_write": f"WITH w AS ({_WRITES}), k AS ({_KNOWN}) SELECT project, kind, sha256, min(seq) AS seq, arg_min(provenance, seq) AS provenance FROM w ANTI JOIN k USING (project, kind, sha256) GROUP BY ALL",
    "bundle_archives": f"""
        WITH b AS ({_BLOCKS}), t AS (SELECT chapter, string_agg(CASE WHEN type = 'code' THEN '```' || language || chr(10) || code || chr(10) || '```' ELSE markdown END, chr(10) || chr(10) ORDER BY position) AS t FROM b GROUP BY chapter),
        x AS (SELECT *, CASE WHEN chapter % 5 = 1 THEN chr(10) || chr(10) || '### Exercise: Why ' || chapter || '?' || CASE WHEN chapter % 2 = 0 THEN chr(10) || chr(10) || 'So.' ELSE '' END ELSE '' END AS x FROM t),
        c AS (SELECT chapter % 8 AS document, string_agg('## Chapter ' || chapter || chr(10) || chr(10) || CASE WHEN chapter % 3 = 0 THEN 'In short.' || chr(10) || chr(10) ELSE '' END || t || x, chr(10) || chr(10) ORDER BY chapter) AS c FROM x GROUP BY ALL),
        s AS (SELECT document, string_agg('  ' || to_json(citation_id)::VARCHAR || ': ' || to_json(locator)::VARCHAR, ',' || chr(10) ORDER BY citation_id) AS s FROM (SELECT DISTINCT * FROM ({_LOCATORS}) WHERE document < 7) GROUP BY document),
        f AS (SELECT document, 'tutorial.md' AS name, '# Book ' || document || chr(10) || chr(10) || 'About it.' || chr(10) || chr(10) || c || chr(10) AS part FROM c
              UNION ALL SELECT chapter % 8, 'assets/diagrams/d' || chapter || '.svg', '<svg>Chapter ' || chapter || '</svg>' FROM t WHERE chapter % 4 = 0
              UNION ALL SELECT c.document, 'sources.json', CASE WHEN s IS NULL THEN '{{}}' ELSE '{{' || chr(10) || s || chr(10) || '}}' END FROM c LEFT JOIN s ON s.document = c.document)
        SELECT document::VARCHAR AS document, name, length(part)::INT AS chars, sha256(part) AS sha256 FROM f""",
    "run_export": f"""
        WITH c AS (SELECT DISTINCT chapter FROM ({_BLOCKS})),
        f AS (SELECT chapter % 8 AS document, 's' || chapter || '.md' AS name, CASE WHEN chapter % 4 = 0 THEN '# Own ' || chapter ELSE '# Chapter ' || chapter || chr(10) || CASE WHEN chapter % 4 = 1 THEN chr(10) || 'text ' || chapter || chr(10) WHEN chapter % 3 = 0 THEN chr(10) || 'In short.' || chr(10) ELSE '' END END AS part FROM c
              UNION ALL SELECT chapter % 8, 'README.md', '# Book ' || chapter % 8 || chr(10) || chr(10) || string_agg('- Chapter ' || chapter || chr(10), '' ORDER BY chapter) FROM c GROUP BY chapter % 8)
        SELECT document::VARCHAR AS document, name, length(part)::INT AS chars, sha256(part) AS sha256 FROM f""",
    "markdown_bundle": f"""
        WITH b AS ({_BLOCKS}), t AS (SELECT chapter, string_agg(CASE WHEN type = 'code' THEN '```' || language || chr(10) || code || chr(10) || '```' ELSE markdown END, chr(10) || chr(10) ORDER BY position) AS t FROM b GROUP BY chapter),
        c AS (SELECT chapter % 8 AS document, string_agg('## Chapter ' || chapter || chr(10) || chr(10) || CASE WHEN chapter % 3 = 0 THEN 'In short.' || chr(10) || chr(10) ELSE '' END || t, chr(10) || chr(10) ORDER BY chapter) AS c FROM t GROUP BY ALL)
        SELECT document, '# Book ' || document || chr(10) || chr(10) || 'About it.' || chr(10) || chr(10) || c || chr(10) AS markdown FROM c""",
}
