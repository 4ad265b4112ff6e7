"""Queries on claims, citations, modules, robots rules and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import audit, graph
from docquarry.sources.tables import table

_CLAIMS = "SELECT p_partkey AS claim_id, p_partkey % 5 AS k FROM part"
_CITATIONS = "SELECT p_partkey AS citation_id, concat('s', p_partkey % 4) AS snapshot_id, concat('l', p_partkey % 10) AS locator, CASE WHEN p_partkey % 3 = 0 THEN concat('QUOTE  ', p_partkey % 20) ELSE '' END AS quote FROM part WHERE p_partkey % 6 <> 0"
_EVIDENCE = "SELECT DISTINCT concat('s', p_partkey % 3) AS snapshot_id, concat('l', p_partkey % 8) AS locator, concat('a quote ', p_partkey % 8, ' stands') AS text FROM part"
_USES = "SELECT l_orderkey AS document, l_orderkey * 10 + l_linenumber AS seq, concat('s', l_suppkey % 2) AS snapshot_id, concat('l', l_partkey % 3) AS locator FROM lineitem"
_FILES = "SELECT p_brand AS repo, concat('f', lpad(CAST(p_partkey AS STRING), 6, '0'), '.py') AS path, p_partkey * 397 % 700000 AS size FROM part"
_MODULES = "SELECT p_partkey AS path, concat('pkg', p_partkey % 7, '.sub', p_partkey % 30, '.m', p_partkey % 400) AS module FROM part"
_IMPORTS = "SELECT l_orderkey % 500 AS file, CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN concat('m', l_partkey % 800) WHEN 1 THEN concat('sub', l_partkey % 30, '.m', l_partkey % 400) ELSE concat('ext', l_partkey % 5, '.x') END AS module FROM lineitem"
_TARGETS = "SELECT p_partkey AS url_id, concat('h', p_partkey % 3) AS host, concat('/', CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'private/a' WHEN 1 THEN 'private/pub/x.html' WHEN 2 THEN 'shop?q=1' ELSE 'b.pdf' END, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END) AS target FROM part"
_RULES = "VALUES ('h0', '/private', false), ('h0', '/private/pub', true), ('h0', '/*.pdf$', false), ('h1', '/', false), ('h1', '/shop?', true), ('h1', '/b', true), ('h1', '/b', false), ('h2', '', false), ('h2', '/*/a', false), ('h2', '/shop?q=*x$', false), ('h2', '*.pdfx', false), ('h2', '/private/*/x.html', false), ('h2', '/$hop', false)"


def _sql(spark, sf_dir, sql):
    name = sql.split(" FROM ")[1].split()[0]
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}", 1), source=table(spark, sf_dir, name))


def _claims(spark, sf_dir):
    claims = _sql(spark, sf_dir, _CLAIMS).select("claim_id", F.when(F.col("k") == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.expr("transform(sequence(1, k), i -> claim_id + i * i)")).alias("citation_ids"))
    return audit.claim_audit(claims, _sql(spark, sf_dir, _CITATIONS), _sql(spark, sf_dir, _EVIDENCE))


def _resolved(spark, sf_dir):
    return graph.resolve_modules(_sql(spark, sf_dir, _IMPORTS), _sql(spark, sf_dir, _MODULES))


def _robots(spark, sf_dir):
    return graph.robots_verdicts(_sql(spark, sf_dir, _TARGETS), spark.sql(f"SELECT * FROM {_RULES} AS t(host, pattern, allow)"))


def _reach(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.selectExpr("l_partkey AS a", "(l_partkey * 31 + l_suppkey) % 2000 AS b")
    return graph.reachable(spark, edges, spark.sql("SELECT * FROM VALUES (1L), (2L) AS t(node)"), 3)


QUERIES = {
    "claim_audit": _claims,
    "citation_renumber": lambda spark, sf_dir: audit.renumber(_sql(spark, sf_dir, _USES)),
    "budgeted_select": lambda spark, sf_dir: graph.budgeted_select(_sql(spark, sf_dir, _FILES), "repo", 60, 524288, 12_000_000),
    "module_suffix_resolve": lambda spark, sf_dir: _resolved(spark, sf_dir).distinct(),
    "dependency_counts": lambda spark, sf_dir: graph.dependencies(_resolved(spark, sf_dir)),
    "robots_longest_match": _robots,
    "crawl_frontier": _reach,
}

_RESOLVED = f"""m AS ({_MODULES}), i AS ({_IMPORTS}), p AS (SELECT path, string_split(module, '.') AS p FROM m),
    s AS (SELECT path, unnest(list_transform(range(1, len(p) + 1), lambda k: array_to_string(p[k:], '.'))) AS suffix FROM p),
    u AS (SELECT suffix, min(path) AS resolved FROM s GROUP BY suffix HAVING count(*) = 1), r AS (SELECT file, module, resolved FROM i LEFT JOIN u ON module = suffix)"""

ORACLE = {
    "claim_audit": f"""
        WITH c AS ({_CLAIMS}), t AS ({_CITATIONS}), e AS ({_EVIDENCE}),
        u AS (SELECT claim_id, i, claim_id + i * i AS citation_id FROM c, LATERAL (SELECT unnest(range(1, k + 1)) AS i) x),
        j AS (SELECT claim_id, i, CASE WHEN t.citation_id IS NULL THEN 'unknown_citation' WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.snapshot_id = t.snapshot_id) THEN 'off_snapshot'
                     WHEN e.text IS NULL THEN 'not_retrieved' WHEN quote <> '' AND NOT contains(lower(e.text), lower(regexp_replace(quote, '\\s+', ' ', 'g'))) THEN 'quote_absent' END AS fault
              FROM u LEFT JOIN t USING (citation_id) LEFT JOIN e ON e.snapshot_id = t.snapshot_id AND e.locator = t.locator),
        f AS (SELECT claim_id, arg_min(fault, CASE WHEN fault = 'unknown_citation' THEN i - 1000000 ELSE i END) AS fault FROM j WHERE fault IS NOT NULL GROUP BY claim_id),
        o AS (SELECT c.claim_id, CASE WHEN k = 0 THEN 'missing_citation' ELSE fault END AS reason FROM c LEFT JOIN f USING (claim_id))
        SELECT claim_id, CASE WHEN reason IS NULL THEN 'verified' ELSE 'unsupported' END AS status, coalesce(reason, '') AS reason FROM o""",
    "citation_renumber": f"""
        WITH u AS ({_USES}), m AS (SELECT document, snapshot_id, locator, min(seq) AS first FROM u GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY first, snapshot_id, locator) AS n FROM m)
        SELECT document, seq, 'c' || n AS number FROM u JOIN f USING (document, snapshot_id, locator)""",
    "budgeted_select": f"""
        WITH f AS ({_FILES.replace("AS STRING", "AS VARCHAR")}), r AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS s FROM f WHERE size <= 524288 WINDOW w AS (PARTITION BY repo ORDER BY path ROWS UNBOUNDED PRECEDING))
        SELECT repo, path, size FROM r WHERE n <= 60 AND s <= 12000000""",
    "module_suffix_resolve": f"WITH {_RESOLVED} SELECT DISTINCT file, module, resolved FROM r",
    "dependency_counts": f"WITH {_RESOLVED} SELECT file AS source, coalesce(resolved::VARCHAR, split_part(module, '.', 1)) AS target, CASE WHEN resolved IS NULL THEN 'external' ELSE 'internal' END AS scope, count(*) AS count FROM r GROUP BY ALL",
    "robots_longest_match": rf"""
        WITH u AS ({_TARGETS}), r(host, pattern, allow) AS ({_RULES}),
        x AS (SELECT *, '^' || replace(regexp_replace(CASE WHEN ends_with(pattern, '$') THEN pattern[:-2] ELSE pattern END, '([.+?^$(){{}}|\[\]])', '\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(pattern, '$') THEN '$' ELSE '' END AS re FROM r WHERE pattern <> ''),
        m AS (SELECT url_id, allow, length(pattern) AS n FROM u JOIN x ON u.host = x.host AND regexp_matches(target, re)),
        b AS (SELECT url_id, allow FROM m QUALIFY row_number() OVER (PARTITION BY url_id ORDER BY n DESC, allow DESC) = 1)
        SELECT url_id, coalesce(allow, true) AS allowed FROM u LEFT JOIN b USING (url_id)""",
    "crawl_frontier": """
        WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, (l_partkey * 31 + l_suppkey) % 2000 AS b FROM lineitem),
        r AS (SELECT unnest([1, 2])::BIGINT AS node, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN e ON a = node WHERE depth < 3)
        SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""",
}
