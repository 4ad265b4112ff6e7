"""Queries on diagrams, keys, failures, roles, paths and drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import rules
from docquarry.operators import diagrams
from docquarry.sources.tables import table

_ROLES = "actor service component datastore external process decision terminal".split()
_SOURCES = r"""SELECT p_partkey AS source_id, concat('graph LR', chr(10), CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'a --> b' WHEN 1 THEN concat('x', chr(13), chr(10), '  Click a') WHEN 2 THEN 'a[< / IMG src=x>]' WHEN 3 THEN 'a[JavaScript :x]'
    WHEN 4 THEN concat('%%{ init : {"theme": 1, "themeCSS" : 2} }%%', chr(10), 'click a b') WHEN 5 THEN '%%{init: {"theme": 1}}%%' WHEN 6 THEN concat('click', chr(10), 'datax') ELSE 'clicks a' END) AS source FROM part"""
_KEYS = "SELECT c_custkey AS key_id, concat(' ', c_name, ':x ') AS a, CASE WHEN c_custkey % 3 = 0 THEN repeat('long part ', 25) ELSE '' END AS b FROM customer"
_CALLS = "SELECT o_orderkey AS call_id, CAST(CASE CAST(o_orderkey % 13 AS INT) WHEN 0 THEN 429 WHEN 1 THEN 408 WHEN 2 THEN 401 WHEN 3 THEN 402 WHEN 4 THEN 404 WHEN 5 THEN 425 WHEN 6 THEN 503 WHEN 7 THEN 599 WHEN 8 THEN 302 WHEN 9 THEN 422 ELSE 500 END AS INT) AS status, CAST(o_orderkey % 9 AS INT) AS failures, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 12 AS DOUBLE) END AS hint FROM orders"
_PATHS = "SELECT p_partkey AS path_id, CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'src/a.PY' WHEN 1 THEN '.ts' WHEN 2 THEN 'b.d/readme' WHEN 3 THEN 'x/Guide.MD' WHEN 4 THEN 'm.cjs' WHEN 5 THEN 'v.tsx' ELSE 'notes.txt' END AS path FROM part"
_DRAFTS = "SELECT o_custkey AS slug, o_orderkey AS seq, o_orderpriority = '1-URGENT' AS locked, o_totalprice AS body FROM orders"
_ASKED = "SELECT o_custkey AS user_id, o_orderkey % 200 AS project_id FROM orders"
_USERS = "SELECT c_custkey AS user_id, c_custkey % 9 <> 0 AS active, c_custkey % 50 = 1 AS admin FROM customer"
_PROJECTS = "SELECT s_suppkey AS project_id, s_suppkey * 7 % 150 AS owner_id FROM supplier"
_MEMBERS = "SELECT c_custkey AS user_id, c_custkey * 3 % 200 AS project_id, CASE WHEN c_custkey % 2 = 0 THEN 'editor' ELSE 'viewer' END AS role FROM customer"


def _sql(spark, sf_dir, sql):
    name = sql.rsplit(" FROM ", 1)[1].split()[0]
    sql = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def _diagrams(spark, sf_dir):
    """A diagram per part: three nodes and four edges, with faults at some keys."""
    roles = "array(" + ", ".join(f"'{r}'" for r in _ROLES) + ")"
    k = "p_partkey"
    node = f"named_struct('id', CASE WHEN i = 2 AND {k} % 5 = 0 THEN 'End' WHEN i = 2 AND {k} % 7 = 0 THEN 'n1' WHEN i = 2 AND {k} % 11 = 0 THEN '9x' ELSE concat('n', i) END, 'label', CASE WHEN i = 1 AND {k} % 6 = 0 THEN 'a|b' WHEN i = 1 AND {k} % 13 = 0 THEN ' ' ELSE concat('Part ', {k}, ' ', i) END, 'role', {roles}[CAST(({k} + i) % 8 AS INT)])"
    edge = f"named_struct('source', concat('n', 1 + i % 3), 'target', concat('n', 1 + {k} * i % 4), 'label', CASE WHEN i % 2 = 0 THEN concat('e', {k} % 3) ELSE '' END, 'kind', CASE WHEN {k} % 2 = 0 THEN 'dependency' WHEN i = 1 THEN 'return' ELSE 'flow' END)"
    return table(spark, sf_dir, "part").selectExpr(
        f"{k} AS diagram_id", f"CASE WHEN {k} % 3 = 0 THEN 'sequence' ELSE 'flow' END AS kind", f"CASE WHEN {k} % 4 = 0 THEN 'top_down' ELSE 'left_right' END AS direction",
        f"transform(sequence(1, 3), i -> {node}) AS nodes", f"transform(sequence(1, CAST(1 + {k} % 4 AS INT)), i -> {edge}) AS edges",
    )


def _calls(spark, sf_dir):
    cls = rules.error_class(F.col("status"))
    return _sql(spark, sf_dir, _CALLS).select("call_id", cls.alias("class"), rules.retryable(cls).alias("retryable"), rules.backoff(F.col("failures"), F.col("hint")).alias("wait"))


QUERIES = {
    "mermaid_text": lambda spark, sf_dir: _diagrams(spark, sf_dir).select("diagram_id", diagrams.mermaid_text(*map(F.col, ("kind", "direction", "nodes", "edges"))).alias("source")),
    "diagram_faults": lambda spark, sf_dir: _diagrams(spark, sf_dir).select("diagram_id", F.array_join(diagrams.diagram_faults(*map(F.col, ("kind", "nodes", "edges"))), ",").alias("faults")),
    "mermaid_guard": lambda spark, sf_dir: diagrams.source_guard(_sql(spark, sf_dir, _SOURCES)).select("source_id", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("line", F.lit(0)).alias("line")),
    "idempotency_key": lambda spark, sf_dir: _sql(spark, sf_dir, _KEYS).select("key_id", rules.idempotency_key([F.col("a"), F.col("b")]).alias("key")),
    "error_class": _calls,
    "path_route": lambda spark, sf_dir: _sql(spark, sf_dir, _PATHS).select("path_id", F.coalesce(rules.language(F.col("path")), F.lit("")).alias("language"), rules.chunker(F.col("path")).alias("chunker")),
    "merge_drafts": lambda spark, sf_dir: rules.merge_drafts(_sql(spark, sf_dir, _DRAFTS), ["slug"]),
    "effective_role": lambda spark, sf_dir: rules.effective_roles(*(_sql(spark, sf_dir, s) for s in (_ASKED, _USERS, _PROJECTS, _MEMBERS))).select("user_id", "project_id", F.coalesce("role", F.lit("")).alias("role")),
}

_SIDES = [" ".join(f"WHEN '{r}' THEN '{pair[k]}'" for r, pair in diagrams.SHAPES.items()) for k in (0, 1)]
_DIAGRAMS = f"""
    d AS (SELECT p_partkey AS k, k % 3 = 0 AS seq FROM part),
    n AS (SELECT k, seq, i, CASE WHEN i = 2 AND k % 5 = 0 THEN 'End' WHEN i = 2 AND k % 7 = 0 THEN 'n1' WHEN i = 2 AND k % 11 = 0 THEN '9x' ELSE 'n' || i END AS id,
                 CASE WHEN i = 1 AND k % 6 = 0 THEN 'a|b' WHEN i = 1 AND k % 13 = 0 THEN ' ' ELSE 'Part ' || k || ' ' || i END AS label, {_ROLES}[(k + i) % 8 + 1] AS role FROM d, (SELECT unnest([1, 2, 3]) AS i)),
    e AS (SELECT k, seq, i, 'n' || (1 + i % 3) AS source, 'n' || (1 + k * i % 4) AS target, CASE WHEN i % 2 = 0 THEN 'e' || k % 3 ELSE '' END AS label, CASE WHEN k % 2 = 0 THEN 'dependency' WHEN i = 1 THEN 'return' ELSE 'flow' END AS kind
          FROM d, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE i <= 1 + k % 4)"""

ORACLE = {
    "mermaid_text": f"""
        WITH {_DIAGRAMS},
        l AS (SELECT k, 0 AS o, 0 AS i, CASE WHEN seq THEN 'sequenceDiagram' WHEN k % 4 = 0 THEN 'flowchart TD' ELSE 'flowchart LR' END AS line FROM d
              UNION ALL SELECT k, 1, i, CASE WHEN seq THEN '  participant ' || id || ' as ' || label ELSE '  ' || id || CASE role {_SIDES[0]} END || label || CASE role {_SIDES[1]} END END FROM n
              UNION ALL SELECT k, 2, i, CASE WHEN seq THEN '  ' || source || CASE WHEN kind = 'return' THEN '-->>' ELSE '->>' END || target || CASE WHEN label <> '' THEN ': ' || label ELSE '' END
                   ELSE '  ' || source || CASE WHEN kind = 'dependency' THEN ' -.->' ELSE ' -->' END || CASE WHEN label <> '' THEN '|' || label || '|' ELSE '' END || ' ' || target END FROM e)
        SELECT k AS diagram_id, string_agg(line, chr(10) ORDER BY o, i) || chr(10) AS source FROM l GROUP BY k""",
    "diagram_faults": f"""
        WITH {_DIAGRAMS},
        f AS (SELECT k, 3 AS o, 'bad_id' AS f FROM n WHERE NOT regexp_matches(id, '^[A-Za-z][A-Za-z0-9_]*$') UNION SELECT k, 4, 'reserved_id' FROM n WHERE lower(id) = 'end'
              UNION SELECT k, 5, 'duplicate_node' FROM n GROUP BY k, id HAVING count(*) > 1 UNION SELECT k, 6, 'empty_label' FROM n WHERE trim(label) = ''
              UNION SELECT k, 7, 'unsafe_label' FROM n WHERE contains(label, '|') UNION SELECT e.k, 8, 'unknown_endpoint' FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = e.k AND id = source) OR NOT EXISTS (SELECT 1 FROM n WHERE n.k = e.k AND id = target)
              UNION SELECT k, 9, 'duplicate_edge' FROM e GROUP BY k, source, target, label, kind HAVING count(*) > 1 UNION SELECT k, 10, 'not_a_lifeline' FROM n WHERE seq AND role IN ('process', 'decision', 'terminal'))
        SELECT d.k AS diagram_id, coalesce(string_agg(f, ',' ORDER BY o), '') AS faults FROM d LEFT JOIN f USING (k) GROUP BY d.k""",
    "mermaid_guard": "SELECT p_partkey AS source_id, (['', 'interaction', 'raw_html', 'unsafe_url', 'unsafe_directive', '', '', ''])[p_partkey % 8 + 1] AS code, ([0, 3, 2, 2, 2, 0, 0, 0])[p_partkey % 8 + 1]::INT AS line FROM part",
    "idempotency_key": rf"""
        WITH k AS ({_KEYS}), j AS (SELECT key_id, replace(replace(trim(a), '\', '\\'), ':', '\:') || ':' || replace(replace(trim(b), '\', '\\'), ':', '\:') AS j FROM k)
        SELECT key_id, CASE WHEN length(j) <= 191 THEN j ELSE substring(j, 1, 126) || ':' || sha256(j) END AS key FROM j""",
    "error_class": f"""
        WITH c AS (SELECT *, CASE WHEN status = 429 THEN 'rate_limited' WHEN status = 408 THEN 'timeout' WHEN status IN (401, 403) THEN 'authentication' WHEN status = 402 THEN 'quota_exhausted' WHEN status IN (400, 404, 422) THEN 'invalid_request' WHEN status = 425 OR status BETWEEN 500 AND 599 THEN 'server_error' ELSE 'call_failed' END AS class FROM ({_CALLS}))
        SELECT call_id, class, class IN ('rate_limited', 'timeout', 'server_error') AS retryable, least(greatest(0.5 * pow(2.0, greatest(failures - 1, 0)), coalesce(hint, 0.0)), 8.0)::DOUBLE AS wait FROM c""",
    "path_route": "SELECT p_partkey AS path_id, (['python', '', '', '', 'javascript', 'typescript', ''])[p_partkey % 7 + 1] AS language, CASE WHEN p_partkey % 7 IN (3, 6) THEN 'sections' ELSE 'lines' END AS chunker FROM part",
    "merge_drafts": f"WITH w AS ({_DRAFTS}) SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY slug ORDER BY locked DESC, CASE WHEN locked THEN seq ELSE -seq END) = 1",
    "effective_role": f"""
        WITH a AS ({_ASKED}), u AS ({_USERS}), p AS ({_PROJECTS}), m AS ({_MEMBERS})
        SELECT a.user_id, a.project_id, CASE WHEN coalesce(active, false) AND owner_id IS NOT NULL THEN CASE WHEN admin OR owner_id = a.user_id THEN 'owner' ELSE coalesce(role, '') END ELSE '' END AS role
        FROM a LEFT JOIN u USING (user_id) LEFT JOIN p USING (project_id) LEFT JOIN m ON m.user_id = a.user_id AND m.project_id = a.project_id""",
}
