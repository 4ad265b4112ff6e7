"""Queries on files, names and addresses."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators import files, trees
from docquarry.sources.tables import table

_ENTRIES = """
    SELECT p_partkey AS id, CASE WHEN p_partkey % 29 = 0 THEN '160000' WHEN p_partkey % 31 = 0 THEN '120000' ELSE '100644' END AS mode, CASE WHEN p_partkey % 37 = 0 THEN 'tree' ELSE 'blob' END AS type, p_partkey * 997 AS size,
           concat(CASE CAST(p_partkey % 11 AS INT) WHEN 0 THEN 'Vendor/' WHEN 1 THEN 'a/Build/' WHEN 2 THEN '/abs/' WHEN 3 THEN 'a/../' WHEN 4 THEN 'node_modules/x/' ELSE 'src/lib/' END,
                  CASE CAST(p_partkey % 13 AS INT) WHEN 0 THEN '.env' WHEN 1 THEN '.env.local' WHEN 2 THEN '.env.example' WHEN 3 THEN 'id_rsa' WHEN 4 THEN 'Site.PEM' WHEN 5 THEN 'app.min.js' WHEN 6 THEN 'Yarn.lock' WHEN 7 THEN 'logo.PNG' WHEN 8 THEN '' ELSE 'main.py' END) AS path
    FROM part"""
_SPECS = """
    SELECT p_partkey AS id, concat(CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'https://github.com/' WHEN 1 THEN 'git@github.com:' WHEN 2 THEN ' github.com/' WHEN 3 THEN 'https://gitlab.com/' WHEN 4 THEN 'ssh://github.com/' WHEN 5 THEN 'https://u:p@github.com/' ELSE '' END,
                                   CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'acme' WHEN 1 THEN 'a-b' ELSE '-bad' END, '/', CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'tool.git' WHEN 1 THEN 'tool/' WHEN 2 THEN 'a/b' WHEN 3 THEN 'x.y_z' ELSE 'n?q=1' END) AS spec
    FROM part"""
_CITATIONS = """
    SELECT p_partkey AS id, CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'https://h.example/a#c1@2026-03-04T10:30:00Z' WHEN 1 THEN 'https://h.example/a#c1@2026-13-04T10:30:00Z' WHEN 2 THEN 'https://h.example/a b#c1@2026-03-04T10:30:00Z'
           WHEN 3 THEN concat('o/r@', repeat('a1', 20), '/src/x.py#L3-L9') WHEN 4 THEN concat('o/r@', repeat('a1', 20), '/src/x.py#L9-L3') WHEN 5 THEN concat('o/r@', repeat('a1', 20), '/src/../x.py#L3')
           WHEN 6 THEN concat(' o/r@', repeat('a1', 20), '/x#L', p_partkey, ' ') WHEN 7 THEN concat('o/r@', repeat('a1', 20), '/x#L0') ELSE 'see page 3' END AS text
    FROM part"""
#: IPv4 addresses near the borders of networks and all over, and texts that are none.
_ADDRESSES = """
    SELECT l_orderkey * 10 + l_linenumber AS id, concat(CASE CAST(l_partkey % 19 AS INT) WHEN 0 THEN '127' WHEN 1 THEN '10' WHEN 2 THEN '169.254' WHEN 3 THEN '172.16' WHEN 4 THEN '100.64' WHEN 5 THEN '192.168' WHEN 6 THEN '192.0.2' WHEN 7 THEN '198.18' WHEN 8 THEN '203.0.113'
           WHEN 9 THEN '192.0.0' WHEN 10 THEN '0' WHEN 11 THEN '100.127' WHEN 12 THEN '172.32' WHEN 13 THEN '198.51.100' WHEN 14 THEN '169.254.169' WHEN 15 THEN '0.0.0' ELSE concat(l_partkey % 256, '.', l_suppkey % 256) END,
           '.', (l_orderkey * 7) % 256, CASE WHEN l_partkey % 19 IN (6, 8, 9, 13, 14, 15) THEN '' ELSE concat('.', l_linenumber * 43 % 256) END, CASE WHEN l_partkey % 19 IN (0, 1, 10) THEN concat('.', CASE WHEN l_orderkey % 5 = 0 THEN '256' WHEN l_orderkey % 5 = 1 THEN '01' ELSE '9' END) ELSE '' END) AS address FROM lineitem"""


def _of(sql, name):
    return lambda spark, sf_dir: spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def _filter(spark, sf_dir):
    return files.file_filter(_of(_ENTRIES, "part")(spark, sf_dir)).select("id", F.coalesce("reason", F.lit("")).alias("reason"))


def _specs(spark, sf_dir):
    owner, name = files.repository(F.col("spec"))
    return _of(_SPECS, "part")(spark, sf_dir).select("id", F.coalesce(F.concat(owner, F.lit("/"), name), F.lit("")).alias("repository"))


def _citations(spark, sf_dir):
    parts = files.citation(F.col("text"))
    return _of(_CITATIONS, "part")(spark, sf_dir).select("id", *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in parts.items()))


def _addresses(spark, sf_dir):
    return files.address_classes(_of(_ADDRESSES, "lineitem")(spark, sf_dir)).select("id", F.coalesce("reason", F.lit("")).alias("reason"))


#: Folders of the made repositories: five below the root, four in each, and files in both kinds; odd kinds among them.
_LEAF = "CASE WHEN p_partkey % 13 = 0 THEN 'symlink' WHEN p_partkey % 17 = 0 THEN 'submodule' ELSE 'blob' END"
_A, _B = "CAST(floor(p_partkey / 5) AS BIGINT) % 5", "CAST(floor(p_partkey / 25) AS BIGINT) % 4"
_TREE_ENTRIES = f"""SELECT DISTINCT p_partkey % 5 AS repo, 'root' AS sha, false AS recursive, 10 - {_A} AS ordinal, concat('d', {_A}) AS path, 'tree' AS kind, concat('d', {_A}) AS child, 0 AS size FROM {{part}}
    UNION ALL SELECT DISTINCT p_partkey % 5, concat('d', {_A}), false, {_B}, concat('e', {_B}), 'tree', concat('d', {_A}, 'e', {_B}), 0 FROM {{part}}
    UNION ALL SELECT p_partkey % 5, concat('d', {_A}, 'e', {_B}), false, p_partkey, concat('f', p_partkey, '.py'), {_LEAF}, concat('s', p_partkey), p_size FROM {{part}}
    UNION ALL SELECT p_partkey % 5, concat('d', {_A}), false, 10 + p_partkey, concat('g', p_partkey), {_LEAF}, concat('t', p_partkey), p_size FROM {{part}} WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey % 5, 'root', true, p_partkey, concat('d', {_A}, '/e', {_B}, '/f', p_partkey, '.py'), {_LEAF}, concat('s', p_partkey), p_size FROM {{part}} WHERE p_partkey % 5 < 2"""
_LISTINGS = "SELECT DISTINCT p_partkey % 5 AS repo, 'root' AS sha, true AS recursive, p_partkey % 5 >= 2 AS truncated FROM {part} UNION ALL SELECT 4, 'd3', false, true"
#: (requests, files, depth): walks that are whole, and walks that spend their requests or meet the bounds on files and depth.
_LIMITS = ((400, 5_000_000, 24), (12, 150, 1))


def _trees(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    out = []
    for n, (requests, most, depth) in enumerate(_LIMITS):
        found, report = trees.repository_files(spark.sql(_LISTINGS, part=part), spark.sql(_TREE_ENTRIES, part=part), requests, most, depth)
        lists = found.groupBy("repo").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x["path"]), ",").cast("binary"), 256).alias("paths"))
        out.append(report.join(lists, "repo", "left").withColumn("limits", F.lit(n)))
    return functools.reduce(DataFrame.unionByName, out)


def _trees_sql(n, requests, most, depth):
    return f"""SELECT * FROM (WITH RECURSIVE l AS ({_LISTINGS.format(part="part")}), e AS ({_TREE_ENTRIES.format(part="part")}), a AS (SELECT repo, truncated AS cut FROM l WHERE recursive),
        w AS (SELECT repo, 'root' AS sha, '' AS prefix, 0 AS depth, []::BIGINT[] AS way FROM a WHERE cut
              UNION ALL SELECT w.repo, e.child, prefix || e.path || '/', depth + 1, list_append(way, e.ordinal) FROM w JOIN e ON e.repo = w.repo AND e.sha = w.sha AND NOT e.recursive AND e.kind = 'tree'),
        o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY depth, way) AS k FROM w WHERE depth <= {depth}), v AS (SELECT * FROM o WHERE k <= {requests} - 1),
        f AS (SELECT v.repo, v.k, e.ordinal, prefix || e.path AS path, e.kind FROM v JOIN e ON e.repo = v.repo AND e.sha = v.sha AND NOT e.recursive
              UNION ALL SELECT e.repo, 0, e.ordinal, e.path, e.kind FROM e JOIN a ON a.repo = e.repo AND NOT a.cut WHERE e.recursive),
        b AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY k, ordinal) AS p FROM f WHERE kind = 'blob'),
        m AS (SELECT repo FROM w WHERE depth > {depth} UNION SELECT repo FROM o WHERE k > {requests} - 1 UNION SELECT repo FROM b WHERE p > {most} UNION SELECT v.repo FROM v JOIN l ON l.repo = v.repo AND l.sha = v.sha AND NOT l.recursive AND l.truncated),
        c AS (SELECT repo, count(*) FILTER (kind = 'submodule') AS submodules, count(*) FILTER (kind = 'symlink') AS symlinks FROM f GROUP BY repo),
        p AS (SELECT repo, count(*) AS files, sha256(string_agg(path, ',' ORDER BY p)) AS paths FROM b WHERE p <= {most} GROUP BY repo),
        n AS (SELECT repo, count(*) AS spent FROM v GROUP BY repo)
        SELECT a.repo, coalesce(spent, 0) + 1 AS requests, files, submodules, symlinks, a.repo IN (SELECT repo FROM m) AS truncated, cut AND a.repo NOT IN (SELECT repo FROM m) AS recovered, paths, {n} AS limits
        FROM a JOIN c USING (repo) JOIN p USING (repo) LEFT JOIN n USING (repo))"""


#: Answers for a name; every third name has a private one now and then, beyond the eighth place as a rule.
_ANSWERS = "SELECT l_suppkey AS name, l_orderkey * 10 + l_linenumber AS ordinal, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq, CASE WHEN l_suppkey % 3 = 0 AND l_partkey % 40 = 7 THEN concat('10.0.', l_linenumber, '.9') WHEN l_suppkey % 3 = 0 AND l_partkey % 40 = 9 THEN '127.0.0.1' ELSE concat('8.', l_partkey % 200, '.', l_suppkey % 100, '.', l_linenumber) END AS address FROM lineitem"


def _screened(spark, sf_dir):
    return files.screened_answers(_of(_ANSWERS, "lineitem")(spark, sf_dir).selectExpr("name", "address", "struct(seq, address) AS ordinal"))


QUERIES = {"answer_screening": _screened, "repository_tree": _trees, "file_filter": _filter, "repo_ref_parse": _specs, "citation_parse": _citations, "ip_classify": _addresses}


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _ends(column: str, values) -> str:
    return "(" + " OR ".join(f"ends_with({column}, '{v}')" for v in values) + ")"


ORACLE = {
    "answer_screening": f"""
        WITH a AS (SELECT *, CASE WHEN starts_with(address, '10.') THEN 'private' WHEN starts_with(address, '127.') THEN 'loopback' END AS r FROM ({_ANSWERS})),
        b AS (SELECT name, arg_min(r, (seq, address)) AS reason FROM a WHERE r IS NOT NULL GROUP BY name),
        k AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY seq, address)::INT AS position, address FROM a WHERE name NOT IN (SELECT name FROM b))
        SELECT name, NULL AS reason, position, address FROM k WHERE position <= 8 UNION ALL SELECT name, reason, NULL, NULL FROM b""",
    "repository_tree": " UNION ALL ".join(_trees_sql(n, *limits) for n, limits in enumerate(_LIMITS)),
    "file_filter": f"""
        WITH e AS ({_ENTRIES}), s AS (SELECT *, string_split(lower(path), '/') AS p FROM e), n AS (SELECT *, p[-1] AS name, p[1:-2] AS dirs, regexp_extract(p[-1], '^.+(\\.[^.]*)$', 1) AS ext FROM s)
        SELECT id, CASE WHEN mode = '160000' THEN 'submodule' WHEN mode = '120000' THEN 'symlink'
            WHEN path = '' OR starts_with(path, '/') OR len(list_filter(p, lambda x: x IN ('', '.', '..'))) > 0 THEN 'unsafe_path' WHEN type <> 'blob' THEN 'not_a_file'
            WHEN name IN {_in(files.SECRET_NAMES)} OR ext IN {_in(files.SECRET_EXTENSIONS)} OR (starts_with(name, '.env') AND NOT {_ends("name", files.TEMPLATE_SUFFIXES)}) THEN 'secret'
            WHEN len(list_filter(dirs, lambda x: x IN {_in(files.VENDORED_DIRECTORIES)})) > 0 THEN 'vendored'
            WHEN len(list_filter(dirs, lambda x: x IN {_in(files.GENERATED_DIRECTORIES)})) > 0 OR name IN {_in(files.GENERATED_NAMES)} OR {_ends("name", files.GENERATED_SUFFIXES)} THEN 'generated'
            WHEN ext IN {_in(files.BINARY_EXTENSIONS)} THEN 'binary' WHEN size > 524288 THEN 'too_large' ELSE '' END AS reason FROM n""",
    "repo_ref_parse": rf"""
        WITH e AS (SELECT id, trim(spec) AS s FROM ({_SPECS})),
        r AS (SELECT id, s, CASE WHEN regexp_matches(s, '^[^@\s/]+@(www\.)?github\.com:.') THEN regexp_extract(s, ':(.+)$', 1) WHEN regexp_matches(s, '^https?://(www\.)?github\.com(:\d+)?/[^?#]+$') THEN regexp_extract(s, '^https?://[^/]+/(.+)$', 1)
                     WHEN regexp_matches(s, '^(?i)(www\.)?github\.com/.') THEN regexp_extract(s, '^[^/]+/(.+)$', 1) WHEN regexp_matches(s, '^[^/:@?#]+/[^:@?#]+$') THEN s ELSE '' END AS rest FROM e),
        p AS (SELECT id, string_split(regexp_replace(regexp_replace(rest, '^/+|/+$', '', 'g'), '\.git$', ''), '/') AS p, contains(s, ' ') OR contains(s, chr(92)) AS bad FROM r)
        SELECT id, CASE WHEN NOT bad AND len(p) = 2 AND length(p[1]) <= 39 AND regexp_matches(p[1], '^[A-Za-z0-9]+(-[A-Za-z0-9]+)*$') AND regexp_matches(p[2], '^[A-Za-z0-9._-]{{1,100}}$') AND p[2] NOT IN ('.', '..') THEN p[1] || '/' || p[2] ELSE '' END AS repository FROM p""",
    "citation_parse": rf"""
        WITH e AS (SELECT id, trim(text) AS t FROM ({_CITATIONS})),
        c AS (SELECT id, t, string_split(split_part(t, '#', 1), '@') AS head, split_part(t, '#', 2) AS tail FROM e),
        r AS (SELECT id, t, head[1] AS repo, head[2] AS rest, try_cast(regexp_extract(tail, '^L(\d+)', 1) AS INT) AS low, coalesce(try_cast(regexp_extract(tail, '-L(\d+)$', 1) AS INT), try_cast(regexp_extract(tail, '^L(\d+)', 1) AS INT)) AS high, tail FROM c),
        k AS (SELECT *, substr(rest, 42) AS path, regexp_matches(t, '^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+@[0-9a-f]{{40}}/[^#]+#L\d+(-L\d+)?$') AND low >= 1 AND high >= low AND len(list_filter(string_split(substr(rest, 42), '/'), lambda x: x IN ('', '..'))) = 0 AS is_repo,
                     regexp_matches(t, '^https?://[^\s#]+#[A-Za-z0-9._-]+@\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\dZ$') AND try_cast(replace(replace(split_part(t, '@', 2), 'T', ' '), 'Z', '') AS TIMESTAMP) IS NOT NULL AS is_web FROM r)
        SELECT id, CASE WHEN is_repo THEN 'repo' WHEN is_web THEN 'web' ELSE '' END AS kind, CASE WHEN is_repo THEN repo WHEN is_web THEN split_part(t, '#', 1) ELSE '' END AS target, CASE WHEN is_repo THEN path WHEN is_web THEN split_part(tail, '@', 1) ELSE '' END AS part,
               CASE WHEN is_repo THEN low::VARCHAR ELSE '' END AS start_line, CASE WHEN is_repo THEN high::VARCHAR ELSE '' END AS end_line FROM k""",
    "ip_classify": rf"""
        WITH e AS ({_ADDRESSES}), p AS (SELECT id, address, string_split(address, '.') AS p FROM e),
        n AS (SELECT id, address, CASE WHEN len(p) = 4 AND len(list_filter(p, lambda x: regexp_matches(x, '^(0|[1-9]\d*)$') AND x::INT <= 255)) = 4 THEN p[1]::BIGINT * 16777216 + p[2]::BIGINT * 65536 + p[3]::BIGINT * 256 + p[4]::BIGINT END AS n FROM p)
        SELECT id, CASE WHEN n IS NULL THEN 'reserved' WHEN address IN ('169.254.169.254', '169.254.169.253', '169.254.170.2', '169.254.170.23', '100.100.100.200') THEN 'cloud_metadata' WHEN n = 0 THEN 'unspecified' WHEN n // 16777216 = 127 THEN 'loopback' WHEN n // 65536 = 43518 THEN 'link_local'
            WHEN n // 268435456 = 14 THEN 'multicast' WHEN n // 4194304 = 401 THEN 'carrier_grade_nat' WHEN n // 268435456 = 15 THEN 'reserved' WHEN n IN (3221225481, 3221225482) THEN ''
            WHEN n // 16777216 IN (0, 10) OR n // 1048576 = 2753 OR n // 256 IN (12582912, 12582914, 12989284, 13303921) OR n // 65536 = 49320 OR n // 131072 = 25353 THEN 'private' ELSE '' END AS reason FROM n""",
}
