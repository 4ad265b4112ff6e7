"""Queries on robots files, sitemaps, host names, admission and crawl budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import crawl
from docquarry.plans.urls import canonical_ctes
from docquarry.sources.stage import Stage
from docquarry.sources.store import ContentStore
from docquarry.sources.tables import table

_AGENT = "docbot"
_FILES = """SELECT p_partkey AS host, CASE CAST(p_partkey % 11 AS INT) WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 2 THEN NULL ELSE 200 END AS status,
    concat('Disallow: /early', chr(10), 'Sitemap: http://h.example/s.xml # all', chr(10), 'User-Agent: ', CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'Doc' WHEN 1 THEN 'DocBot' ELSE 'other' END, chr(13), chr(10),
           CASE WHEN p_partkey % 2 = 0 THEN concat('user-agent: *', chr(10)) ELSE '' END, 'Disallow: /a', p_partkey, ' # why', chr(10), 'Allow:', chr(10), 'nonsense', chr(10), 'Crawl-delay: 2', chr(10),
           'user-agent: *', chr(10), 'sitemap: x', chr(10), 'user-agent: docb', chr(10), 'Allow : /b*', chr(10), 'Disallow: /c$') AS body FROM part"""
_SITEMAPS = """SELECT page_id AS sitemap_id, concat('<?xml version="1.0"?>', CASE WHEN page_id % 9 = 0 THEN '<!DOCTYPE x>' ELSE '' END, '<urlset xmlns="http://s.example">',
    '<url><loc> ', url, ' </loc><lastmod>2024-0', page_id % 12, '-05</lastmod><priority>0.', page_id % 10, '</priority></url>',
    '<s:url><s:loc>HTTP://H.example/a?b=1&amp;a=', page_id % 4, '</s:loc><s:priority>1.5</s:priority></s:url>', '<url><loc>ftp://h.example/</loc></url>', '<url><priority>1</priority></url>',
    '<url><loc>http://h.example/a?a=', page_id % 3, '&amp;b=1</loc><lastmod>2024-03-04T10:30:00Z</lastmod></url>', '</urlset>') AS xml FROM pages"""
_HOSTS = "SELECT p_partkey AS host_id, CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN concat('h', p_partkey, '.example') WHEN 1 THEN concat('H', p_partkey, '.LOCAL.') WHEN 2 THEN concat('h', p_partkey) WHEN 3 THEN concat('10.0.0.', p_partkey % 256) WHEN 4 THEN 'x.home.arpa' WHEN 5 THEN '::1' WHEN 6 THEN ' localhost ' ELSE '' END AS host FROM part"
_CANDIDATES = "SELECT l_suppkey AS crawl, l_orderkey * 10 + l_linenumber AS seq, concat('u', l_partkey % 300) AS url, CAST(l_orderkey % 5 AS INT) AS depth, l_partkey % 7 <> 0 AS in_scope, l_partkey % 11 <> 0 AS allowed FROM lineitem"
_VISITS = """SELECT l_suppkey AS crawl, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_partkey % 13 = 0 THEN 'blocked' WHEN l_partkey % 17 = 0 THEN 'reset' END AS fault,
    CASE WHEN l_partkey % 5 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN l_orderkey % 6 = 0 THEN 'application/pdf' ELSE 'text/html' END AS media_type, l_partkey % 19 = 0 AS noindex,
    CAST(l_quantity AS BIGINT) * 1000 AS bytes, concat(l_partkey, '-', CAST(l_extendedprice * 100 AS BIGINT)) AS url, CAST(l_orderkey % 1000 AS DOUBLE) * 0.1 * (l_suppkey % 4) AS elapsed FROM lineitem"""


def _sql(spark, sf_dir, sql):
    name = sql.rsplit(" FROM ", 1)[1].split()[0]
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


_INDEXES = """SELECT page_id AS sitemap_id, concat('<sitemapindex><sitemap><loc>', url, '</loc></sitemap><x:sitemap><x:loc> http://h.example/s', page_id % 3, '.xml?a=1&amp;b=2 </x:loc></x:sitemap><sitemap><loc>ftp://x/</loc></sitemap><sitemap><loc>HTTP://h.example/s',
    page_id % 2, '.xml?b=2&amp;a=1</loc></sitemap></sitemapindex>') AS xml FROM pages"""
#: A site of 400 pages a host, each with five links, some of them beside the scope, disallowed, or not to be followed.
_SITE = """SELECT concat('http://h', p_partkey % 5, '.example/docs/p', p_partkey) AS url, concat(CASE WHEN p_partkey % 29 = 0 THEN '<meta name=robots content=nofollow>' WHEN p_partkey % 23 = 0 THEN '<meta name=robots content=noindex>' ELSE '' END,
    '<a href="p', (p_partkey * 7 + 5) % 2000, '">a</a><a href="/docs/p', p_partkey * 3 % 2000, '">b</a><a href="../about">c</a><a href="private/p', p_partkey, '">d</a><a rel=nofollow href="p0">e</a><a href="./p', p_partkey + 5, '">f</a>') AS html,
    CASE WHEN p_partkey % 17 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN p_partkey % 19 = 0 THEN 'application/pdf' ELSE 'text/html' END AS media_type FROM part"""
_SEEDS = "VALUES (0L, 'http://h0.example/docs/p5', 'seed', 0), (0L, 'http://h0.example/docs/p10', 'sitemap', 1), (1L, 'http://h1.example/docs/p6', 'seed', 0), (2L, 'http://h2.example/docs/p2#x', 'seed', 0), (2L, 'http://h2.example/other', 'sitemap', 1)"


_OUTCOMES = "SELECT o_custkey % 40 AS crawl, o_orderkey AS seq, CASE CAST(o_custkey % 7 AS INT) WHEN 0 THEN 'client_rendered' WHEN 1 THEN 'too_short' WHEN 2 THEN 'empty' ELSE 'sufficient' END AS outcome FROM orders"
#: Robots files of the made site: two sitemaps, one of them elsewhere; one named twice; none.
_ROBOTS = """SELECT DISTINCT concat('h', p_partkey % 5, '.example') AS host, 200 AS status, CASE CAST(p_partkey % 5 AS INT)
    WHEN 0 THEN concat('Sitemap: http://h0.example/maps/index.xml # all', chr(10), 'sitemap:http://other.example/s.xml', chr(10), 'User-agent: *', chr(10), 'Disallow: /docs/private', chr(10), 'SITEMAP : http://h0.example/maps/part29.xml')
    WHEN 1 THEN concat('User-agent: *', chr(10), 'Disallow: /*9$', chr(10), 'Sitemap: http://h1.example/maps/part3.xml', chr(13), chr(10), 'Sitemap: HTTP://H1.example:80/maps/part3.xml') ELSE 'User-agent: docbot' END AS body FROM part"""
#: What each sitemap lists, a row a line: indexes list parts, themselves and another site's; parts list pages, in the scope and beside it.
_LISTED = """SELECT DISTINCT concat('http://h', h, '.example', CASE WHEN h = 0 THEN '/maps/index.xml' ELSE '/sitemap.xml' END) AS url, true AS is_index, j AS place,
        concat('http://', CASE WHEN j % 7 = 6 THEN 'other' ELSE concat('h', h) END, '.example', CASE WHEN j % 11 = 10 THEN CASE WHEN h = 0 THEN '/maps/index.xml' ELSE '/sitemap.xml' END ELSE concat('/maps/part', j, '.xml') END) AS loc
    FROM (SELECT p_partkey % 5 AS h, p_partkey % 40 AS j FROM {part}) AS a WHERE h IN (0, 2, 3)
    UNION ALL SELECT concat('http://h', p_partkey % 5, '.example/maps/part', p_partkey % 26, '.xml'), false, p_partkey, concat('http://h', p_partkey % 5, '.example/', CASE WHEN p_partkey % 31 = 0 THEN 'blog' ELSE 'docs' END, '/p', p_partkey * 3 % 2000) FROM {part}"""


def site_files(spark, sf_dir):
    """(answers with sitemaps and seconds, robots files, seeds) of the made site."""
    listed = spark.sql(_LISTED, part=table(spark, sf_dir, "part"))
    lines = listed.groupBy("url", "is_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "loc"))), lambda x: F.concat(F.when(F.col("is_index"), "<sitemap><loc>").otherwise("<url><loc>"), x["loc"], F.when(F.col("is_index"), "</loc></sitemap>").otherwise("</loc></url>"))), "").alias("_x"))
    maps = lines.select("url", F.concat(F.when(F.col("is_index"), "<sitemapindex>").otherwise("<urlset>"), "_x", F.when(F.col("is_index"), "</sitemapindex>").otherwise("</urlset>")).alias("html"), F.lit(200).alias("status"), F.lit("text/xml").alias("media_type"))
    answers = _sql(spark, sf_dir, _SITE).unionByName(maps).withColumn("seconds", F.length("url") % 4 * F.lit(0.25))
    seeds = spark.sql("SELECT * FROM VALUES (0L, 'http://h0.example/docs/p5'), (1L, 'http://h1.example/docs/p6'), (2L, 'http://h2.example/docs/p2#x'), (4L, 'http://h4.example/docs/p4') AS t(crawl, url)")
    return answers, _sql(spark, sf_dir, _ROBOTS), seeds


def _discovery(spark, sf_dir):
    answers, robots, seeds = site_files(spark, sf_dir)
    taken, entries = crawl.sitemap_discovery(answers, robots, seeds.withColumn("via", F.lit("seed")))
    return taken.select(F.lit("sitemap").alias("kind"), "crawl", F.col("position").alias("place"), "url").unionByName(entries.select(F.lit("entry").alias("kind"), "crawl", F.col("ordinal").alias("place"), "url"))


def site(spark, sf_dir):
    """(answers, seeds, robots rules) of the made site."""
    rules = spark.sql("SELECT * FROM VALUES ('h0.example', '/docs/private', false), ('h1.example', '/*9$', false), ('h1.example', '/docs/private/p1', true), ('h1.example', '/docs/private', false) AS t(host, pattern, allow)")
    return _sql(spark, sf_dir, _SITE), spark.sql(f"SELECT * FROM {_SEEDS} AS t(crawl, url, via, ordinal)"), rules


def _store(spark, sf_dir):
    """Contents offered twice, the second time beside others, are kept once."""
    store = ContentStore(spark, Stage(spark, "store").folder + "/contents")
    pages = table(spark, sf_dir, "pages")
    store.put(pages.where("page_id % 2 = 0"), F.col("html"))
    held = store.put(pages, F.col("html"))
    return store.contents().join(held.groupBy("sha256").count(), "sha256").select("sha256", "size", F.col("count").alias("holders"))


QUERIES = {
    "site_crawl": lambda spark, sf_dir: crawl.site_crawl(*site(spark, sf_dir), max_pages=60, max_frontier=150),
    "site_crawl_sitemaps": lambda spark, sf_dir: crawl.crawl_sites(*site_files(spark, sf_dir), max_pages=60, max_frontier=150, max_bytes=20_000, seconds=40.0),
    "sitemap_discovery": _discovery,
    "render_gate": lambda spark, sf_dir: crawl.render_gate(_sql(spark, sf_dir, _OUTCOMES)),
    "sitemap_children": lambda spark, sf_dir: crawl.sitemap_children(_sql(spark, sf_dir, _INDEXES)),
    "content_store": _store,
    "robots_rules": lambda spark, sf_dir: crawl.robots_rules(_sql(spark, sf_dir, _FILES), f"{_AGENT}/1.0"),
    "sitemap_entries": lambda spark, sf_dir: crawl.sitemap_entries(_sql(spark, sf_dir, _SITEMAPS)).withColumn("lastmod", F.coalesce(F.date_format("lastmod", "yyyy-MM-dd HH:mm:ss"), F.lit(""))),
    "hostname_class": lambda spark, sf_dir: _sql(spark, sf_dir, _HOSTS).select("host_id", F.coalesce(crawl.hostname_reason(F.col("host")), F.lit("")).alias("reason")),
    "route_verdict": lambda spark, sf_dir: _sql(spark, sf_dir, _HOSTS).select("host_id", crawl.route_verdict(F.col("host_id") % 5 != 0, F.col("host_id") % 7 != 0, crawl.hostname_reason(F.col("host"))).alias("verdict")),
    "crawl_admission": lambda spark, sf_dir: crawl.admission(_sql(spark, sf_dir, _CANDIDATES), max_frontier=120),
    "crawl_budget": lambda spark, sf_dir: crawl.visits(_sql(spark, sf_dir, _VISITS), max_pages=150, max_bytes=3_000_000, seconds=200.0),
}

_REASON = "CASE WHEN NOT (regexp_matches(n, '^\\d{1,3}(\\.\\d{1,3}){3}$') OR contains(n, ':')) AND (n IN ('', 'localhost') OR NOT contains(n, '.') OR " + " OR ".join(f"ends_with(n, '{s}')" for s in crawl.PRIVATE_SUFFIXES) + ") THEN 'private_hostname' ELSE '' END"
_NAMES = f"h AS ({_HOSTS}), n AS (SELECT host_id, lower(regexp_replace(trim(host), '\\.+$', '')) AS n FROM h), r AS (SELECT host_id, {_REASON} AS reason FROM n)"

ORACLE = {
    "content_store": "SELECT sha256(html) AS sha256, octet_length(encode(any_value(html)))::BIGINT AS size, count(*) AS holders FROM pages GROUP BY 1",
    "render_gate": f"""
        WITH o AS ({_OUTCOMES}), n AS (SELECT *, outcome IN ('client_rendered', 'too_short') AS w FROM o)
        SELECT crawl, seq, w AND sum(w::INT) OVER (PARTITION BY crawl ORDER BY seq ROWS UNBOUNDED PRECEDING) <= 25 AS render FROM n""",
    "sitemap_discovery": f"""
        WITH RECURSIVE listed AS ({_LISTED.format(part="part")}),
        children AS (SELECT url AS parent, list(loc ORDER BY place) AS c FROM listed WHERE is_index GROUP BY url),
        start(crawl, host, pending) AS (VALUES (0, 'http://h0.example/', ['http://h0.example/maps/index.xml', 'http://other.example/s.xml', 'http://h0.example/maps/part29.xml']), (1, 'http://h1.example/', ['http://h1.example/maps/part3.xml', 'http://h1.example/maps/part3.xml']),
            (2, 'http://h2.example/', ['http://h2.example/sitemap.xml']), (4, 'http://h4.example/', ['http://h4.example/sitemap.xml'])),
        q AS (SELECT crawl, host, []::VARCHAR[] AS visited, pending, 0 AS step FROM start
              UNION ALL SELECT crawl, host, CASE WHEN skip THEN visited ELSE list_append(visited, pending[1]) END, pending[2:] || CASE WHEN skip THEN []::VARCHAR[] ELSE coalesce(c, []::VARCHAR[]) END, step + 1
              FROM (SELECT *, list_contains(visited, pending[1]) OR NOT starts_with(pending[1], host) AS skip FROM q WHERE len(pending) > 0 AND len(visited) < 20) s LEFT JOIN children ON parent = pending[1]),
        v AS (SELECT crawl, generate_subscripts(visited, 1) AS place, unnest(visited) AS url FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY crawl ORDER BY step DESC) = 1)),
        e AS (SELECT crawl, loc, min(v.place * 1000000000 + l.place) AS first FROM v JOIN listed l USING (url) WHERE NOT is_index GROUP BY ALL)
        SELECT 'sitemap' AS kind, crawl::BIGINT AS crawl, place::INT AS place, url FROM v UNION ALL SELECT 'entry', crawl::BIGINT, (row_number() OVER (PARTITION BY crawl ORDER BY first) - 1)::INT, loc FROM e""",
    "sitemap_children": f"""
        WITH l AS (SELECT page_id, 0 AS variant, url FROM pages UNION ALL SELECT page_id, 1, 'http://h.example/s' || page_id % 3 || '.xml?a=1&b=2' FROM pages UNION ALL SELECT page_id, 3, 'HTTP://h.example/s' || page_id % 2 || '.xml?b=2&a=1' FROM pages),
        {canonical_ctes("SELECT page_id, variant, url FROM l")}, x AS (SELECT page_id, canonical, min(variant) AS v FROM shown WHERE ok GROUP BY ALL)
        SELECT page_id AS sitemap_id, (row_number() OVER (PARTITION BY page_id ORDER BY v) - 1)::INT AS ordinal, canonical FROM x""",
    "robots_rules": rf"""
        WITH f AS ({_FILES}), l AS (SELECT host, generate_subscripts(s, 1) - 1 AS line, regexp_replace(unnest(s), '#.*$', '') AS raw FROM (SELECT host, regexp_split_to_array(body, '\r\n|\r|\n') AS s FROM f WHERE status BETWEEN 200 AND 299)),
        n AS (SELECT host, line, lower(trim(split_part(raw, ':', 1))) AS field, trim(substr(raw, instr(raw, ':') + 1)) AS value FROM l WHERE contains(raw, ':')),
        k AS (SELECT *, CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER w, '') <> 'user-agent' THEN 1 ELSE 0 END AS s FROM n WHERE field <> 'sitemap' WINDOW w AS (PARTITION BY host ORDER BY line)),
        g AS (SELECT *, sum(s) OVER (PARTITION BY host ORDER BY line) AS g FROM k),
        a AS (SELECT host, g, CASE WHEN value = '*' THEN -1 ELSE length(value) END AS n FROM g WHERE field = 'user-agent' AND g > 0 AND (value = '*' OR starts_with('{_AGENT}', lower(value)))),
        c AS (SELECT host, g FROM a QUALIFY row_number() OVER (PARTITION BY host ORDER BY n DESC, g) = 1)
        SELECT host, line::INT AS line, value AS pattern, field = 'allow' AS allow FROM g JOIN c USING (host, g) WHERE field IN ('allow', 'disallow') AND value <> ''
        UNION ALL SELECT host, 0, '/', false FROM f WHERE status IS NULL OR status >= 500""",
    "sitemap_entries": f"""
        WITH x AS (SELECT page_id, page_id % 12 AS d, page_id % 10 AS p, url FROM pages WHERE page_id % 9 <> 0),
        l AS (SELECT page_id, 0 AS variant, url, CASE WHEN d BETWEEN 1 AND 9 THEN '2024-0' || d || '-05 00:00:00' ELSE '' END AS lastmod, ('0.' || p)::DOUBLE AS priority FROM x
              UNION ALL SELECT page_id, 1, 'HTTP://H.example/a?b=1&a=' || page_id % 4, '', NULL FROM x UNION ALL SELECT page_id, 4, 'http://h.example/a?a=' || page_id % 3 || '&b=1', '2024-03-04 10:30:00', NULL FROM x),
        {canonical_ctes("SELECT page_id, variant, url, lastmod, priority FROM l")},
        k AS (SELECT * FROM shown WHERE ok QUALIFY row_number() OVER (PARTITION BY page_id, canonical ORDER BY variant) = 1)
        SELECT page_id AS sitemap_id, (row_number() OVER (PARTITION BY page_id ORDER BY variant) - 1)::INT AS ordinal, canonical, lastmod, priority FROM k""",
    "hostname_class": f"WITH {_NAMES} SELECT host_id, reason FROM r",
    "route_verdict": f"WITH {_NAMES} SELECT host_id, CASE WHEN host_id % 5 = 0 THEN 'bad_scheme' WHEN host_id % 7 = 0 THEN 'out_of_scope' WHEN reason <> '' THEN 'blocked' ELSE 'in_scope' END AS verdict FROM r",
    "crawl_admission": f"""
        WITH c AS ({_CANDIDATES}), j AS (SELECT *, CASE WHEN NOT in_scope THEN 'out_of_scope' WHEN NOT allowed THEN 'robots_disallowed' WHEN depth > 3 THEN 'max_depth' END AS r FROM c),
        f AS (SELECT crawl, url, min(seq) AS first FROM j WHERE r IS NULL GROUP BY ALL), t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY crawl ORDER BY first, url) <= 120)
        SELECT crawl, seq, url, coalesce(r, CASE WHEN first IS NULL THEN 'limit_reached' ELSE 'admitted' END) AS verdict FROM j LEFT JOIN t USING (crawl, url) WHERE r IS NOT NULL OR first IS NULL OR first = seq""",
    "crawl_budget": f"""
        WITH l AS ({_VISITS}), v AS (SELECT *, CASE WHEN fault = 'blocked' THEN 'blocked_by_guard' WHEN fault IS NOT NULL THEN 'fetch_failed' WHEN status <> 200 THEN 'unsuccessful_status' WHEN media_type <> 'text/html' THEN 'unsupported_media_type' WHEN noindex THEN 'page_noindex' ELSE 'page' END AS v FROM l),
        s AS (SELECT crawl, seq, v, coalesce(sum((v = 'page')::INT) OVER b, 0) AS pages, coalesce(sum(CASE WHEN v = 'page' THEN bytes ELSE 0 END) OVER b, 0) AS bytes, max(elapsed) OVER (PARTITION BY crawl ORDER BY seq, url ROWS UNBOUNDED PRECEDING) AS e FROM v WINDOW b AS (PARTITION BY crawl ORDER BY seq, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT crawl, seq, CASE WHEN pages >= 150 OR bytes >= 3000000 OR e > 200 THEN 'not_visited' ELSE v END AS verdict FROM s""",
}
