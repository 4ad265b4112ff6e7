"""Queries on addresses and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import urls
from docquarry.sources.tables import table

#: Table addresses, and variants that the table lacks.
_URLS = """
    SELECT page_id, 0 AS variant, url FROM pages
    UNION ALL SELECT page_id, 1, concat('HTTPS://User.Example.COM.:443/a/./b/../c//', page_id, '?b=2&utm_source=x&a=1&gclid=z#top') FROM pages
    UNION ALL SELECT page_id, 2, concat('http://u:p@h.example/', page_id) FROM pages WHERE page_id % 3 = 0
    UNION ALL SELECT page_id, 3, concat('http://h.example:8443/x/../../', page_id, '/?&&_ga=1') FROM pages WHERE page_id % 3 = 1
    UNION ALL SELECT page_id, 4, 'ftp://h.example/' FROM pages WHERE page_id % 5 = 0"""


def _urls(spark, sf_dir):
    return urls.canonical(spark.sql(_URLS.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages")))


def _canonical(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", "variant", "ok", F.coalesce("canonical", F.lit("")).alias("canonical"))


_SCOPES = "VALUES ('all', 'https', 443, 'example.net', '/', true), ('en', 'https', 443, 'tionsh.example.net', '/en/', false), ('com', 'https', 443, 'example.com', '/a/', true)"


def _scope(spark, sf_dir):
    scopes = spark.sql(f"SELECT * FROM {_SCOPES} AS t(scope, s_scheme, s_port, s_host, s_prefix, s_sub)")
    return urls.in_scope(_urls(spark, sf_dir), scopes).select("page_id", "variant", "scope")


#: References with dot segments, percent codes, queries without values, other schemes and hosts, against each page's address.
_REFS = """VALUES (0, '../x%7Ey/%2e%2E/z%2fq?b=%7E&a-b=1&a=1&x'), (1, '//Other.Example/a b'), (2, '?q=ü&utm_id=3'), (3, ''), (4, 'sub/./page#frag'), (5, '/abs/ä%zz%'), (6, 'https://h.example/%41%c3%a9'), (7, 'mailto:x@h.example'), (8, '  /trim  '), (9, '?%67clid=1&b%3d=2')"""


def _refs(spark, sf_dir):
    each = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("base")).join(spark.sql(f"SELECT * FROM {_REFS} AS t(variant, ref)").hint("broadcast"), F.lit(True))
    found = urls.canonical(each.withColumn("url", urls.absolute(F.trim("ref"), F.col("base"))))
    return found.select("page_id", "variant", F.coalesce("canonical", F.lit("")).alias("canonical"))


#: Pages with a base, odd quoting, nofollow, and robots tags, which the table lacks.
_HTML = """concat(CASE CAST(page_id % 5 AS INT) WHEN 0 THEN '<base href="/up/dir/">' WHEN 1 THEN '<META name=Robots content="NoIndex, follow">' WHEN 2 THEN '<meta content=none name="docbot">' WHEN 3 THEN '<meta name="robots" content="nofollow">' ELSE '' END,
    '<a href=plain>p</a><a rel="x nofollow" href="/no">n</a><a HREF=''../q?b=2&a=1''>q</a><a href="/no-nofollow" rel=nofollows>r</a>', html)"""


def _marked(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{_HTML} AS html")


def _main(spark, sf_dir):
    text = urls.main_content(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.cast("binary"), 256).alias("digest"), F.length(text).alias("main_chars"))


QUERIES = {
    "url_normalize": _refs,
    "link_targets": lambda spark, sf_dir: urls.link_targets(_marked(spark, sf_dir)),
    "robots_meta": lambda spark, sf_dir: urls.robots_meta(_marked(spark, sf_dir), "docbot"),
    "main_content": _main,
    "url_canonicalize": _canonical,
    "url_scope_filter": _scope,
    "link_extract": lambda spark, sf_dir: urls.links(table(spark, sf_dir, "pages")),
    "html_stats": lambda spark, sf_dir: urls.html_stats(table(spark, sf_dir, "pages")).drop("outcome", "main_chars"),
    "extract_outcome": lambda spark, sf_dir: urls.html_stats(table(spark, sf_dir, "pages")).select("page_id", "outcome"),
}

_TRACKED = ", ".join(f"'{t}'" for t in urls.TRACKING)


def _percent(value: str, safe: str) -> str:
    """DuckDB SQL: percent codes of ``value`` in one spelling."""
    safe = safe.replace("'", "''")
    code = "chr(CAST('0x' || substr(t, 2, 2) AS INT))"
    one = f"CASE WHEN regexp_matches(t, '^%..$') THEN CASE WHEN regexp_matches({code}, '^[A-Za-z0-9._~-]$') THEN {code} ELSE upper(t) END WHEN regexp_matches(t, '^[{safe}]+$') THEN t ELSE regexp_replace(hex(encode(t)), '(..)', '%\\1', 'g') END"
    return f"array_to_string(list_transform(regexp_extract_all({value}, '%[0-9A-Fa-f]{{2}}|[{safe}]+|(?s:.)'), lambda t: {one}), '')"


def canonical_ctes(source: str) -> str:
    """CTEs, the last named ``shown``, that bring the addresses of a query with a column ``url`` to canonical form."""
    key, value = _percent("split_part(s, '=', 1)", urls.QUERY_SAFE), _percent("substr(s, length(split_part(s, '=', 1)) + 2)", urls.QUERY_SAFE)
    return rf"""
    u AS ({source}),
    p AS (SELECT *, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['s', 'a', 'p', 'q']) AS m FROM u),
    c AS (SELECT *, {_percent("m.p", urls.PATH_SAFE)} AS plain FROM p),
    h AS (SELECT *, lower(m.s) AS scheme, regexp_replace(lower(regexp_replace(m.a, ':\d*$', '')), '\.+$', '') AS host, regexp_extract(m.a, ':(\d+)$', 1) AS port_text,
                 list_filter(string_split(plain, '/'), lambda s: s NOT IN ('', '.')) AS kept FROM c),
    f AS (SELECT *, CASE WHEN port_text = '' THEN CASE WHEN scheme = 'https' THEN 443 ELSE 80 END ELSE try_cast(port_text AS INT) END AS port,
                 CASE WHEN len(kept) = 0 THEN []::VARCHAR[] ELSE list_reduce(list_prepend([]::VARCHAR[], list_transform(kept, lambda s: [s])), lambda a, s: CASE WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] ELSE list_concat(a, s) END) END AS folded FROM h),
    named AS (SELECT *, list_transform(list_filter(string_split(m.q, '&'), lambda s: s <> ''), lambda s: {{'k': {key}, 'e': CASE WHEN contains(s, '=') THEN '=' ELSE '' END, 'v': {value}}}) AS named FROM f),
    o AS (SELECT *, '/' || array_to_string(folded, '/') || CASE WHEN regexp_matches(plain, '/$') AND len(folded) > 0 THEN '/' ELSE '' END AS path,
                 array_to_string(list_transform(list_sort(list_filter(named, lambda x: lower(x.k) NOT IN ({_TRACKED}) AND NOT starts_with(lower(x.k), 'utm_'))), lambda x: x.k || x.e || x.v), '&') AS query,
                 coalesce(length(trim(url)) <= 2048 AND scheme IN ('http', 'https') AND NOT contains(m.a, '@') AND regexp_matches(host, '^[a-z0-9_\-]{{1,63}}(\.[a-z0-9_\-]{{1,63}})*$') AND port BETWEEN 1 AND 65535, false) AS ok FROM named),
    shown AS (SELECT *, CASE WHEN ok THEN scheme || '://' || host || CASE WHEN port = CASE WHEN scheme = 'https' THEN 443 ELSE 80 END THEN '' ELSE ':' || port END || path || CASE WHEN query = '' THEN '' ELSE '?' || query END ELSE '' END AS canonical FROM o)"""


_SHAPE = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(?:#.*)?$"


def _absolute(ref: str, base: str) -> str:
    """DuckDB SQL: ``ref`` resolved against ``base``."""
    r, b = (lambda k, c=c: f"regexp_extract({c}, '{_SHAPE}', {k})" for c in (ref, base))
    folder = f"CASE WHEN regexp_extract({b(3)}, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({b(3)}, '(?s)^(.*/)', 1) END"
    return f"""CASE WHEN {r(1)} <> '' THEN {r(1)} || {r(2)} || {r(3)} || {r(4)} WHEN {r(2)} <> '' THEN {b(1)} || {r(2)} || {r(3)} || {r(4)}
        WHEN {r(3)} = '' THEN {b(1)} || {b(2)} || {b(3)} || CASE WHEN {r(4)} <> '' THEN {r(4)} ELSE {b(4)} END
        WHEN starts_with({r(3)}, '/') THEN {b(1)} || {b(2)} || {r(3)} || {r(4)} ELSE {b(1)} || {b(2)} || {folder} || {r(3)} || {r(4)} END"""


def _attr(tag: str, name: str) -> str:
    shape = rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\s>\"'']+))"
    return "(" + " || ".join(f"coalesce(regexp_extract({tag}, '{shape}', {k}), '')" for k in (1, 2, 3)) + ")"


def _main_sql(html: str) -> str:
    """DuckDB SQL: the main content of a page as Markdown, by removing and replacing markup step by step."""
    cut = lambda x, pattern, into: f"regexp_replace({x}, '{pattern}', '{into}', 'g')"
    step = cut(html, "(?s)<!--.*?-->", "")
    for tag in ("script", "style", "noscript", "template", "svg", "iframe", "title"):
        step = cut(step, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    rest = "s0"
    for tag in ("nav", "header", "footer", "aside", "form", "button", "figure"):
        rest = cut(rest, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    inner = lambda tag: f"nullif(regexp_extract(s0, '(?is)<{tag}\\b[^>]*>(.*)</{tag}\\s*>', 1), '')"
    text = cut("s1", r"\s+", " ")
    for level in range(1, 7):
        text = cut(text, rf"(?i)<h{level}\b[^>]*>", "\n\n" + "#" * level + " ")
    for pattern, into in ((r"<li\b[^>]*>", "\n- "), (r"<br\b[^>]*>", "\n"), (r"<t[dh]\b[^>]*>", "| "), (r"</?(?:p|div|section|article|table|ul|ol|tr|pre|blockquote|h[1-6])\b[^>]*>", "\n\n"), (r"</?code\b[^>]*>", "`"), (r"<[^>]*>", "")):
        text = cut(text, f"(?i){pattern}", into)
    for name, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{character}')"
    lines = rf"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: NOT regexp_matches(x, '^(#*|-|\|)$'))"
    return f"""m0 AS (SELECT *, {step} AS s0 FROM pages), m1 AS (SELECT *, coalesce({inner("main")}, {inner("article")}, {rest}) AS s1 FROM m0),
        m2 AS (SELECT *, ltrim(array_to_string(list_transform({lines}, lambda x: CASE WHEN regexp_matches(x, '^[-|] ') THEN chr(10) ELSE chr(10) || chr(10) END || x), ''), chr(10)) AS main FROM m1)"""


_CANONICAL = canonical_ctes(_URLS)

ORACLE = {
    "url_canonicalize": f"""WITH {_CANONICAL}
        SELECT page_id, variant, ok, canonical FROM shown""",
    "url_scope_filter": f"""WITH {_CANONICAL}, s(scope, s_scheme, s_port, s_host, s_prefix, s_sub) AS ({_SCOPES})
        SELECT page_id, variant, scope FROM o JOIN s ON scheme = s_scheme AND port = s_port AND (host = s_host OR (s_sub AND ends_with(host, '.' || s_host))) AND starts_with(path, s_prefix) WHERE ok""",
    "link_extract": r"""
        WITH a AS (SELECT page_id, list_filter(list_transform(list_filter(regexp_extract_all(html, '(?i)<a\b[^>]*>'), lambda a: NOT regexp_matches(a, '(?i)\brel\s*=\s*["'']?[^"''>]*nofollow')), lambda a: trim(regexp_extract(a, '(?i)\bhref\s*=\s*["'']([^"'']*)["'']', 1))), lambda h: h <> '' AND NOT starts_with(h, '#')) AS h FROM pages),
        e AS (SELECT page_id, generate_subscripts(h, 1) AS i, unnest(h) AS href FROM a), d AS (SELECT page_id, href, min(i) AS i FROM e GROUP BY ALL),
        n AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS ordinal, href FROM d)
        SELECT * FROM n WHERE ordinal < 500""",
    "url_normalize": f"""WITH r(variant, ref) AS ({_REFS}), {canonical_ctes(f"SELECT page_id, variant, {_absolute('trim(ref)', 'pages.url')} AS url FROM pages, r")}
        SELECT page_id, variant, canonical FROM shown""",
    "link_targets": f"""WITH q AS (SELECT page_id, url AS page_url, {_HTML} AS html FROM pages), t AS (SELECT *, {_attr("regexp_extract(html, '(?i)<base[^>]*>')", 'href')} AS said FROM q),
        g AS (SELECT page_id, CASE WHEN said = '' THEN page_url ELSE {_absolute('trim(said)', 'page_url')} END AS base, list_filter(regexp_extract_all(html, '(?i)<a\\b[^>]*>'), lambda a: NOT regexp_matches(lower({_attr('a', 'rel')}), '(^|\\s)nofollow(\\s|$)')) AS a FROM t),
        e AS (SELECT page_id, base, generate_subscripts(a, 1) AS i, trim({_attr('unnest(a)', 'href')}) AS href FROM (SELECT page_id, base, a FROM g)),
        {canonical_ctes(f"SELECT page_id, i, {_absolute('href', 'base')} AS url FROM e WHERE href <> '' AND NOT starts_with(href, '#')")},
        d AS (SELECT page_id, canonical, min(i) AS i FROM shown WHERE ok GROUP BY ALL), n AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS ordinal, canonical FROM d)
        SELECT * FROM n WHERE ordinal < 500""",
    "robots_meta": f"""WITH q AS (SELECT page_id, {_HTML} AS html FROM pages),
        m AS (SELECT page_id, list_filter(regexp_extract_all(html, '(?i)<meta\\b[^>]*>'), lambda m: lower({_attr('m', 'name')}) IN ('robots', 'docbot')) AS m FROM q),
        w AS (SELECT page_id, ',' || array_to_string(list_transform(m, lambda m: regexp_replace(lower({_attr('m', 'content')}), '\\s', '', 'g')), ',') || ',' AS w FROM m)
        SELECT page_id, contains(w, ',noindex,') OR contains(w, ',none,') AS noindex, contains(w, ',nofollow,') OR contains(w, ',none,') AS nofollow FROM w""",
    "main_content": f"WITH {_main_sql('html')} SELECT page_id, sha256(main) AS digest, length(main)::INT AS main_chars FROM m2",
    "html_stats": r"""
        WITH h AS (SELECT page_id, html, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>', ' ', 'g') AS bare,
                          regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1) || regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style\s*>', 1) || regexp_extract_all(html, '(?is)<(?:noscript|template)\b[^>]*>(.*?)</(?:noscript|template)\s*>', 1) AS s FROM pages)
        SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
               length(trim(regexp_replace(regexp_replace(bare, '(?is)<!--.*?-->|<title[^>]*>.*?</title>|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))::INT AS visible_chars,
               coalesce(list_sum(list_transform(s, lambda x: length(trim(x)))), 0)::INT AS script_chars FROM h""",
    "extract_outcome": r"""
        WITH h AS (SELECT page_id, html, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>', ' ', 'g') AS bare,
                          regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1) || regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style\s*>', 1) || regexp_extract_all(html, '(?is)<(?:noscript|template)\b[^>]*>(.*?)</(?:noscript|template)\s*>', 1) AS s FROM pages),
        v AS (SELECT page_id, length(trim(regexp_replace(regexp_replace(bare, '(?is)<!--.*?-->|<title[^>]*>.*?</title>|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS v, coalesce(list_sum(list_transform(s, lambda x: length(trim(x)))), 0) AS s FROM h), """ + _main_sql("html") + """
        SELECT page_id, CASE WHEN length(main) >= 200 THEN 'sufficient' WHEN main = '' AND v = 0 AND s = 0 THEN 'empty' WHEN s > 0 AND (v < 200 OR s > 3 * v) THEN 'client_rendered' ELSE 'too_short' END AS outcome FROM m2 JOIN v USING (page_id)""",
}
