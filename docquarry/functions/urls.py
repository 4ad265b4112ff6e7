"""Canonical addresses as SQL expressions, and the verdicts that depend on them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Parameters that carry no content.
TRACKING = ("dclid", "fbclid", "gbraid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "mkt_tok", "spm", "wbraid", "yclid", "_hsenc", "_hsmi", "_ga", "_gl")
#: Characters that stay as they are in a path and in a query, within a character class.
PATH_SAFE = r"A-Za-z0-9/:@!$&'()*+,;=._~\-"
QUERY_SAFE = r"A-Za-z0-9/:@!$'()*+,;=._~\-"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def percent_sql(value: str, safe: str) -> str:
    """SQL for ``value`` with one spelling: codes of unreserved characters decoded, others in capitals, the rest encoded."""
    pieces = _quoted(f"%[0-9A-Fa-f]{{2}}|[{safe}]+|(?s:.)")
    decoded = "chr(cast(conv(substr(t, 2, 2), 16, 10) as int))"
    one = f"""case when t rlike '^%..$' then if({decoded} rlike '^[A-Za-z0-9._~-]$', {decoded}, upper(t)) when t rlike {_quoted(f"^[{safe}]+$")} then t
        else regexp_replace(hex(encode(t, 'UTF-8')), '(..)', '%$1') end"""
    return f"if({value} rlike {_quoted(f'^[{safe}]*$')}, {value}, array_join(transform(regexp_extract_all({value}, {pieces}, 0), t -> {one}), ''))"


def absolute(ref: Column, base: Column) -> Column:
    """``ref`` resolved against the address ``base``, without its fragment; dot segments are left to ``canonical``."""
    shape = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(?:#.*)?$"
    part = lambda c, k: F.regexp_extract(c, shape, k)
    origin = F.concat(part(base, 1), part(base, 2))
    path, query = part(ref, 3), part(ref, 4)
    folder = F.coalesce(F.nullif(F.regexp_extract(part(base, 3), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(part(ref, 1) != "", F.concat(part(ref, 1), part(ref, 2), path, query))
        .when(part(ref, 2) != "", F.concat(part(base, 1), part(ref, 2), path, query))
        .when(path == "", F.concat(origin, part(base, 3), F.when(query != "", query).otherwise(part(base, 4))))
        .when(F.startswith(path, F.lit("/")), F.concat(origin, path, query))
        .otherwise(F.concat(origin, folder, path, query))
    )


@F.arrow_udf(StringType())
def ascii_host(host: pa.Array) -> pa.Array:
    """Names with letters beyond ASCII in their IDNA form, null if they have none; SQL has no such function."""
    out = []
    for name in host.to_pylist():
        try:
            out.append(None if name is None else ".".join(x if x.isascii() else x.encode("idna").decode() for x in name.split(".")))
        except UnicodeError:
            out.append(None)
    return pa.array(out, pa.string())


def canonical(df: DataFrame, url: str = "url", international: bool = False) -> DataFrame:
    """Adds ok, scheme, host, port, path, query and canonical for absolute http(s) addresses.

    Refused: control characters, over 2048 characters, other schemes, credentials, no host, bad labels or ports.
    Percent codes get one spelling, dot segments and empty segments go, tracking parameters go, the rest of the query is
    sorted by name, default ports and fragments go. Names beyond ASCII are refused, or brought to IDNA form if
    ``international``, which takes the names through Python.
    """
    u = F.trim(F.col(url))
    shape = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda k: F.regexp_extract(u, shape, k)
    step = df.withColumn("_authority", part(2)).withColumn("scheme", F.lower(part(1))).withColumn("_raw", part(3)).withColumn("_path", F.expr(percent_sql("_raw", PATH_SAFE))).withColumn("_query", part(4))
    step = step.withColumn("host", F.regexp_replace(F.lower(F.regexp_replace("_authority", r":\d*$", "")), r"\.+$", ""))
    if international:
        step = step.withColumn("host", F.coalesce(ascii_host(F.when(F.col("host").rlike(r"[^\x00-\x7f]"), F.col("host"))), F.col("host")))
    step = step.withColumn("_port", F.regexp_extract("_authority", r":(\d+)$", 1))
    default = F.when(F.col("scheme") == "https", 443).otherwise(80)
    step = step.withColumn("port", F.when(F.col("_port") == "", default).otherwise(F.expr("try_cast(_port as int)")))
    keep = F.expr("filter(split(_path, '/'), s -> s not in ('', '.'))")
    folded = F.expr("aggregate(_kept, cast(array() as array<string>), (a, s) -> if(s = '..', slice(a, 1, greatest(size(a) - 1, 0)), array_append(a, s)))")
    step = step.withColumn("_kept", keep).withColumn("_folded", folded)
    path = F.concat(F.lit("/"), F.array_join("_folded", "/"), F.when(F.col("_path").rlike("/$") & (F.size("_folded") > 0), "/").otherwise(""))
    tracked = ", ".join(f"'{t}'" for t in TRACKING)
    key, value = percent_sql("split_part(s, '=', 1)", QUERY_SAFE), percent_sql("substr(s, length(split_part(s, '=', 1)) + 2)", QUERY_SAFE)
    named = f"""transform(filter(split(_query, '&'), s -> s <> ''), s -> struct({key} as k, if(contains(s, '='), '=', '') as e, {value} as v))"""
    query = F.expr(f"array_join(transform(array_sort(filter({named}, x -> lower(x.k) not in ({tracked}) and not startswith(lower(x.k), 'utm_'))), x -> concat(x.k, x.e, x.v)), '&')")
    step = step.withColumn("path", path).withColumn("query", query)
    ok = (
        ~u.rlike(r"[\x00-\x1f\x7f]")
        & (F.length(u) <= 2048)
        & F.col("scheme").isin("http", "https")
        & ~F.contains("_authority", F.lit("@"))
        & F.col("host").rlike(r"^[a-z0-9_\-]{1,63}(\.[a-z0-9_\-]{1,63})*$")
        & (F.length("host") <= 253)
        & F.col("port").between(1, 65535)
    )
    step = step.withColumn("ok", F.coalesce(ok, F.lit(False)))
    shown = F.concat("scheme", F.lit("://"), "host", F.when(F.col("port") == default, "").otherwise(F.concat(F.lit(":"), F.col("port").cast("string"))), "path", F.when(F.col("query") == "", "").otherwise(F.concat(F.lit("?"), "query")))
    return step.withColumn("canonical", F.when(F.col("ok"), shown)).drop("_authority", "_raw", "_path", "_query", "_port", "_kept", "_folded")


def in_scope(urls: DataFrame, scopes: DataFrame) -> DataFrame:
    """Every (url, scope) of equal scheme and port whose host is the scope's, or below it, and whose path has its prefix.

    ``urls`` from ``canonical``; ``scopes`` (scope, s_scheme, s_port, s_host, s_prefix, s_sub) is a list of seeds. Hosts
    meet by key: an address is exploded into its parent domains, so no pair is compared in vain.
    """
    parents = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    each = urls.where("ok").withColumn("_parent", F.explode(parents))
    joined = each.join(scopes, (F.col("_parent") == F.col("s_host")) & (F.col("scheme") == F.col("s_scheme")) & (F.col("port") == F.col("s_port")))
    return joined.where(((F.col("host") == F.col("s_host")) | F.col("s_sub")) & F.startswith("path", F.col("s_prefix"))).drop("_parent")


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; empty if it has none."""
    shape = rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    return F.concat(*(F.regexp_extract(tag, shape, k) for k in (1, 2, 3)))


def links(pages: DataFrame, key: str = "page_id", html: str = "html", most: int = 500) -> DataFrame:
    """(key, ordinal, href): distinct targets of anchors in document order, the first ``most``; fragments and nofollow skipped."""
    anchors = F.regexp_extract_all(F.concat(F.col(html), F.lit("<>")), F.lit(r"(?i)<a\b[^>]*>"), F.lit(0))
    wanted = F.filter(anchors, lambda a: ~F.lower(_attribute(a, "rel")).rlike(r"(^|\s)nofollow(\s|$)"))
    hrefs = F.filter(F.transform(wanted, lambda a: F.trim(_attribute(a, "href"))), lambda h: (h != "") & ~F.startswith(h, F.lit("#")))
    return pages.select(key, F.posexplode(F.slice(F.array_distinct(hrefs), 1, most)).alias("ordinal", "href"))


def link_targets(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most: int = 500) -> DataFrame:
    """(key, ordinal, canonical): the addresses that a page links to, each once and in document order, the first ``most``.

    Hrefs are resolved against the page's first ``<base href>``, itself resolved against the page's address.
    """
    ended = F.concat(F.col(html), F.lit("<>"))  # a tag that is left open ends with the page
    said = _attribute(F.regexp_extract(ended, r"(?i)<base\b[^>]*>", 0), "href")
    based = pages.select(key, F.col(url).alias("_u"), ended.alias("_html"), said.alias("_base"))
    based = based.withColumn("_u", F.when(F.col("_base") == "", F.col("_u")).otherwise(absolute(F.trim("_base"), F.col("_u"))))
    anchors = F.filter(F.regexp_extract_all("_html", F.lit(r"(?i)<a\b[^>]*>"), F.lit(0)), lambda a: ~F.lower(_attribute(a, "rel")).rlike(r"(^|\s)nofollow(\s|$)"))
    hrefs = based.select(key, "_u", F.posexplode(F.transform(anchors, lambda a: F.trim(_attribute(a, "href")))).alias("_at", "_href")).where("_href <> '' and not startswith(_href, '#')")
    found = canonical(hrefs.withColumn("_url", absolute(F.col("_href"), F.col("_u"))).select(key, "_at", "_url"), "_url").where("ok")
    firsts = found.groupBy(key, "canonical").agg(F.min("_at").alias("_at"))
    ranked = firsts.withColumn("ordinal", (F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1).cast("int"))
    return ranked.where(F.col("ordinal") < most).select(key, "ordinal", "canonical")


def robots_meta(pages: DataFrame, agent: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, noindex, nofollow): what a page's meta tags tell all crawlers, or this one; ``none`` is both."""
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^<>]*>"), F.lit(0)), lambda m: F.lower(_attribute(m, "name")).isin("robots", agent.lower()))
    words = F.flatten(F.transform(metas, lambda m: F.transform(F.split(F.lower(_attribute(m, "content")), ","), lambda w: F.trim(w))))
    has = lambda w: F.coalesce(F.array_contains(words, w) | F.array_contains(words, "none"), F.lit(False))
    return pages.select(key, has("noindex").alias("noindex"), has("nofollow").alias("nofollow"))


#: Elements whose content is no text, and parts of a page beside its content.
_NO_TEXT = ("script", "style", "noscript", "template", "svg", "iframe")
_BESIDE = ("nav", "header", "footer", "aside", "form", "button", "figure")
#: At the end of a page it closes what was left open, so that no pattern goes over the rest in vain from each opening.
_ENDS = "<!---->" + "".join(f"<{t}></{t}>" for t in (*_NO_TEXT, "title", *_BESIDE)) + "<>"


def main_content(html: Column) -> Column:
    """A page's main content as Markdown: its ``main`` or ``article`` if it has one, else its body without what stands beside.

    Headings, list items, table rows and code stay as such; comments, images and other markup go; blanks collapse in lines.
    What is left open reaches to the end of the page.
    """
    step = F.regexp_replace(F.concat(F.coalesce(html, F.lit("")), F.lit(_ENDS)), r"(?s)<!--.*?-->", "")
    for tag in (*_NO_TEXT, "title"):
        step = F.regexp_replace(step, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    inner = lambda tag: F.regexp_extract(F.coalesce(F.get(F.split(step, rf"(?i)<{tag}\b[^>]*>", 2), 1), F.lit("")), rf"(?is)^(.*)</{tag}\s*>", 1)
    rest = step
    for tag in _BESIDE:
        rest = F.regexp_replace(rest, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    step = F.coalesce(F.nullif(inner("main"), F.lit("")), F.nullif(inner("article"), F.lit("")), rest)
    step = F.concat(F.regexp_replace(step, r"\s+", " "), F.lit("<>"))
    for level in range(1, 7):
        step = F.regexp_replace(step, rf"(?i)<h{level}\b[^>]*>", "\n\n" + "#" * level + " ")
    for pattern, into in ((r"<li\b[^>]*>", "\n- "), (r"<br\b[^>]*>", "\n"), (r"<t[dh]\b[^>]*>", "| "), (r"</?(?:p|div|section|article|table|ul|ol|tr|pre|blockquote|h[1-6])\b[^>]*>", "\n\n"), (r"</?code\b[^>]*>", "`"), (r"<[^>]*>", "")):
        step = F.regexp_replace(step, f"(?i){pattern}", into)
    for name, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        step = F.replace(step, F.lit(name), F.lit(character))
    lines = F.filter(F.transform(F.split(step, "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " "))), lambda x: ~x.rlike(r"^(#*|-|\|)$"))
    apart = F.transform(lines, lambda x: F.concat(F.when(x.rlike(r"^[-|] "), "\n").otherwise("\n\n"), x))
    return F.regexp_replace(F.array_join(apart, ""), r"^\n+", "")


def html_stats(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = 200) -> DataFrame:
    """(key, title, visible_chars, script_chars, main_chars, outcome) by markup rules; the class says what a fetch has yielded.

    Enough main content is sufficient; nothing at all is empty; little to see beside scripts, or thrice as much script, is
    rendered by a client; the rest is too short.
    """
    html = F.concat(F.col(html), F.lit(_ENDS))
    hidden = r"(?is)<(script|style|noscript|template)\b[^>]*>(.*?)</\1\s*>"
    scripts = F.aggregate(F.regexp_extract_all(html, F.lit(hidden), F.lit(2)), F.lit(0), lambda n, s: n + F.length(F.trim(s)))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, hidden, " "), r"(?is)<!--.*?-->|<title[^>]*>.*?</title>|<[^>]*>", " "), r"\s+", " ")
    own = pages.select(key, F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.length(F.trim(bare)).alias("visible_chars"), scripts.alias("script_chars"), F.length(main_content(html)).alias("main_chars"))
    m, v, s = F.col("main_chars"), F.col("visible_chars"), F.col("script_chars")
    outcome = F.when(m >= least, "sufficient").when((m == 0) & (v == 0) & (s == 0), "empty").when((s > 0) & ((v < least) | (s > 3 * v)), "client_rendered").otherwise("too_short")
    return own.withColumn("outcome", outcome)
