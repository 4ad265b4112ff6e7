"""What a crawl may fetch and what it keeps: robots files, sitemaps, admission and budgets."""

from __future__ import annotations

import functools
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docquarry.functions.urls import canonical, link_targets, robots_meta
from docquarry.operators.graph import robots_verdicts
from docquarry.operators.ordered import running_sums
from docquarry.sources.stage import Stage

#: Names that mean something inside a network only.
PRIVATE_SUFFIXES = (".localhost", ".local", ".internal", ".intranet", ".lan", ".corp", ".home", ".home.arpa", ".onion", ".in-addr.arpa", ".ip6.arpa")
#: Bounds of a robots file in characters, of a sitemap in entries.
ROBOTS_LENGTH = 500 * 1024
SITEMAP_ENTRIES = 50_000
SITEMAP_BYTES = 50 * 1024 * 1024
#: Where a sitemap is looked for if the robots file names none.
SITEMAP_PATH = "/sitemap.xml"


def _squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, line, pattern, allow) of the group of a robots file that binds ``agent``; ``files`` has (host, status, body).

    The longest agent name that begins the product token wins, the first group on a tie, else the first ``*``
    group. Answers of 500 and above, and none at all, forbid everything; other failures allow everything.
    Lines before the first agent and rules without a value don't count.
    """
    token = agent.split("/")[0].strip().lower()
    down = F.col("status").isNull() | (F.col("status") >= 500)
    denied = files.where(down).select("host", F.lit(0).alias("line"), F.lit("/").alias("pattern"), F.lit(False).alias("allow"))
    raw = files.where(F.col("status").between(200, 299)).select("host", F.posexplode(F.split(F.substring("body", 1, ROBOTS_LENGTH), r"\r\n|\r|\n")).alias("line", "raw"))
    bare = raw.select("host", "line", F.regexp_replace("raw", "#.*$", "").alias("raw")).where(F.contains("raw", F.lit(":")))
    named = bare.select("host", "line", F.lower(_squeeze(F.substring_index("raw", ":", 1))).alias("field"), _squeeze(F.regexp_replace("raw", "^[^:]*:", "")).alias("value")).where("field <> 'sitemap'")
    w = Window.partitionBy("host").orderBy("line")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    grouped = named.withColumn("_start", starts.cast("int")).withColumn("group", F.sum("_start").over(w)).where("group > 0")
    name = F.lower("value")
    best = F.when((name != "*") & F.startswith(F.lit(token), name), F.struct(F.length("value").alias("n"), (-F.col("group")).alias("g")))
    agents = grouped.where("field = 'user-agent'").groupBy(F.col("host").alias("_host")).agg(F.max(best).alias("_best"), F.min(F.when(F.col("value") == "*", F.col("group"))).alias("_any"))
    rules = grouped.where("field in ('allow', 'disallow') and value <> ''").join(agents, (F.col("host") == F.col("_host")) & (F.col("group") == F.coalesce(-F.col("_best.g"), F.col("_any"))))
    return rules.select("host", "line", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow")).unionByName(denied)


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """(host, line, url) of the sitemaps that robots files (host, status, body) name, wherever in the file."""
    raw = files.where(F.col("status").between(200, 299)).select("host", F.posexplode(F.split(F.substring("body", 1, ROBOTS_LENGTH), r"\r\n|\r|\n")).alias("line", "raw"))
    bare = raw.select("host", "line", F.regexp_replace("raw", "#.*$", "").alias("raw"))
    named = bare.where(F.lower(_squeeze(F.substring_index("raw", ":", 1))) == "sitemap")
    return named.select("host", "line", _squeeze(F.regexp_replace("raw", "^[^:]*:", "")).alias("url")).where("url <> ''")


@F.arrow_udf(StringType())
def unpacked(content: pa.Array) -> pa.Array:
    """A sitemap's octets as text, gunzipped as a stream up to ``SITEMAP_BYTES``; null if it is broken or would be longer."""

    def text(octets: bytes | None) -> str | None:
        if octets is not None and octets.startswith(b"\x1f\x8b"):
            stream = zlib.decompressobj(31)
            try:
                octets = stream.decompress(octets, SITEMAP_BYTES + 1)
            except zlib.error:
                return None
            if not stream.eof and len(octets) <= SITEMAP_BYTES:
                return None
        return None if octets is None or len(octets) > SITEMAP_BYTES else octets.decode(errors="replace")

    return pa.array([text(v) for v in content.to_pylist()], pa.string())


def _tag(c: Column, name: str) -> Column:
    return _squeeze(F.regexp_extract(c, rf"(?is)<(?:\w+:)?{name}\b[^>]*>(.*?)</(?:\w+:)?{name}\s*>", 1))


def sitemap_children(files: DataFrame, key: str = "sitemap_id", xml: str = "xml") -> DataFrame:
    """(key, ordinal, canonical) of the sitemaps that an index lists, in order; bad addresses and repeats are left out."""
    sound = files.where(~F.col(xml).rlike(r"(?i)<!\s*(doctype|entity)"))
    each = sound.select(key, F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?sitemap\b[^>]*>(.*?)</(?:\w+:)?sitemap\s*>"), F.lit(1))).alias("_at", "_e"))
    good = canonical(each.select(key, "_at", F.replace(_tag(F.col("_e"), "loc"), F.lit("&amp;"), F.lit("&")).alias("url"))).where("ok")
    firsts = good.groupBy(key, "canonical").agg(F.min("_at").alias("_at"))
    return firsts.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1).cast("int").alias("ordinal"), "canonical")


def sitemap_discovery(answers: DataFrame, robots: DataFrame, seeds: DataFrame, max_sitemaps: int = 20) -> tuple[DataFrame, DataFrame]:
    """What the sitemaps of crawled sites list: (crawl, position, url, read) and (crawl, ordinal, url).

    ``answers`` (url, html, status) are stored answers, ``robots`` (host, status, body) robots files, ``seeds`` (crawl, url, via)
    has a row via ``seed`` for each crawl. The sitemaps that the robots file names, else the usual one, wait first; those that
    an index lists wait behind. One is taken once, if its scheme, host and port are the seed's, whatever its folder, until
    ``max_sitemaps`` are; ``read`` tells whether it was answered. Entries come in the order of sitemaps and of their lines, each
    address once. Each round takes what waits, so there are at most ``max_sitemaps`` rounds.
    """
    stage = Stage(answers.sparkSession, "sitemaps")
    origins = canonical(seeds.where("via = 'seed'")).where("ok").select("crawl", F.col("scheme").alias("_s"), F.col("host").alias("_h"), F.col("port").alias("_p"), F.regexp_extract("canonical", "^[^:]+://[^/]+", 0).alias("_root"))
    named = robots_sitemaps(robots).withColumnRenamed("host", "_host")
    named = origins.join(canonical(named).where("ok").select("_host", "line", "canonical"), F.col("_h") == F.col("_host")).select("crawl", F.col("canonical").alias("url"), F.col("line").alias("ordinal"))
    usual = origins.join(named.select("crawl").distinct(), "crawl", "left_anti").select("crawl", F.concat("_root", F.lit(SITEMAP_PATH)).alias("url"), F.lit(0).alias("ordinal"))
    level = named.unionByName(usual).withColumn("parent", F.lit(0))
    sound = answers.where(F.col("status").between(200, 299)).select(F.col("url").alias("_url"), F.col("html").alias("xml"))
    taken: DataFrame | None = None
    for k in range(max_sitemaps):
        fresh = level.groupBy("crawl", "url").agg(F.min(F.struct("parent", "ordinal")).alias("_f")).select("crawl", "url", "_f.*")
        if taken is not None:
            fresh = fresh.join(taken.select("crawl", "url"), ["crawl", "url"], "left_anti")
            counts = taken.groupBy(F.col("crawl").alias("_c")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
        own = canonical(fresh).drop("canonical", "ok").join(origins, "crawl").where((F.col("scheme") == F.col("_s")) & (F.col("host") == F.col("_h")) & (F.col("port") == F.col("_p")))
        ranked = own.withColumn("_r", F.row_number().over(Window.partitionBy("crawl").orderBy("parent", "ordinal", "url"))).where(F.col("_r") <= max_sitemaps)
        before = F.coalesce(F.col("_n"), F.lit(0)) if taken is not None else F.lit(0)
        joined = ranked.join(counts, F.col("crawl") == F.col("_c"), "left") if taken is not None else ranked
        found = joined.select("crawl", (F.col("_r") + before).alias("position"), "url").where(F.col("position") <= max_sitemaps)
        found = stage.save(found.join(sound, F.col("url") == F.col("_url"), "left").select(F.struct("crawl", "position").alias("key"), "crawl", "position", "url", "xml"), f"round{k}")
        if found.isEmpty():
            break
        taken = found if taken is None else taken.unionByName(found)
        level = sitemap_children(found.where("xml is not null"), "key").select("key.crawl", F.col("canonical").alias("url"), "ordinal", F.col("key.position").alias("parent"))
    taken = found if taken is None else taken
    listed = sitemap_entries(taken.where("xml is not null"), "key").select("key.crawl", F.struct("key.position", "ordinal").alias("_at"), "canonical")
    firsts = listed.groupBy("crawl", F.col("canonical").alias("url")).agg(F.min("_at").alias("_at")).select("crawl", "url", F.col("_at.position").alias("_s"), F.col("_at.ordinal").alias("_o"))
    entries = running_sums(firsts, ["crawl"], ["_s", "_o"], {"ordinal": F.lit(1)}, stage, "entries").select("crawl", F.col("ordinal").cast("int").alias("ordinal"), "url")
    return taken.select("crawl", "position", "url", F.col("xml").isNotNull().alias("read")), entries


def crawl_sites(answers: DataFrame, robots: DataFrame, seeds: DataFrame, agent: str = "docbot", max_sitemaps: int = 20, **limits: float) -> DataFrame:
    """``site_crawl`` from stored answers and robots files alone: ``seeds`` (crawl, url) are followed by what the sites' sitemaps list."""
    own = seeds.select("crawl", "url").withColumns({"via": F.lit("seed"), "ordinal": F.lit(-1)})
    entries = sitemap_discovery(answers, robots, own, max_sitemaps)[1].select("crawl", "url", F.lit("sitemap").alias("via"), "ordinal")
    rules = Stage(answers.sparkSession, "rules").save(robots_rules(robots, agent).select("host", "pattern", "allow"), "rules")
    return site_crawl(answers, own.unionByName(entries), rules, agent, **limits)


def site_crawl(
    pages: DataFrame, seeds: DataFrame, rules: DataFrame, agent: str = "docbot", max_depth: int = 3, max_pages: int = 200, max_frontier: int = 5000, max_bytes: int = 64 * 1024 * 1024, seconds: float = 300.0
) -> DataFrame:
    """(crawl, position, url, depth, via, verdict) of a crawl over stored answers, level by level.

    ``pages`` (url, html, status, media_type, and seconds if it has them) are the answers by canonical address, ``seeds``
    (crawl, url, via, ordinal) the first candidates, one of them via ``seed``: its scheme, host, port and folder are the crawl's scope.
    ``rules`` (host, pattern, allow) are robots rules. A candidate is out_of_scope, robots_disallowed, or limit_reached once ``max_frontier``
    are admitted; position is null for those. An admitted one, in the order of discovery, is a page or names why not. The page that reaches
    ``max_pages`` or ``max_bytes`` is the last; nor is anything visited once fetches took more than ``seconds``: what follows is
    not_visited. Links of what was fetched, unless nofollow, are the next level's candidates, up to ``max_depth``. Numbers and budgets
    of a level are running sums over ranges, so a crawl's level lies in many tasks.
    """
    stage = Stage(pages.sparkSession, "crawl")
    first = canonical(seeds).where("ok")
    scopes = first.where("via = 'seed'").select(F.col("crawl").alias("_c"), F.col("scheme").alias("_s"), F.col("host").alias("_h"), F.col("port").alias("_p"), F.regexp_extract("path", "^(.*/)", 1).alias("_prefix"))
    tags = robots_meta(pages, agent, "url").select(F.col("url").alias("_u"), "noindex", "nofollow")
    took = (F.col("seconds") * 1000 if "seconds" in pages.columns else F.lit(0)).cast("long")
    answers = pages.select("url", "status", "media_type", F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"), took.alias("millis"))
    answers = stage.save(answers.join(tags, F.col("url") == F.col("_u")).drop("_u"), "answers").withColumnRenamed("url", "_url")
    links = stage.save(link_targets(pages.withColumn("_key", F.col("url")), "_key", "url"), "links")
    level = first.select("crawl", F.col("canonical").alias("url"), "via", F.lit(0).cast("long").alias("parent"), F.col("ordinal").cast("int").alias("ordinal"))
    levels: list[DataFrame] = []
    for depth in range(max_depth + 1):
        fresh = level.groupBy("crawl", "url").agg(F.min(F.struct("parent", "ordinal", "via")).alias("_f")).select("crawl", "url", "_f.*")
        done = functools.reduce(DataFrame.unionByName, levels) if levels else None
        if done is not None:
            fresh = fresh.join(done.select("crawl", "url"), ["crawl", "url"], "left_anti")
        parsed = canonical(fresh).drop("canonical", "ok").join(scopes, F.col("crawl") == F.col("_c"))
        within = (F.col("scheme") == F.col("_s")) & (F.col("host") == F.col("_h")) & (F.col("port") == F.col("_p")) & F.startswith("path", F.col("_prefix"))
        parsed = stage.save(parsed.select("crawl", "url", "via", "parent", "ordinal", "host", F.concat("path", F.when(F.col("query") != "", F.concat(F.lit("?"), "query")).otherwise("")).alias("target"), within.alias("within")), f"parsed{depth}")
        allowed = robots_verdicts(parsed.select(F.col("url").alias("url_id"), "host", "target").distinct(), rules)
        answer = (
            F.when(F.col("status").isNull(), "fetch_failed")
            .when(~F.col("status").between(200, 299), "unsuccessful_status")
            .when(~F.col("media_type").isin("text/html", "application/xhtml+xml"), "unsupported_media_type")
            .when(F.col("noindex"), "page_noindex")
            .otherwise("page")
        )
        judged = parsed.join(allowed, F.col("url") == F.col("url_id")).join(answers, F.col("url") == F.col("_url"), "left").withColumn("_answer", answer).withColumn("_fit", F.col("within") & F.col("allowed"))
        page = F.when(F.col("_answer") == "page", 1).otherwise(0)
        values = {"_rank": F.lit(1), "_pages": page, "_bytes": page * F.col("bytes"), "_millis": F.col("millis")}
        summed = running_sums(stage.save(judged, f"judged{depth}"), ["crawl", "_fit"], ["parent", "ordinal", "url"], values, stage, f"summed{depth}")
        zero = F.lit(0).cast("long")
        if done is None:
            summed = summed.withColumns({"_before": zero, "_p0": zero, "_b0": zero, "_m0": zero})
        else:
            visited = F.col("verdict") != "not_visited"
            sums = {"_before": F.lit(1), "_p0": F.when(F.col("verdict") == "page", 1), "_b0": F.when(F.col("verdict") == "page", F.col("bytes")), "_m0": F.when(visited, F.col("millis"))}
            totals = done.where("position is not null").groupBy(F.col("crawl").alias("_d")).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))
            summed = summed.join(totals, F.col("crawl") == F.col("_d"), "left").fillna(0, list(sums))
        admitted = F.col("_fit") & (F.col("_rank") + F.col("_before") < max_frontier)
        ended = (F.col("_pages") + F.col("_p0") >= max_pages) | (F.col("_bytes") + F.col("_b0") >= max_bytes) | (F.col("_millis") + F.col("_m0") > int(seconds * 1000))
        verdict = F.when(~F.col("within"), "out_of_scope").when(~F.col("allowed"), "robots_disallowed").when(~admitted, "limit_reached").when(ended, "not_visited").otherwise(F.col("_answer"))
        found = summed.select("crawl", F.when(admitted, F.col("_rank") + F.col("_before") + 1).alias("position"), "url", F.lit(depth).alias("depth"), "via", verdict.alias("verdict"), F.coalesce("nofollow", F.lit(False)).alias("nofollow"), "bytes", "millis")
        found = stage.save(found, f"level{depth}")
        levels.append(found)
        fetched = found.where("verdict in ('page', 'page_noindex') and not nofollow").select("crawl", F.col("url").alias("_key"), F.col("position").alias("parent"))
        level = fetched.join(links, "_key").select("crawl", F.col("canonical").alias("url"), F.lit("link").alias("via"), "parent", "ordinal")
    return functools.reduce(DataFrame.unionByName, levels).select("crawl", "position", "url", "depth", "via", "verdict")


def sitemap_entries(files: DataFrame, key: str = "sitemap_id", xml: str = "xml", most: int = SITEMAP_ENTRIES) -> DataFrame:
    """(key, ordinal, canonical, lastmod, priority) of the pages that a sitemap lists, in order, the first ``most``.

    Files that declare a document type or entities are refused whole, bad addresses and repeats are left out. Priorities
    outside 0 to 1 and dates that don't parse are null; dates without a zone are UTC. Namespace prefixes don't matter.
    """
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    sound = files.where(~F.col(xml).rlike(r"(?i)<!\s*(doctype|entity)"))
    each = sound.select(key, F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?url\b[^>]*>(.*?)</(?:\w+:)?url\s*>"), F.lit(1))).alias("_at", "_e"))
    parts = each.select(key, "_at", plain(_tag(F.col("_e"), "loc")).alias("url"), _tag(F.col("_e"), "lastmod").alias("_m"), _tag(F.col("_e"), "priority").alias("_p"))
    good = canonical(parts).where("ok").groupBy(key, "canonical").agg(F.min(F.struct("_at", "_m", "_p")).alias("_f"))
    ranked = good.withColumn("ordinal", (F.row_number().over(Window.partitionBy(key).orderBy("_f._at")) - 1).cast("int")).where(F.col("ordinal") < most)
    priority = F.col("_f._p").try_cast("double")
    return ranked.select(key, "ordinal", "canonical", F.col("_f._m").try_cast("timestamp").alias("lastmod"), F.when(priority.between(0, 1), priority).alias("priority"))


def hostname_reason(host: Column) -> Column:
    """Why a name may not be looked up: it means something inside a network only, or has one label; null if it may."""
    name = F.lower(F.regexp_replace(F.trim(host), r"\.+$", ""))
    literal = name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | F.contains(name, F.lit(":"))
    suffix = "|".join(s.replace(".", r"\.") for s in PRIVATE_SUFFIXES)
    private = (name == "") | (name == "localhost") | name.rlike(f"({suffix})$") | ~F.contains(name, F.lit("."))
    return F.when(F.coalesce(~literal & private, F.lit(True)), "private_hostname")


def route_verdict(ok: Column, scoped: Column, reason: Column) -> Column:
    """What a page's own request gets; scope is asked before any lookup."""
    return F.when(~F.coalesce(ok, F.lit(False)), "bad_scheme").when(~F.coalesce(scoped, F.lit(False)), "out_of_scope").when(reason.isNotNull(), "blocked").otherwise("in_scope")


def admission(candidates: DataFrame, max_depth: int = 3, max_frontier: int = 5000) -> DataFrame:
    """(crawl, seq, url, verdict) of candidates (crawl, seq, url, depth, in_scope, allowed) in order of discovery, ties by url.

    Refused candidates are named each time, admitted addresses once; later sightings of those are left out. A full
    frontier refuses the rest. At most ``max_frontier`` rows of a crawl are ranked together, the others are cut per task.
    """
    reason = F.when(~F.col("in_scope"), "out_of_scope").when(~F.col("allowed"), "robots_disallowed").when(F.col("depth") > max_depth, "max_depth")
    judged = candidates.withColumn("_reason", reason)
    fit = judged.where(F.col("_reason").isNull())
    firsts = fit.groupBy("crawl", "url").agg(F.min("seq").alias("seq"))
    taken = firsts.withColumn("_n", F.row_number().over(Window.partitionBy("crawl").orderBy("seq", "url"))).where(F.col("_n") <= max_frontier).select("crawl", "url", F.col("seq").alias("_first"))
    late = fit.join(taken, ["crawl", "url"], "left").where(F.col("_first").isNull() | (F.col("_first") == F.col("seq")))
    out = late.select("crawl", "seq", "url", F.when(F.col("_first").isNull(), "limit_reached").otherwise("admitted").alias("verdict"))
    return out.unionByName(judged.where(F.col("_reason").isNotNull()).select("crawl", "seq", "url", F.col("_reason").alias("verdict")))


def render_gate(pages: DataFrame, most: int = 25) -> DataFrame:
    """(crawl, seq, render) of pages (crawl, seq, outcome): whether a page is worth a browser, the first ``most`` of a crawl."""
    wants = F.col("outcome").isin("client_rendered", "too_short")
    counted = running_sums(pages.select("crawl", "seq", "outcome"), ["crawl"], ["seq"], {"_before": wants.cast("int")}, Stage(pages.sparkSession, "renders"))
    return counted.select("crawl", "seq", F.coalesce(wants & (F.col("_before") < most), F.lit(False)).alias("render"))


def visits(log: DataFrame, max_pages: int = 200, max_bytes: int = 64 * 1024 * 1024, seconds: float = 300.0) -> DataFrame:
    """(crawl, seq, verdict) of fetches (crawl, seq, url, fault, status, media_type, noindex, bytes, elapsed) in visit order, ties by url.

    A fetch becomes a page or names why not. The page that reaches a budget of pages or bytes is kept and ends the
    crawl; a fetch that would start after ``seconds`` ends it as well. What follows is not_visited. A crawl's log lies in many tasks.
    """
    verdict = (
        F.when(F.col("fault") == "blocked", "blocked_by_guard")
        .when(F.col("fault").isNotNull(), "fetch_failed")
        .when(~F.col("status").between(200, 299), "unsuccessful_status")
        .when(~F.col("media_type").isin("text/html", "application/xhtml+xml"), "unsupported_media_type")
        .when(F.col("noindex"), "page_noindex")
        .otherwise("page")
    )
    page, late = F.when(F.col("_v") == "page", 1).otherwise(0), (F.col("elapsed") > seconds).cast("int")
    values = {"_pages": page, "_bytes": page * F.col("bytes"), "_late": late}
    counted = running_sums(log.withColumn("_v", verdict), ["crawl"], ["seq", "url"], values, Stage(log.sparkSession, "visits"))
    ended = (F.col("_pages") >= max_pages) | (F.col("_bytes") >= max_bytes) | (F.col("_late") > 0) | F.coalesce(F.col("elapsed") > seconds, F.lit(False))
    return counted.select("crawl", "seq", F.when(ended, "not_visited").otherwise(F.col("_v")).alias("verdict"))
