"""Registered queries that once worked on a part of their input, against brute force over all of it."""

from __future__ import annotations

import re
import unicodedata

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from docquarry import catalog
from docquarry.functions import text, urls

DATA = "/root/testdata/sf0.001"


def stored(name, *columns):
    return pq.read_table(f"{DATA}/{name}.parquet", columns=list(columns)).to_pylist()


def test_crawl_frontier_follows_all_edges(spark):
    links = {}
    for r in stored("lineitem", "l_partkey", "l_suppkey"):
        links.setdefault(r["l_partkey"], set()).add((r["l_partkey"] * 31 + r["l_suppkey"]) % 2000)
    depth, front = {1: 0, 2: 0}, {1, 2}
    for level in (1, 2, 3):
        front = {b for a in front for b in links.get(a, ())} - depth.keys()
        depth |= dict.fromkeys(front, level)
    found = catalog.queries()["crawl_frontier"](spark, DATA).collect()
    assert len(found) == len(depth) and {r.node: r.depth for r in found} == depth


def outcome(html):
    hidden = r"(?is)<(script|style|noscript|template)\b[^>]*>(.*?)</\1\s*>"
    scripts = sum(len(m[1].strip(" ")) for m in re.findall(hidden, html))
    seen = re.sub(r"(?is)<!--.*?-->|<title[^>]*>.*?</title>|<[^>]*>", " ", re.sub(hidden, " ", html))
    shown = len(re.sub("[ \\t\\n\\x0b\\f\\r]+", " ", seen).strip(" "))
    article = re.search(r"(?is)<(main|article)\b[^>]*>(.*)</\1\s*>", re.sub(r"(?s)<!--.*?-->", "", re.sub(hidden, " ", html)))
    beside = r"(?is)<(nav|header|footer|aside|form|button|figure|title)\b[^>]*>.*?</\1\s*>"
    body = article[2] if article else re.sub(beside, " ", re.sub(hidden, " ", html))
    main = len(re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", body)).strip())
    if main >= 200:  # of this size marks of Markdown decide nothing in these pages
        return "sufficient"
    return "empty" if not main + shown + scripts else "client_rendered" if scripts and (shown < 200 or scripts > 3 * shown) else "too_short"


def test_extract_outcome_reads_every_page(spark):
    found = {r.page_id: r.outcome for r in catalog.queries()["extract_outcome"](spark, DATA).collect()}
    assert found == {r["page_id"]: outcome(r["html"]) for r in stored("pages", "page_id", "html")}
    stubs = {"<p></p>": "empty", "<p>short</p><script>run()</script>": "client_rendered", "<p>short</p>": "too_short", "<p>" + "long " * 50 + "</p>": "sufficient"}
    stubs |= {"<nav>" + "menu " * 60 + "</nav><p>x</p>": "too_short", "<nav>" + "menu " * 60 + "</nav><script>" + "a" * 1000 + "</script>": "client_rendered"}
    pages = spark.createDataFrame([(k, h) for k, h in enumerate(stubs)], "page_id long, html string")
    assert [r.outcome for r in urls.html_stats(pages).orderBy("page_id").collect()] == list(stubs.values()) == [outcome(h) for h in stubs]


def test_international_names(spark):
    df = spark.createDataFrame([("http://Bücher.example/ä?ü",), ("http://ok.example/",), ("http://" + "ü" * 70 + ".example/",), (None,)], "url string")
    assert [r.canonical for r in urls.canonical(df, international=True).collect()] == ["http://xn--bcher-kva.example/%C3%A4?%C3%BC", "http://ok.example/", None, None]
    assert urls.canonical(df).where("ok").count() == 1


def test_absolute_addresses(spark):
    from urllib.parse import urldefrag, urljoin

    base = "http://h.example/a/b;p?q=1"
    refs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "", "#s", "g#s", ";x", "../g", "https://o.example/x#y", "mailto:a@b"]
    df = spark.createDataFrame([(r,) for r in refs], "ref string")
    found = {r.ref: r.canonical for r in urls.canonical(df.withColumn("u", urls.absolute(F.col("ref"), F.lit(base))), "u").collect()}
    wanted = {r: urls.canonical(spark.createDataFrame([(urldefrag(urljoin(base, r))[0],)], "u string"), "u").first().canonical for r in refs}
    assert found == wanted


def slug(value):
    kept = re.sub(r"[^\w\s-]", "", unicodedata.normalize("NFKC", value).strip().lower())
    return re.sub(r"[\s_-]+", "-", kept).strip("-") or "section"


def test_slugs_of_whole_texts(spark):
    found = {r.doc_id: r.slug for r in catalog.queries()["slugify"](spark, DATA).collect()}
    assert found == {r["doc_id"]: None if r["text"] is None else slug(r["text"]) for r in stored("documents", "doc_id", "text")}
    odd = ["word " * 40 + "end", "Ｆｕｌｌ　ﬁne ²", "", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(odd)], "k long, v string")
    assert [r.s for r in df.select("k", text.slug(F.col("v")).alias("s")).orderBy("k").collect()] == [None if v is None else slug(v) for v in odd]
