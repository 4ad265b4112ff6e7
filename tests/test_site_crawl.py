"""A crawl of a made site against a queue, one address at a time."""

from __future__ import annotations

import re
from collections import deque
from urllib.parse import urldefrag, urljoin, urlsplit

from pyspark.sql import functions as F

from docquarry.operators import crawl
from docquarry.plans.crawl import site, site_files

DATA = "/root/testdata/sf0.001"
RULES = {"h0.example": [("/docs/private", False)], "h1.example": [("9$", False), ("/docs/private/p1", True), ("/docs/private", False)]}


def allowed(url):
    parts, best = urlsplit(url), (0, True)
    for pattern, allow in RULES.get(parts.netloc, ()):
        if pattern == "9$":
            hit, n = parts.path.endswith("9"), 4
        else:
            hit, n = parts.path.startswith(pattern), len(pattern)
        if hit:
            best = max(best, (n, allow))
    return best[1]


def queue(answers, seeds, max_depth, max_pages, max_frontier, max_bytes=1 << 40, seconds=1e9, allowed=allowed):
    scope = next(u for u, via in seeds if via == "seed")
    prefix = scope[: scope.rindex("/") + 1]
    seen, waiting, out, pages, octets, took = {}, deque(), {}, 0, 0, 0.0

    def consider(url, depth, via):
        if url in seen or url in out:
            return
        if not url.startswith(prefix):
            out[url] = (depth, via, "out_of_scope")
        elif not allowed(url):
            out[url] = (depth, via, "robots_disallowed")
        elif len(seen) >= max_frontier:
            out[url] = (depth, via, "limit_reached")
        else:
            seen[url] = (depth, via)
            waiting.append(url)

    for url, via in seeds:
        consider(urldefrag(url)[0], 0, via)
    while waiting:
        url = waiting.popleft()
        depth, via = seen[url]
        if pages >= max_pages or octets >= max_bytes or took > seconds:
            out[url] = (depth, via, "not_visited")
            continue
        row = answers.get(url)
        verdict = "fetch_failed" if row is None else "unsuccessful_status" if row.status != 200 else "unsupported_media_type" if row.media_type != "text/html" else "page_noindex" if "content=noindex" in row.html else "page"
        out[url] = (depth, via, verdict)
        pages += verdict == "page"
        octets += len(row.html) if verdict == "page" else 0
        took += getattr(row, "seconds", 0.0) if row is not None else 0.0
        if verdict in ("page", "page_noindex") and "content=nofollow" not in row.html and depth < max_depth:
            for a in re.findall("<a[^>]*>", row.html):
                if "nofollow" not in a:
                    consider(urljoin(url, re.search('href="([^"]*)"', a)[1]), depth + 1, "link")
    return out


def test_site_crawl(spark):
    answers, seeds, rules = site(spark, DATA)
    by = {r.url: r for r in answers.collect()}
    for depth, pages, frontier in ((3, 1000, 5000), (4, 12, 5000), (4, 1000, 15)):
        found = crawl.site_crawl(answers, seeds, rules, max_depth=depth, max_pages=pages, max_frontier=frontier).collect()
        for c in (0, 1, 2):
            first = [(r.url, r.via) for r in seeds.orderBy("ordinal").collect() if r.crawl == c]
            assert {r.url: (r.depth, r.via, r.verdict) for r in found if r.crawl == c} == queue(by, first, depth, pages, frontier)
        assert len({(r.crawl, r.url) for r in found}) == len(found)


def test_site_crawl_finds_its_sitemaps_and_keeps_all_budgets(spark):
    answers, robots, seeds = site_files(spark, DATA)
    by = {r.url: r for r in answers.collect()}
    disallowed = {"h0.example": lambda p: p.startswith("/docs/private"), "h1.example": lambda p: p.endswith("9")}
    permitted = lambda url: not disallowed.get(urlsplit(url).netloc, lambda p: False)(urlsplit(url).path)
    firsts = {0: ["http://h0.example/maps/index.xml", "http://other.example/s.xml", "http://h0.example/maps/part29.xml"], 1: ["http://h1.example/maps/part3.xml"], 2: ["http://h2.example/sitemap.xml"], 4: ["http://h4.example/sitemap.xml"]}
    for limits in ({"max_pages": 60, "max_frontier": 150}, {"max_bytes": 8000}, {"seconds": 9.0}, {"max_depth": 1, "max_frontier": 40}):
        found = crawl.crawl_sites(answers, robots, seeds, **limits).collect()
        for c, seed in ((r.crawl, r.url) for r in seeds.collect()):
            root, waiting, taken, entries = seed.split("/docs")[0], deque(firsts[c]), [], {}
            while waiting and len(taken) < 20:
                url = waiting.popleft()
                if url in taken or not url.startswith(root):
                    continue
                taken.append(url)
                xml = by[url].html if url in by else ""
                locs = re.findall("<loc>(.*?)</loc>", xml)
                waiting.extend(locs if "<sitemap>" in xml else [])
                entries.update(dict.fromkeys([] if "<sitemap>" in xml else locs))
            full = {"max_depth": 3, "max_pages": 200, "max_frontier": 5000} | limits
            want = queue(by, [(seed, "seed"), *((u, "sitemap") for u in entries)], allowed=permitted, **full)
            assert {r.url: (r.depth, r.via, r.verdict) for r in found if r.crawl == c} == want
            places = sorted(r.position for r in found if r.crawl == c and r.position is not None)
            assert places == list(range(1, len(places) + 1))


def test_sitemaps_are_unpacked_within_bounds(spark):
    import gzip

    rows = [(0, b"<urlset/>"), (1, gzip.compress(b"<urlset>x</urlset>")), (2, gzip.compress(b"abc" * 1000)[:-9]), (3, None), (4, gzip.compress(b" " * (crawl.SITEMAP_BYTES + 1))), (5, b"\x1f\x8bjunk")]
    found = spark.createDataFrame(rows, "k int, c binary").select("k", crawl.unpacked(F.col("c")).alias("x")).orderBy("k").collect()
    assert [r.x for r in found] == ["<urlset/>", "<urlset>x</urlset>", None, None, None, None]


def test_folder_files(spark, tmp_path):
    from docquarry.sources.store import folder_files

    (tmp_path / "a").mkdir()
    for name, data in (("a/x.py", b"x = 1\n"), ("b.bin", b"a\x00b"), ("big.txt", b"y" * 3000), ("p", b"version https://git-lfs.github.com/spec/v1\noid sha256:1\n")):
        (tmp_path / name).write_bytes(data)
    found = {r.path.removeprefix(f"file:{tmp_path}/"): r for r in folder_files(spark, str(tmp_path), 2000).collect()}
    assert {k: r.reason for k, r in found.items()} == {"a/x.py": None, "b.bin": "binary", "big.txt": "too_large", "p": "git_lfs"}
    assert bytes(found["a/x.py"].content) == b"x = 1\n" and found["b.bin"].content is None
