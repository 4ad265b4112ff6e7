"""Edge cases of operators that tables don't show."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import text, urls
from docquarry.operators import chunks, files, state


def test_text(spark):
    df = spark.createDataFrame([("Ünï code_1 ÜNÏ x",), ("",), ("one",), ("ab 中文 c",)], "t string")
    assert [r[0] for r in df.select(text.word_bigrams(F.col("t"))).collect()] == [["ünï code_1", "code_1 ünï", "ünï x"], [], ["one"], ["ab 中文", "中文 c"]]
    assert df.select(text.query_terms(F.col("t"))).collect()[3][0] == ["中文"]
    assert df.select(text.slug(F.lit("  !! "))).first()[0] == "section"
    assert text_len(spark, "x" * 500) == 400


def text_len(spark, value):
    return len(spark.range(1).select(text.excerpt(F.lit(value))).first()[0])


def test_urls(spark):
    cases = {
        "HTTPS://Docs.Example.COM/Guide#installation": "https://docs.example.com/Guide",
        "https://h.example:443/": "https://h.example/",
        "https://h.example:8443/": "https://h.example:8443/",
        "http://h.example/a/./b/../c": "http://h.example/a/c",
        "http://h.example/?b=2&utm_source=news&a=1&gclid=xyz": "http://h.example/?a=1&b=2",
        "ftp://h.example/": None,
        "http://u:p@h.example/": None,
        "http://h.example:0/": None,
        "nonsense": None,
    }
    df = urls.canonical(spark.createDataFrame([(u,) for u in [*cases, None]], "url string"))
    assert {r.url: r.canonical for r in df.collect()} == {**cases, None: None}


def test_markdown_chunks(spark):
    body = "intro\n\n# A\ntext a\n\n## B\n```\n# not a heading\n\n\nstill code\n```\n# A\n" + "word " * 500 + "\n"
    found = chunks.markdown_chunks(spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id long, text string"), 400).collect()
    assert {r.doc_id for r in found} == {1}
    assert [r.heading_path for r in found][:4] == ["", "A", "A > B", "A"]
    assert all(body[r.char_start : r.char_end].strip() == r.text and len(r.text) <= 400 for r in found)
    assert "".join("".join(r.text for r in found).split()) == "".join(body.split())
    assert [r.anchor for r in found][:6] == ["section", "a", "b", "a-2", "a-3", "a-4"]


def test_long_blocks_are_cut_at_blanks_and_fences_stay_whole(spark):
    fence = "```\n" + "code line\n\n" * 30 + "```"
    body = "# H ##\n\nshort one\n\nshort two\n\n" + fence + "\n\n" + "word " * 40 + "\n\n" + "x" * 130 + "\n\nend"
    found = chunks.markdown_chunks(spark.createDataFrame([(1, body)], "doc_id long, text string"), 60).collect()
    texts = [r.text for r in found]
    assert texts[0] == "# H ##\n\nshort one\n\nshort two" and texts[1] == fence and {r.heading for r in found} == {"H"}
    assert all(len(t) <= 60 for t in texts[2:])
    assert "".join("".join(texts).split()) == "".join(body.split())


def test_files_are_chunked_from_sql_by_their_path(spark):
    chunks.register_file_chunks(spark)
    files = spark.createDataFrame([("a/read.me.md", "one\n# T\ntwo\n"), ("b.py", "x = 1\n" * 61), ("noext", ""), (None, None)], "path string, text string")
    rows = spark.sql("SELECT path, c.* FROM {f}, LATERAL file_chunks(path, text) c", f=files).collect()
    assert [(r.path, r.ordinal, r.anchor, r.heading_path, r.chunk) for r in rows if r.path != "b.py"] == [("a/read.me.md", 0, "L1-L1", "a/read.me.md", "one"), ("a/read.me.md", 1, "L2-L3", "T", "# T\ntwo")]
    assert [(r.anchor, r.char_start, r.char_end, r.token_count) for r in rows if r.path == "b.py"] == [("L1-L60", 0, 360, 180), ("L61-L61", 360, 366, 3)]
    assert "chunk" not in spark.sql("SELECT c.* FROM {f}, LATERAL file_chunks(path, text, false) c", f=files).columns


def test_addresses():
    expected = {
        "127.0.0.1": "loopback", "10.1.2.3": "private", "::ffff:127.0.0.1": "loopback", "64:ff9b::7f00:1": "loopback", "2002:7f00:1::": "loopback", "2001::1": "reserved",
        "fd00:ec2::254": "cloud_metadata", "fd12::1": "unique_local", "100.64.0.1": "carrier_grade_nat", "8.8.8.8": None, "2606:4700::1111": None, "": "reserved", None: "reserved",
    }
    assert {a: files.address_class(a) for a in expected} == expected


def test_lease(spark):
    log = [(1, 0, 0, "a", "claim", True), (1, 1, 10, "b", "claim", True), (1, 2, 400, "b", "claim", True), (1, 3, 410, "a", "complete", True), (1, 4, 420, "b", "fail", True), (1, 5, 430, "a", "claim", True), (1, 6, 440, "a", "fail", True), (1, 7, 450, "a", "claim", True)]
    out = state.lease_replay(spark.createDataFrame(log, "step_id long, seq long, at long, owner string, op string, retryable boolean")).orderBy("seq").collect()
    assert [r.accepted for r in out] == [True, False, True, False, True, True, True, False]
    assert out[-1].status == "failed"
