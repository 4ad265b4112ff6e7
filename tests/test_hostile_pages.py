"""Pages that leave everything open, and Markdown line by line."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text, urls


def test_pages_that_close_nothing_take_time_in_proportion(spark):
    for bad in ("<!--", "<", "<script ", "<script>", "<main>", "<main ", "<title>", "<meta ", "<nav>", "<li", "</main", "<a ", "<base "):
        page = spark.createDataFrame([(1, "https://a.example/x", bad * (1_000_000 // len(bad)))], "page_id long, url string, html string")
        start = time.perf_counter()
        assert urls.html_stats(page).first().outcome in ("empty", "client_rendered", "too_short")
        urls.robots_meta(page, "bot").collect()
        urls.link_targets(page).collect()
        assert time.perf_counter() - start < 15  # hours, were it quadratic


def test_what_is_left_open_reaches_to_the_end(spark):
    rows = ["<p>one</p><!-- two", "<p>one</p><script>two", "<p>one</p><title>t</title><b", "<main>one</main><nav>two</nav>", "<article>a<main>one</main></article>"]
    found = [r[0] for r in spark.createDataFrame([(h,) for h in rows], "h string").select(urls.main_content(F.col("h"))).collect()]
    assert [f.strip() for f in found] == ["one"] * 5


@pytest.mark.parametrize(
    "markdown, plain",
    [
        ("# Title\n\nText *with* **marks** and `code`.", "Title\n\nText with marks and code."),
        ("1. one\n 23. two\n- three\n* four\n+ five", "one\ntwo\nthree\nfour\nfive"),
        ("see [a link](http://x.example/y) and ![an image](z.png)", "see a link and !an image"),
        ("a\r\nb\rc\x0bd\x0ce f", "a\nb\nc\nd\ne\nf"),
        ("```python\nx = 1\n```\n~~~\ny\n~~~", "x = 1\ny"),
        ("    # four blanks are no heading", "# four blanks are no heading"),
        ("#no blank\n 1.none\n  end 　\n\n", "#no blank\n 1.none\n  end"),
        ("", ""),
        (None, None),
    ],
)
def test_markdown_to_text(spark, markdown, plain):
    assert spark.createDataFrame([(markdown,)], "m string").select(text.markdown_to_text(F.col("m"))).first()[0] == plain
