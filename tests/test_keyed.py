"""A table changed by key: what it holds, and what it leaves alone."""

from __future__ import annotations

from pathlib import Path

from docquarry.sources.keyed import KeyedTable


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = tmp_path / "t"
    table = KeyedTable(spark, f"file://{folder}", "k long, v string", ["k"], buckets=8)
    change = "k long, v string, seq long, gone boolean"
    assert table.rows().count() == 0 and table.apply(spark.createDataFrame([], change), "seq", "gone") == []
    table.apply(spark.createDataFrame([(k, f"a{k}", k, False) for k in range(100)], change), "seq", "gone")
    before = {f: f.stat().st_mtime_ns for f in Path(folder).rglob("*.parquet")}
    touched = table.apply(spark.createDataFrame([(5, "late", 2, False), (5, "first", 1, False), (6, None, 3, True), (6, "x", 2, False)], change), "seq", "gone")
    after = {f: f.stat().st_mtime_ns for f in Path(folder).rglob("*.parquet")}
    assert 1 <= len(touched) <= 2
    for f, at in before.items():
        assert (int(f.parent.name.removeprefix("_bucket=")) in touched) == (after.get(f) != at)
    rows = {r.k: r.v for r in KeyedTable(spark, f"file://{folder}", "k long, v string", ["k"], buckets=8).rows().collect()}
    assert rows == {k: "late" if k == 5 else f"a{k}" for k in range(100) if k != 6}
    table.apply(spark.createDataFrame([(k, None, 9, True) for k in range(100)], change), "seq", "gone")
    assert table.rows().count() == 0
