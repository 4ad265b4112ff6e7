"""Running sums and folds against plain loops; a group beyond any batch."""

from __future__ import annotations

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docquarry.operators import search, state
from docquarry.operators.ordered import asof_join, fold, running_sums
from docquarry.sources.stage import Stage


@pytest.mark.parametrize("groups", [["g"], ["g", "h"], []])
def test_running_sums(spark, groups):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "a", "a", "b", f"x{k}"]), rng.choice([None, 1, 2]), k // 2, k, rng.choice([None, rng.randrange(100)])) for k in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h int, at long, tie long, v long").repartition(5)
    found = running_sums(df, groups, ["at", "tie"], {"before": F.col("v"), "rank": F.lit(1)}, Stage(spark, "test")).collect()
    place = {"g": 0, "h": 1}
    key = lambda r: tuple((r[place[c]] is not None, r[place[c]] or "") if c == "g" else (r[1] is not None, r[1] or 0) for c in groups)
    want = []
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (key(r), r[2], r[3])), key=key):
        total = 0
        for n, r in enumerate(own):
            want.append((*r, total, n))
            total += r[4] or 0
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert running_sums(df.limit(0), groups, ["at"], {"rank": F.lit(1)}, Stage(spark, "test")).count() == 0


def test_a_group_of_a_million_rows_is_summed_in_many_tasks(spark):
    df = spark.range(1_000_000, numPartitions=8).selectExpr("if(id % 100 = 0, id, -1) as g", "id as at")
    summed = running_sums(df, ["g"], ["at"], {"rank": F.lit(1)}, Stage(spark, "test"))
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]
    hot = summed.where("g = -1").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()
    assert tuple(hot) == (0, 989_999, 990_000)


def test_fold(spark):
    rows = [(g, k, f"{g}{k}") for g in ("a", "b", None) for k in range(3000)] + [("c", 0, "c0")]
    df = spark.createDataFrame(rows, "g string, k long, t string").repartition(7)

    def step(s, rows):
        s["n"] += rows.num_rows
        s["last"] = rows.column("k").to_pylist()[-1]
        return [{"n": s["n"], "last": None}] if s["n"] % 1000 == 0 else []

    schema = StructType.fromDDL("n long, last long")
    found = fold(df, ["g"], ["k"], lambda: {"n": 0, "last": None}, step, lambda s: [s], schema).where("last is not null").collect()
    assert sorted((r.g or "", r.n, r.last) for r in found) == [("", 3000, 2999), ("a", 3000, 2999), ("b", 3000, 2999), ("c", 1, 0)]
    assert fold(df.limit(0), ["g"], ["k"], dict, step, lambda s: [s], schema).count() == 0


def test_a_snapshot_and_a_step_of_many_rows(spark):
    n = 300_000
    docs = spark.range(n, numPartitions=6).selectExpr("1 as s", "id")
    got = search.snapshot_fingerprint(docs, "s", F.lpad(F.col("id").cast("string"), 8, "0"), F.lit("d"), "h\n").first()
    digest = hashlib.sha256(b"h\n")
    for k in range(n):
        digest.update(f"{k:08}\td\n".encode())
    assert (got.fingerprint, got.documents) == (digest.hexdigest(), n)
    events = spark.range(n, numPartitions=6).selectExpr("1L as step_id", "id as seq", "id as at", "'w' as owner", "if(id = 0, 'claim', 'heartbeat') as op", "true as retryable")
    out = state.lease_replay(events).agg(F.bool_and("accepted"), F.max("attempt"), F.count(F.lit(1))).first()
    assert tuple(out) == (True, 1, n)


def test_asof_join(spark):
    rng = random.Random(3)
    prices = [(rng.choice(["a", "a", "a", "b", None]), at, at * 10) for at in rng.sample(range(2000), 400)] + [("a", None, 1)]
    calls = [(k, rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(0, 2100, 3)])) for k in range(3000)]
    left, right = spark.createDataFrame(calls, "call int, k string, at int").repartition(6), spark.createDataFrame(prices, "k string, since int, price int").repartition(3)
    found = asof_join(left, right, ["k"], "at", "since", ["since", "price"], Stage(spark, "test")).collect()
    want = []
    for call, k, at in calls:
        best = max(((s, p) for key, s, p in prices if key == k and k is not None and s is not None and at is not None and s <= at), default=(None, None))
        want.append((call, k, at, *best))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert asof_join(left, right.limit(0), ["k"], "at", "since", ["price"], Stage(spark, "test")).where("price is null").count() == 3000
    assert asof_join(left.limit(0), right, ["k"], "at", "since", ["price"], Stage(spark, "test")).count() == 0
