"""Streams give what batches give."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from docquarry.operators import state
from docquarry.streaming import leases, logs


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    run(logs.event_counts(stream, "event_type", "ts", late="400 days"), "counts", "complete")
    expected = events.groupBy("event_type", F.window("ts", "1 hour").start.alias("start")).count().collect()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, expected))
    run(logs.first_arrivals(stream, "ts", "event_type", "400 days"), "firsts", "append")
    assert sorted(r.event_type for r in spark.table("firsts").collect()) == sorted(r[0] for r in events.select("event_type").distinct().collect())
    run(logs.sessions(stream, "user_id", "ts", late="400 days"), "sessions", "complete")
    assert spark.table("sessions").agg(F.sum("events")).first()[0] == events.count()


def test_leases_as_a_stream_are_those_of_the_log(spark, tmp_path):
    ops = ["claim", "heartbeat", "claim", "complete", "fail", "claim", "heartbeat"]
    rows = [(k % 5, k, 10_000 + k * 20 + (k % 7) * 3, f"w{k * 3 % 4}", ops[k * 11 % 7], k % 3 > 0) for k in range(200)]
    schema = "step_id long, seq long, at long, owner string, op string, retryable boolean"
    order = sorted(rows, key=lambda r: r[1] // 20 * 20 + (r[1] * 13) % 27)  # later ones come before earlier ones, across files
    for n in range(8):
        part = order[n * 25 : n * 25 + 25] + order[max(0, n * 25 - 3) : n * 25]  # the last three come again
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        time.sleep(0.05)
    spark.createDataFrame([(99, 0, 10**6, "w", "claim", True)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with pytest.raises(ValueError, match="providerClass"):
        leases.leases(stream)
    spark.conf.set(key, leases.ROCKSDB)
    try:
        run(leases.leases(stream, lease=50, late="3 hours"), "leases", "append")
    finally:
        spark.conf.set(key, before)
    found = sorted(map(tuple, spark.table("leases").where("op <> 'expired' and step_id < 99").collect()))
    want = sorted(map(tuple, state.lease_replay(spark.createDataFrame(rows, schema), lease=50).collect()))
    assert found == want and {r[3] for r in found} == {True, False}


def test_a_lease_that_nobody_keeps_is_told(spark, tmp_path):
    schema = "step_id long, seq long, at long, owner string, op string, retryable boolean"
    for n, at in enumerate((10_000, 20_000, 30_000, 40_000, 50_000)):
        spark.createDataFrame([(min(n, 1), n, at, "w", "claim", True)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, leases.ROCKSDB)
    try:
        run(leases.leases(stream, lease=50), "expiries", "append")
    finally:
        spark.conf.set(key, before)
    assert [(r.seq, r.op, r.status) for r in spark.table("expiries").where("step_id = 0").collect()] == [(0, "claim", "running"), (0, "expired", "running")]


def test_wakeups_come_once(spark, tmp_path):
    rows = [(k // 3, "a" if k % 3 < 2 else "b", k) for k in range(30)] * 2
    spark.createDataFrame(rows, "run long, decision string, at long").selectExpr("run", "decision", "timestamp_seconds(at) as at").write.parquet(f"{tmp_path}/w")
    stream = spark.readStream.schema("run long, decision string, at timestamp").parquet(f"{tmp_path}/w")
    run(leases.first_wakeups(stream, "at", "run", F.col("decision")), "wakeups", "append")
    assert sorted((r.run, r.decision) for r in spark.table("wakeups").collect()) == sorted({(r[0], r[1]) for r in rows})
