"""Archives: written and read back, and nothing left of a job that failed."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from docquarry.sources import bundles


def rows(spark):
    text = spark.range(40).selectExpr("concat('doc/', id % 5) as document", "concat('f', id % 2, '.md') as name", "id as place", "concat('part ', id, ' äß\n') as part")
    return text.select("document", "name", F.struct("name", "place").alias("place"), "part")


def test_round_trip(spark, tmp_path):
    found = bundles.save_bundles(spark, rows(spark), f"file://{tmp_path}/out").collect()
    want = {}
    for r in rows(spark).orderBy("place").collect():
        want[r.document, r.name] = want.get((r.document, r.name), "") + r.part
    assert {(r.document, r.name): r.part for r in found} == want
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"doc%2F{k}.zip" for k in range(5))
    more = bundles.save_bundles(spark, rows(spark).withColumn("document", F.lit("other")), f"file://{tmp_path}/out")
    assert more.select("document").distinct().count() == 6
    assert bundles.save_bundles(spark, rows(spark).limit(0), f"file://{tmp_path}/empty").count() == 0 if os.path.isdir(tmp_path / "empty") else True


def test_a_failed_job_leaves_no_archive(spark, tmp_path):
    spark.dataSource.register(bundles.BundleSource)
    bad = bundles.bundle_rows(rows(spark)).withColumn("part", F.when(F.col("part").startswith("part 39"), F.raise_error(F.lit("lost"))).otherwise(F.col("part")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("bundles").mode("append").save(f"file://{tmp_path}/out")
    assert [n for n in os.listdir(tmp_path / "out") if n.endswith(".zip")] == []


def test_a_document_in_several_tasks_is_refused(spark, tmp_path):
    spark.dataSource.register(bundles.BundleSource)
    dealt = rows(spark).select("document", "name", "part").repartition(4, "part").sortWithinPartitions("document", "name")
    with pytest.raises(Exception, match="several tasks"):
        dealt.write.format("bundles").mode("append").save(f"file://{tmp_path}/out")
    assert os.listdir(tmp_path / "out") == []
