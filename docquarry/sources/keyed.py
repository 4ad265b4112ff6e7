"""A stored table that is changed by key: only partitions that hold a changed key are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from docquarry.sources.stage import Stage


class KeyedTable:
    """Rows with distinct ``keys`` below ``folder``, in ``buckets`` partitions by a hash of the keys."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder, keys, buckets
        self.schema = StructType.fromDDL(schema)
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            self._write(self._bucketed(spark.createDataFrame([], self.schema)), "append")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, mode: str) -> None:
        # a bucket is one task's, so that it has one file
        dealt = rows.repartition(self.buckets, "_bucket")
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.folder)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", IntegerType())])).parquet(self.folder)

    def rows(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def apply(self, changes: DataFrame, order: str, deleted: str) -> list[int]:
        """Bring in ``changes``: the table's columns, ``order`` and whether the key is ``deleted``; the last change of a key counts;
        of some at one place in the order a write rather than a delete, the greatest one.

        Buckets that hold a changed key are read, merged, written aside and then put in place of the old ones; others aren't touched.
        Returned are their numbers, ``buckets`` at most.
        """
        columns, others = self.schema.names, [c for c in self.schema.names if c not in self.keys]
        last = changes.groupBy(*self.keys).agg(F.max_by(F.struct(*others, F.col(deleted).alias("_gone")), F.struct(order, ~F.col(deleted), *others)).alias("_r")).select(*self.keys, "_r.*")
        stage = Stage(self.spark, "keyed")
        own = stage.save(self._bucketed(last), "changes")
        touched = sorted(r._bucket for r in own.select("_bucket").distinct().collect())
        if not touched:
            return []
        kept = self._stored().where(F.col("_bucket").isin(touched)).join(own.select(*self.keys), self.keys, "left_anti").select(*columns, "_bucket")
        merged = stage.save(kept.unionByName(own.where("not _gone").select(*columns, "_bucket")), "merged")
        filled = {r._bucket for r in merged.select("_bucket").distinct().collect()}
        self._write(merged, "overwrite")
        for bucket in set(touched) - filled:  # nothing is left in it
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_bucket={bucket}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return touched
