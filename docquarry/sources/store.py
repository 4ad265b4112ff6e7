"""A content-addressed table, and files of a folder, through Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.documents import content_reason


class ContentStore:
    """Bytes by their SHA-256, in a Parquet table partitioned by the digest's first two digits.

    ``put`` appends what the table lacks: distinct digests are found by a sum by key, and only the partitions that they
    fall in are read. Two writers at once may both append one digest, so ``contents`` gives each once.
    """

    SCHEMA = "sha256 string, size long, content binary, prefix string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def contents(self) -> DataFrame:
        """(sha256, size, content), each digest once; empty before the first ``put``."""
        return self._table().dropDuplicates(["sha256"]).select("sha256", "size", "content")

    def put(self, rows: DataFrame, content: Column) -> DataFrame:
        """``rows`` with sha256 of ``content`` (null: none); new contents are in the table then."""
        held = rows.withColumn("sha256", F.sha2(content.cast("binary"), 256))
        offered = rows.select(content.cast("binary").alias("content")).where("content is not null")
        offered = offered.withColumn("sha256", F.sha2("content", 256)).groupBy("sha256").agg(F.first("content").alias("content"))
        offered = offered.withColumn("prefix", F.substring("sha256", 1, 2))
        known = self._table().select("sha256", "prefix")
        fresh = offered.join(known, ["sha256", "prefix"], "left_anti").select("sha256", F.length("content").cast("long").alias("size"), "content", "prefix")
        fresh.write.mode("append").partitionBy("prefix").parquet(self.path)
        return held

    def get(self, wanted: DataFrame) -> DataFrame:
        """(sha256, content) of the digests in ``wanted`` (sha256)."""
        return self.contents().join(wanted.select("sha256").distinct(), "sha256", "left_semi").select("sha256", "content")

    def _table(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)


def folder_files(spark: SparkSession, path: str, most: int = 512 * 1024) -> DataFrame:
    """(path, size, sha256, reason, content) of all files below ``path``; files that their bytes keep out have a reason and no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    reason = content_reason(F.col("content"), most)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), reason.alias("reason"), F.when(reason.isNull(), F.col("content")).alias("content"))
