"""Written tables that cut long plans, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Stage:
    """Tables of one run of an iterative operator, below ``spark.checkpoint.dir``.

    A lost executor then costs the running tasks only. Local sessions that name no folder (tests) get a temporary one.
    """

    def __init__(self, spark: SparkSession, name: str):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='docquarry-')}"
            spark.conf.set("spark.checkpoint.dir", folder)
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/docquarry/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """``df``, written and read again."""
        path = f"{self.folder}/{label}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete the tables; for the end of the application, as results are read lazily."""
        try:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception as error:  # the JVM may have ended before
            del error
