"""Intermediate tables in the folder that driver and executors share.

A long plan is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it again.
A lost executor then costs the running tasks only, and the reread table has known statistics.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for local sessions that name none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='docquarry-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def short_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Let Arrow batches hold at most so many rows: with long texts the default of 10,000 takes much memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def unused(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: 64-bit words of ``sifted``'s bits: a broadcast of at most so many rows, whatever the number of ids.
SIFT_WORDS = 1 << 19


def sifted(rows: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only if ``key`` is certainly not in ``ids`` (one column).

    One bit for each hash of an id, in a table that is bounded by ``SIFT_WORDS`` and so may be broadcast; rows that are not flagged
    need no shuffle to meet ``ids``. With very many ids all bits are set and every row is flagged: it then saves nothing and loses nothing.
    """
    place, word, bits = (unused(n, rows) for n in ("_place", "_word", "_bits"))
    at = lambda c: F.pmod(F.xxhash64(c, F.lit(31)), F.lit(64 * SIFT_WORDS))
    mask = F.expr(f"shiftleft(1L, cast(`{place}` % 64 as int))")
    held = ids.select(at(F.col(ids.columns[0])).alias(place)).groupBy(F.floor(F.col(place) / 64).alias(word)).agg(F.bit_or(mask).alias(bits))
    joined = rows.withColumn(place, at(F.col(f"`{key}`"))).join(F.broadcast(held), F.floor(F.col(place) / 64) == F.col(word), "left")
    return joined.withColumn(flag, F.coalesce(F.col(bits).bitwiseAND(mask) != 0, F.lit(False))).drop(place, word, bits)


class Scratch:
    """Named tables of one run of an operator, below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/docquarry/{name}-{uuid.uuid4().hex}"
        self.labels: set[str] = set()
        atexit.register(self.clear)

    def path(self, label: str) -> str:
        return f"{self.folder}/{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it again; the lineage ends here."""
        df.write.mode("overwrite").parquet(self.path(label))
        self.labels.add(label)
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, label: str) -> None:
        """Delete a table that no later plan reads."""
        self._delete(self.path(label))
        self.labels.discard(label)

    def keep(self, *labels: str) -> None:
        """Delete all tables but those that the result still reads."""
        for label in self.labels.difference(labels):
            self.drop(label)

    def clear(self) -> None:
        """Delete everything; for the end of the application, as results are read lazily."""
        try:
            self._delete(self.folder)
        except Exception as error:  # the JVM may have ended before
            del error

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
