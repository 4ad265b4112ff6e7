"""Ranks within a key that no task has to see as a whole."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, key: str, spread: Column, order: list[Column], rows: int, rank: str = "rank") -> DataFrame:
    """Add ``rank``: 0, 1, ... within each ``key``, in an order that is fixed by ``spread`` and ``order``.

    Rows are numbered within (key, salt), salt = hash of ``spread`` modulo the root of the number of rows;
    each salt then starts where the ones before it in its key end. A key with a third of all rows so
    meets in groups of about root-of-n rows, and its table of counts has root-of-n rows, too.
    ``df`` is read twice and must give the same rows each time (a stored table).
    """
    salts = max(1, math.isqrt(max(rows, 1)))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    counts = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_key"), F.col("_salt").alias("_salt2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = salted.withColumn("_row", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1)
    joined = local.join(starts, local[key].eqNullSafe(starts["_key"]) & (local["_salt"] == starts["_salt2"]))
    return joined.withColumn(rank, F.col("_start") + F.col("_row")).drop("_salt", "_salt2", "_key", "_start", "_row")
