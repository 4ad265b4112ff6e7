"""Usage, cost in exact decimals, and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.ordered import running_sums
from docquarry.sources.stage import Stage

#: Price per million tokens (fresh input, cached input, output).
PRICES = (
    ("deepseek-v4-flash", "0.14", "0.0028", "0.28"),
    ("deepseek-v4-pro", "0.435", "0.003625", "0.87"),
    ("deepseek-chat", "0.14", "0.0028", "0.28"),
    ("deepseek-reasoner", "0.14", "0.0028", "0.28"),
)


def price_book(spark: SparkSession) -> DataFrame:
    """(model, fresh, cached, output) as decimal(12,6)."""
    rows = spark.createDataFrame(PRICES, "model string, fresh string, cached string, output string")
    return rows.select("model", *(F.col(c).cast("decimal(12,6)").alias(c) for c in ("fresh", "cached", "output")))


def with_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``calls`` with cost decimal(12,6), half up, and ``priced``; models without a price have none."""
    joined = calls.join(F.broadcast(prices), "model", "left")  # a price list, four rows
    long = lambda c: F.col(c).cast("decimal(20,0)")
    million = F.lit("1000000").cast("decimal(7,0)")
    total = (long("input_tokens") - long("cached_tokens")) * F.col("fresh") + long("cached_tokens") * F.col("cached") + long("output_tokens") * F.col("output")
    return joined.withColumn("cost", F.round(total.cast("decimal(38,6)") / million, 6).cast("decimal(12,6)")).withColumn("priced", F.col("fresh").isNotNull()).drop("fresh", "cached", "output")


def rollup(calls: DataFrame, by: str) -> DataFrame:
    """Field-wise sums by key."""
    return calls.groupBy(by).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").cast("decimal(22,6)").alias("cost")
    )


def within_budget(calls: DataFrame, by: str, order: str, budget: int) -> DataFrame:
    """Calls up to and with the one whose running total crosses ``budget`` tokens; later ones stop. Calls of any number share a key."""
    tokens = F.col("input_tokens") + F.col("output_tokens")
    return running_sums(calls, [by], [order], {"spent_before": tokens}, Stage(calls.sparkSession, "budget")).where(F.col("spent_before") <= budget)
