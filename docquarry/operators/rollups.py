"""Usage by sketches that are kept for each day and merged for any period and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches: 2 ** LG_HLL registers (standard error 0.83 / 2 ** (LG_HLL / 2)), and the k of KLL (rank error about 1.65 % at 200).
LG_HLL = 12
KLL_K = 400
DISTINCT_ERROR = 4 * 0.83 / 2 ** (LG_HLL / 2)
RANK_ERROR = 0.02


def daily(calls: DataFrame, keys: list[str], day: Column, user: Column, value: Column) -> DataFrame:
    """(keys, day, calls, total, users, values): sums, a sketch of distinct users and one of the values' distribution.

    Rows meet as partial sums and sketches, so a hot key costs a row a task. What is stored grows with days and keys, not with calls.
    """
    own = calls.select(*keys, day.alias("day"), user.alias("_u"), value.cast("long").alias("_v"))
    return own.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("calls"), F.sum("_v").alias("total"), F.hll_sketch_agg("_u", F.lit(LG_HLL)).alias("users"), F.kll_sketch_agg_bigint("_v", F.lit(KLL_K)).alias("values"))


def rolled_up(stored: DataFrame, sets: list[list[str]], quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(keys, calls, total, users, q0, q1, ...) for each of ``sets`` of keys, by merging the daily rows; keys outside a set are null.

    Users are within ``DISTINCT_ERROR`` of their number (four standard errors), a quantile's rank within ``RANK_ERROR``.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    merged = stored.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys)).agg(
        F.sum("calls").alias("calls"), F.sum("total").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.kll_merge_agg_bigint("values", F.lit(KLL_K)).alias("_values")
    )
    return merged.select(*keys, "calls", "total", "users", *(F.kll_sketch_get_quantile_bigint("_values", F.lit(q)).alias(f"q{k}") for k, q in enumerate(quantiles)))
