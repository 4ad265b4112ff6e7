"""Queries on usage and cost; the turns of ``conversations`` stand for model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import ledger, rollups
from docquarry.operators.ordered import asof_join
from docquarry.sources.stage import Stage
from docquarry.sources.tables import table

_CALLS = """
    SELECT conv_id, turn,
           CASE CAST(conv_id % 5 AS INT) WHEN 0 THEN 'deepseek-v4-flash' WHEN 1 THEN 'deepseek-v4-pro' WHEN 2 THEN 'deepseek-chat' WHEN 3 THEN 'deepseek-reasoner' ELSE 'other' END AS model,
           CAST(length(text) * 997 AS BIGINT) AS input_tokens, CAST(length(text) * (turn % 3) * 101 AS BIGINT) AS cached_tokens, CAST(length(text) * 13 + turn AS BIGINT) AS output_tokens
    FROM conversations"""


def _calls(spark, sf_dir):
    return spark.sql(_CALLS.replace("FROM conversations", "FROM {calls}"), calls=table(spark, sf_dir, "conversations"))


def _cost(spark, sf_dir):
    priced = ledger.with_cost(_calls(spark, sf_dir), ledger.price_book(spark))
    return priced.selectExpr("conv_id", "turn", "model", "priced", "cast(cost as string) as cost")


def _rollup(spark, sf_dir):
    priced = ledger.with_cost(_calls(spark, sf_dir), ledger.price_book(spark))
    return ledger.rollup(priced, "model").selectExpr("model", "calls", "input_tokens", "cached_tokens", "output_tokens", "cast(cost as string) as cost")


def _budget(spark, sf_dir):
    return ledger.within_budget(_calls(spark, sf_dir), "conv_id", "turn", 400000).select("conv_id", "turn", "spent_before")


#: Prices over time: each row of ``part`` changes one model's price.
_CHANGES = "SELECT CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'deepseek-v4-flash' WHEN 1 THEN 'deepseek-v4-pro' WHEN 2 THEN 'deepseek-chat' WHEN 3 THEN 'retired' END AS model, p_partkey * 7 + p_partkey % 7 AS since, p_retailprice AS price FROM part"


def _as_of(spark, sf_dir):
    calls = _calls(spark, sf_dir).selectExpr("conv_id", "turn", "model", "conv_id * 23 + turn AS at")
    changes = spark.sql(_CHANGES.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return asof_join(calls, changes, ["model"], "at", "since", ["since", "price"], Stage(spark, "asof")).drop("at")


def _sketches(spark, sf_dir):
    """Rolled-up sketches beside exact figures: counts and sums are equal, estimates within the stated errors."""
    events = table(spark, sf_dir, "events").selectExpr("event_type AS model", "concat('p', user_id % 7) AS project", "to_date(ts) AS day", "user_id", "cast(value * 100 as bigint) AS cents")
    stored = Stage(spark, "rollups").save(rollups.daily(events, ["model", "project"], F.col("day"), F.col("user_id"), F.col("cents")), "daily")
    every = F.lit("(all)")
    found = rollups.rolled_up(stored, [["model", "project"], ["model"], ["project"], []]).withColumns({c: F.coalesce(c, every) for c in ("model", "project")})
    sets = F.array(*(F.struct(m.alias("model"), p.alias("project")) for m in (F.col("model"), every) for p in (F.col("project"), every)))
    each = events.select(F.explode(sets).alias("k"), "user_id", "cents").select("k.*", "user_id", "cents").join(found.select("model", "project", "q0", "q1"), ["model", "project"])
    below = lambda q: [F.count_if(F.col("cents") <= F.col(q)).alias(f"upto_{q}"), F.count_if(F.col("cents") < F.col(q)).alias(f"under_{q}")]
    exact = each.groupBy("model", "project").agg(F.count_distinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n"), *below("q0"), *below("q1"))
    near = lambda q, at: (F.col(f"upto_{q}") / F.col("n") >= at - rollups.RANK_ERROR) & (F.col(f"under_{q}") / F.col("n") <= at + rollups.RANK_ERROR)
    users = F.abs(F.col("users") - F.col("n_users")) <= F.greatest(F.lit(1.0), rollups.DISTINCT_ERROR * F.col("n_users"))
    return found.join(exact, ["model", "project"]).select("model", "project", "calls", "total", users.alias("users_near"), near("q0", 0.5).alias("median_near"), near("q1", 0.95).alias("high_near"))


QUERIES = {"llm_cost": _cost, "usage_rollup": _rollup, "budget_cutoff": _budget, "price_as_of": _as_of, "usage_sketches": _sketches}

_PRICED = f"""
    c AS ({_CALLS}),
    p(model, fresh, cached, output) AS (VALUES {", ".join(f"('{m}', {a}::DECIMAL(12,6), {b}::DECIMAL(12,6), {o}::DECIMAL(12,6))" for m, a, b, o in ledger.PRICES)}),
    x AS (SELECT c.*, p.fresh IS NOT NULL AS priced,
                 ((((input_tokens - cached_tokens)::HUGEINT * (fresh * 1000000)::HUGEINT + cached_tokens::HUGEINT * (cached * 1000000)::HUGEINT + output_tokens::HUGEINT * (output * 1000000)::HUGEINT) + 500000) // 1000000) AS micro
          FROM c LEFT JOIN p USING (model)),
    y AS (SELECT *, (micro::DECIMAL(30,0) / 1000000)::DECIMAL(12,6) AS cost FROM x)"""

ORACLE = {
    "llm_cost": f"WITH {_PRICED} SELECT conv_id, turn, model, priced, cost::VARCHAR AS cost FROM y",
    "usage_rollup": f"""WITH {_PRICED} SELECT model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(cached_tokens)::BIGINT AS cached_tokens,
        sum(output_tokens)::BIGINT AS output_tokens, sum(cost)::DECIMAL(22,6)::VARCHAR AS cost FROM y GROUP BY model""",
    "price_as_of": f"""
        WITH c AS (SELECT conv_id, turn, model, conv_id * 23 + turn AS at1 FROM ({_CALLS}) x), p AS ({_CHANGES})
        SELECT c.conv_id, c.turn, c.model, p.since, p.price FROM c ASOF LEFT JOIN p ON c.model = p.model AND c.at1 >= p.since""",
    "usage_sketches": """
        WITH e AS (SELECT event_type AS model, 'p' || user_id % 7 AS project, CAST(trunc(value * 100) AS BIGINT) AS cents FROM events)
        SELECT coalesce(model, '(all)') AS model, coalesce(project, '(all)') AS project, count(*) AS calls, sum(cents)::BIGINT AS total, true AS users_near, true AS median_near, true AS high_near
        FROM e GROUP BY GROUPING SETS ((model, project), (model), (project), ())""",
    "budget_cutoff": f"""
        WITH c AS ({_CALLS}), s AS (SELECT conv_id, turn, coalesce(sum(input_tokens + output_tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM c)
        SELECT * FROM s WHERE spent_before <= 400000""",
}
