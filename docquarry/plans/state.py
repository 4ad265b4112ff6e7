"""Queries on logs; ``events`` stands for run, step and session logs."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators import state
from docquarry.sources.tables import table

_RUNS = f"""
    SELECT user_id AS run_id, event_id AS seq,
           CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'suspended' WHEN 3 THEN 'succeeded' WHEN 4 THEN 'failed' ELSE 'cancelled' END AS status,
           CASE CAST(event_id % 12 AS INT) {" ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(state.PHASES))} END AS phase
    FROM events"""
_STEPS = """
    SELECT user_id AS step_id, event_id AS seq, event_id * 40 AS at, CAST(event_id % 2 AS STRING) AS owner, event_id % 5 <> 0 AS retryable,
           CASE event_type WHEN 'view' THEN 'claim' WHEN 'signup' THEN 'heartbeat' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'claim' END AS op
    FROM events"""


def _of(sql):
    return lambda spark, sf_dir: spark.sql(sql.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def _sessions(spark, sf_dir):
    out = state.sessions(table(spark, sf_dir, "events"), "user_id", "ts")
    return out.selectExpr("user_id", "date_format(started, 'yyyy-MM-dd HH:mm:ss') AS started", "date_format(ended, 'yyyy-MM-dd HH:mm:ss') AS ended", "events", "over")


def _latest(spark, sf_dir):
    return state.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def _visible(spark, sf_dir):
    projects = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS project_id", "o_custkey AS owner_id")
    members = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS project_id", "l_suppkey AS user_id")
    users = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS user_id", "s_suppkey % 5 = 3 AS is_admin", "s_suppkey % 9 <> 4 AS is_active")
    seen = [state.visible_projects(projects, members, users, u).withColumn("user_id", F.lit(u).cast("long")) for u in _USERS]
    return functools.reduce(DataFrame.unionByName, seen)


#: A member, an administrator, and an inactive and an unknown user.
_USERS = (7, 8, 4, 100_000_000)

QUERIES = {
    "transition_audit": lambda spark, sf_dir: state.transitions(_of(_RUNS)(spark, sf_dir)),
    "session_idle": _sessions,
    "latest_per_group": _latest,
    "lease_replay": lambda spark, sf_dir: state.lease_replay(_of(_STEPS)(spark, sf_dir)),
    "visible_projects": _visible,
}

ORACLE = {
    "transition_audit": f"""
        WITH e AS ({_RUNS}), p(phase, i) AS (VALUES {", ".join(f"('{p}', {k})" for k, p in enumerate(state.PHASES))}), m(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in state.MOVES)}),
        l AS (SELECT e.*, i, lag(status) OVER w AS s, lag(e.phase) OVER w AS q, lag(i) OVER w AS j FROM e JOIN p ON e.phase = p.phase WINDOW w AS (PARTITION BY run_id ORDER BY seq))
        SELECT run_id, seq, s IS NULL OR s = status OR EXISTS (SELECT 1 FROM m WHERE a = s AND b = status) AS status_ok,
               j IS NULL OR i >= j OR (q = 'human_interrupt' AND phase = 'outline') AS phase_ok FROM l""",
    "lease_replay": f"""
        WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY seq) AS i FROM ({_STEPS.replace("AS STRING", "AS VARCHAR")})),
        r AS (SELECT DISTINCT step_id, 0::BIGINT AS i, 0::BIGINT AS seq, '' AS op, false AS accepted, 'pending' AS status, '' AS owner, 0::BIGINT AS until, 0 AS attempt FROM e
              UNION ALL
              SELECT e.step_id, e.i, e.seq, e.op, (claims AND holds) OR (fresh AND r.attempt < 3) OR (e.op IN ('heartbeat', 'complete', 'fail') AND holds),
                     CASE WHEN fresh AND r.attempt >= 3 THEN 'failed' WHEN fresh THEN 'running' WHEN e.op = 'complete' AND holds THEN 'succeeded' WHEN e.op = 'fail' AND holds THEN CASE WHEN e.retryable AND r.attempt < 3 THEN 'pending' ELSE 'failed' END ELSE r.status END,
                     CASE WHEN fresh AND r.attempt < 3 THEN e.owner WHEN e.op = 'fail' AND holds THEN '' ELSE r.owner END,
                     CASE WHEN (claims AND holds) OR (fresh AND r.attempt < 3) OR (e.op = 'heartbeat' AND holds) THEN e.at + 300 ELSE r.until END, CASE WHEN fresh THEN r.attempt + 1 ELSE r.attempt END
              FROM r JOIN (SELECT *, 1 AS one FROM e) e ON e.step_id = r.step_id AND e.i = r.i + 1,
              LATERAL (SELECT r.status = 'running' AND r.owner = e.owner AS holds, e.op = 'claim' AND r.status NOT IN ('succeeded', 'failed', 'cancelled') AS claims) v,
              LATERAL (SELECT v.claims AND NOT v.holds AND (r.status = 'pending' OR r.until <= e.at) AS fresh) w)
        SELECT step_id, seq, op, accepted, status, attempt FROM r WHERE i > 0""",
    "session_idle": """
        WITH g AS (SELECT user_id, ts, coalesce((ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR)::INT, 1) AS new FROM events),
        n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS events, max(ts) > min(ts) + INTERVAL 12 HOUR AS over FROM n GROUP BY user_id, n""",
    "latest_per_group": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "visible_projects": f"""
        WITH u AS (SELECT s_suppkey AS user_id, s_suppkey % 5 = 3 AS is_admin FROM supplier WHERE s_suppkey % 9 <> 4 AND s_suppkey IN {_USERS})
        SELECT DISTINCT user_id, o_orderkey AS project_id, o_custkey AS owner_id FROM orders, u
        WHERE is_admin OR o_custkey = user_id OR (o_orderkey, user_id) IN (SELECT l_orderkey, l_suppkey FROM lineitem)""",
}
