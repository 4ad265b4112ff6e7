"""Runs, steps and sessions replayed from event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docquarry.operators.ordered import fold

#: Allowed moves between run states, and phases in order.
MOVES = (
    ("pending", "running"), ("pending", "cancelled"), ("running", "suspended"), ("running", "succeeded"), ("running", "failed"), ("running", "cancelled"),
    ("suspended", "running"), ("suspended", "failed"), ("suspended", "cancelled"),
)
PHASES = ("queued", "discover", "snapshot", "parse", "index", "analyze", "outline", "human_interrupt", "chapters", "diagrams", "validate", "publish")


def transitions(events: DataFrame) -> DataFrame:
    """(run_id, seq, status_ok, phase_ok): each event of (run_id, seq, status, phase) against the one before it."""
    w = Window.partitionBy("run_id").orderBy("seq")
    step = events.withColumn("_s", F.lag("status").over(w)).withColumn("_p", F.lag("phase").over(w))
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, b in MOVES))
    order = F.array(*(F.lit(p) for p in PHASES))
    at = lambda c: F.array_position(order, F.col(c))
    status = F.col("_s").isNull() | (F.col("_s") == F.col("status")) | F.array_contains(allowed, F.concat("_s", F.lit(">"), "status"))
    phase = F.col("_p").isNull() | (at("phase") >= at("_p")) | ((F.col("_p") == "human_interrupt") & (F.col("phase") == "outline"))
    return step.select("run_id", "seq", F.coalesce(status, F.lit(False)).alias("status_ok"), F.coalesce(phase, F.lit(False)).alias("phase_ok"))


def sessions(events: DataFrame, by: str, at: str, idle: str = "2 hours", absolute: str = "12 hours") -> DataFrame:
    """(by, started, ended, events): a gap above ``idle`` ends a session; ``absolute`` caps what one may last, marked."""
    w = Window.partitionBy(by).orderBy(at)
    gap = F.col(at) > F.lag(at).over(w) + F.expr(f"interval {idle}")
    numbered = events.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("_n", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(by, "_n").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("events"))
    return out.select(by, "started", "ended", "events", (F.col("ended") > F.col("started") + F.expr(f"interval {absolute}")).alias("over"))


def latest(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last row of each key; kept by a comparison that merges before the shuffle."""
    others = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(by, "_r.*")


def lease_replay(events: DataFrame, lease: int = 300, attempts: int = 3) -> DataFrame:
    """(step_id, seq, op, accepted, status, attempt): claims, heartbeats, completions and failures folded in order.

    A live lease of another owner refuses a claim, its own owner enters again without an attempt, an expired one of another
    is taken over; more than ``attempts`` fail the step. Only the holder may beat, complete or fail, as long as nobody has taken over; a
    retryable failure with attempts left makes the step pending. A step's events pass by in batches.
    """

    columns = [events.columns[k] for k in map([c.lower() for c in events.columns].index, ("seq", "op", "at", "owner", "retryable"))]

    def step(state, rows):
        out = []
        for seq, op, at, owner, retryable in zip(*(rows.column(c).to_pylist() for c in columns)):
            ok = lease_step(state, op, at, owner, retryable, lease, attempts)
            out.append({"seq": seq, "op": op, "accepted": ok, "status": state["status"], "attempt": state["attempt"]})
        return out

    start = lambda: {"status": "pending", "owner": None, "until": 0, "attempt": 0}
    return fold(events, ["step_id"], ["seq"], start, step, lambda state: [], StructType.fromDDL("seq long, op string, accepted boolean, status string, attempt int"))


def lease_step(state: dict, op: str, at: int, owner: str, retryable: bool, lease: int, attempts: int) -> bool:
    """Whether a step takes an event; ``state`` (status, owner, until, attempt) becomes what it is after it."""
    holds = state["status"] == "running" and state["owner"] == owner  # also beyond its time, until somebody takes over
    if op == "claim" and state["status"] not in ("succeeded", "failed", "cancelled"):
        if holds:
            state["until"] = at + lease
            return True
        if state["status"] == "pending" or state["until"] <= at:
            state["attempt"] += 1
            if state["attempt"] > attempts:
                state["status"] = "failed"
                return False
            state.update(status="running", owner=owner, until=at + lease)
            return True
    elif op == "heartbeat" and holds:
        state["until"] = at + lease
        return True
    elif op == "complete" and holds:
        state["status"] = "succeeded"
        return True
    elif op == "fail" and holds:
        state.update(status="pending" if retryable and state["attempt"] < attempts else "failed", owner=None)
        return True
    return False


def visible_projects(projects: DataFrame, members: DataFrame, users: DataFrame, user: int) -> DataFrame:
    """The ``projects`` that one of ``users`` (user_id, is_admin, is_active) sees.

    An administrator sees all, others what they own or are a member of; an inactive or unknown user sees none. Whether the user
    is one or the other are scalar subqueries, so the projects are read once.
    """
    own = users.where(F.col("user_id") == user)
    holds = lambda c: own.agg(F.coalesce(F.bool_or(c), F.lit(False))).scalar()
    mine = members.where(F.col("user_id") == user).select(F.col("project_id").alias("_p")).distinct()
    joined = projects.join(mine, F.col("project_id") == F.col("_p"), "left")
    return joined.where(holds("is_active") & (holds("is_admin") | (F.col("owner_id") == user) | F.col("_p").isNotNull())).drop("_p")
