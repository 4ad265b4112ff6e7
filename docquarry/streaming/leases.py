"""Leases of steps as a stateful stream, and wake-ups that are delivered more than once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docquarry.operators.state import lease_step

#: The state store that timers and several states of a key need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "step_id long, seq long, op string, accepted boolean, status string, attempt int"


class LeaseProcessor(StatefulProcessor):
    """One step's lease. Events wait until the watermark has passed them, so late ones take their place in the order;
    then they are applied as in ``lease_replay``. A timer at the end of each lease tells when nobody has kept it."""

    def __init__(self, lease: int, attempts: int):
        self.lease, self.attempts = lease, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "status string, owner string, until long, attempt int, last long")
        self.waiting = handle.getMapState("waiting", "seq long", "at long, owner string, op string, retryable boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[4] if self.state.exists() else None
        for batch in rows:
            for seq, at, owner, op, retryable in zip(*(batch[c].tolist() for c in ("seq", "at", "owner", "op", "retryable"))):
                if (last is None or seq > last) and not self.waiting.containsKey((seq,)):  # else it came before
                    self.waiting.updateValue((seq,), (at, owner, op, bool(retryable)))
                    self.handle.registerTimer(at * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        status, owner, until, attempt, last = self.state.get() if self.state.exists() else ("pending", None, 0, 0, -1)
        state, out = {"status": status, "owner": owner, "until": until, "attempt": attempt}, []
        due = sorted((k[0], v) for k, v in self.waiting.iterator() if v[0] <= now)
        for seq, (at, who, op, retryable) in due:
            self.waiting.removeKey((seq,))
            ok = lease_step(state, op, at, who, retryable, self.lease, self.attempts)
            out.append((key[0], seq, op, ok, state["status"], state["attempt"]))
            last = max(last, seq)
            if ok and state["status"] == "running":
                self.handle.registerTimer(state["until"] * 1000)
        if not due and state["status"] == "running" and state["until"] == now:
            out.append((key[0], last, "expired", False, state["status"], state["attempt"]))
        self.state.update((state["status"], state["owner"], state["until"], state["attempt"], last))
        if out:
            yield pd.DataFrame(out, columns=["step_id", "seq", "op", "accepted", "status", "attempt"])

    def close(self) -> None:
        pass


def leases(stream: DataFrame, lease: int = 300, attempts: int = 3, late: str = "10 minutes") -> DataFrame:
    """(step_id, seq, op, accepted, status, attempt) of a stream of step events (step_id, seq, at: seconds, owner, op, retryable).

    What ``lease_replay`` gives for the same events, if none is later than ``late``; events delivered again are dropped. Besides, a row
    ``expired`` tells that a lease has ended without its holder or anybody else having come. The session needs ``ROCKSDB``
    as its state store; state is a row a step and the events that wait.
    """
    spark: SparkSession = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    timed = stream.withColumn("_time", F.timestamp_seconds("at")).withWatermark("_time", late)
    return timed.groupBy("step_id").transformWithStateInPandas(LeaseProcessor(lease, attempts), _OUT, "Append", "EventTime")


def first_wakeups(stream: DataFrame, at: str, key: str, decision: Column, late: str = "1 hour") -> DataFrame:
    """Wake-ups of which none with their key and decision has come within ``late`` before; adds ``decision_digest``."""
    digested = stream.withColumn("decision_digest", F.sha2(F.coalesce(decision, F.lit("")).cast("binary"), 256))
    return digested.withWatermark(at, late).dropDuplicatesWithinWatermark([key, "decision_digest"])
