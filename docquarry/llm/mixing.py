"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

Time is counted in slots of one block each. Block k of a source with weight w is released at slot floor(k / w) and
due by slot ceil((k + 1) / w); taking, among released blocks, the one due first keeps every source within less
than one block of its share at any slot. With whole-number weights that sum to Q the schedule repeats
every Q slots, so one period is simulated from the weights alone and every document computes its slot.
When a source runs out, a new phase begins with the weights of the remaining ones.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.ranks import rank_within


@dataclass(frozen=True)
class MixParameters:
    block_docs: int = 16  # documents of a block; a source's last block may be shorter
    slots: int = 1 << 16  # most slots of a simulated period
    power: float = 0.5  # without target weights, a source weighs its number of documents to this power, as a whole number


def whole_weights(weights: dict, slots: int) -> dict:
    """Target weights as whole numbers in exactly their ratios, so that a schedule never drifts from them.

    Weights are read as the decimals that they print as. Only if the whole numbers then sum to more than ``slots`` are
    they rounded to that sum, none to zero: such a schedule leaves its targets by at most a block every ``slots`` slots.
    """
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("target weights must be positive")
    scale = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    whole = {s: int(w * scale) for s, w in exact.items()}
    shared = math.gcd(*whole.values()) if whole else 1
    whole = {s: w // shared for s, w in whole.items()}
    total = sum(whole.values())
    return whole if total <= slots else {s: max(1, round(w * slots / total)) for s, w in whole.items()}


def period(weights: dict) -> list:
    """The sources of one period's slots, earliest deadline first among released blocks; ties by source order."""
    total = sum(weights.values())
    waiting = [(0, -(-total // q), place, 0, s) for place, (s, q) in enumerate(weights.items())]  # release, deadline, tie, block
    heapq.heapify(waiting)
    ready: list[tuple] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            release, due, place, k, s = heapq.heappop(waiting)
            heapq.heappush(ready, (due, place, k, s))
        due, place, k, s = heapq.heappop(ready)
        if slot + 1 > due:
            raise AssertionError("a deadline was missed")
        out.append(s)
        if k + 1 < weights[s]:
            q = weights[s]
            heapq.heappush(waiting, ((k + 1) * total // q, -(-(k + 2) * total // q), place, k + 1, s))
    return out


def schedule(blocks: dict, weights: dict) -> list[tuple]:
    """Phases as (source, first block, end block, first slot, blocks a period, slots a period, slots within the period).

    ``blocks`` has each source's number of blocks. Work and result depend on the number of sources and the period,
    not on the number of blocks.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out, slot = [], 0
    while left:
        q = {s: weights[s] for s in left}
        order, total = period(q), sum(q.values())
        slots: dict = {s: [] for s in q}
        for at, s in enumerate(order):
            slots[s].append(at)
        whole = min(left[s] // q[s] for s in q)
        rest = {s: left[s] - whole * q[s] for s in q}
        stop = min((slots[s][rest[s]] for s in q if rest[s] < q[s]), default=total)  # the first block that is missing
        for s in q:
            ahead = whole * q[s] + sum(at < stop for at in slots[s])
            if ahead:
                out.append((s, done[s], done[s] + ahead, slot, q[s], total, slots[s]))
            done[s] += ahead
            left[s] -= ahead
        slot += whole * total + stop
        left = {s: n for s, n in left.items() if n}
    return out


def ordered(docs: DataFrame, weights: dict | None = None, p: MixParameters = MixParameters(), id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with their own columns, as rows in the order of the mix.

    Places are found on ids and sources alone, so whole rows are shuffled twice only, to meet their place and to be
    sorted by it. Rows that share id and source stand together at the first of their places.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_of"))
    places = mix(narrow, weights, p, "_id", "_of").groupBy("_id", "_of").agg(F.min("mix_position").alias("_place"))
    own = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").alias("_id2"), F.col(f"`{source_col}`").alias("_of2"))
    met = own.join(places, F.col("_id").eqNullSafe(F.col("_id2")) & F.col("_of").eqNullSafe(F.col("_of2")))
    return met.select("_row", "_place").orderBy("_place").select("_row.*")


def mix(docs: DataFrame, weights: dict | None = None, p: MixParameters = MixParameters(), id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with mix_block, mix_slot, mix_release, mix_deadline and mix_position.

    A source's documents are put in a hashed order and cut into blocks; mix_slot is a block's slot, mix_position the
    document's place in the whole mix. Release and deadline are absolute slots. Sources without a target
    weight get the smallest given one; without ``weights`` see ``power``. A null source is a source of its own. Repeated
    rows are separate documents. An empty table gives an empty result. Gathered are counts by source only.
    A column whose name clashes with one of the five is replaced.
    """
    spark = docs.sparkSession
    names = ["mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position"]
    counts = {r[0]: r[1] for r in docs.groupBy(F.col(source_col)).agg(F.count(F.lit(1))).collect()}
    order = sorted(counts, key=lambda s: (s is None, str(s)))
    chosen = {s: (weights or {}).get(s, min(weights.values(), key=lambda w: Fraction(str(w))) if weights else max(1, round(counts[s] ** p.power))) for s in order}
    plan = schedule({s: -(-counts[s] // p.block_docs) for s in order}, whole_weights(chosen, p.slots))
    numbers = {s: k for k, s in enumerate(order)}
    rows = [(numbers[s], low, high, slot, q, total, at) for s, low, high, slot, q, total, at in plan]
    phases = spark.createDataFrame(rows, "_number int, _low long, _high long, _slot long, _q long, _total long, _at array<int>")
    keys = spark.createDataFrame([(s, numbers[s]) for s in order], f"_source {dict(docs.dtypes)[source_col]}, _number2 int")
    clean = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names))
    ranked = rank_within(clean, source_col, F.struct(F.col(id_col)), [F.xxhash64(F.col(id_col)), F.col(id_col)], sum(counts.values()), "_rank")
    placed = ranked.join(keys, F.col(source_col).eqNullSafe(F.col("_source"))).withColumn("mix_block", F.floor(F.col("_rank") / p.block_docs))
    # a source has a row for each phase that it takes part in; Spark broadcasts them only while they are small
    joined = placed.join(phases, (F.col("_number2") == F.col("_number")) & (F.col("mix_block") >= F.col("_low")) & (F.col("mix_block") < F.col("_high")))
    ahead = F.col("mix_block") - F.col("_low")
    turn, within = F.floor(ahead / F.col("_q")), ahead % F.col("_q")
    base = F.col("_slot") + turn * F.col("_total")
    slotted = (
        joined.withColumn("mix_slot", (base + F.element_at("_at", (within + 1).cast("int"))).cast("long"))
        .withColumn("mix_release", (base + F.floor(within * F.col("_total") / F.col("_q"))).cast("long"))
        .withColumn("mix_deadline", (base + F.ceil((within + 1) * F.col("_total") / F.col("_q"))).cast("long"))
    )
    return slotted.withColumn("mix_position", F.col("mix_slot") * p.block_docs + F.col("_rank") % p.block_docs).select(*(F.col(f"`{c}`") for c in clean.columns), *names)
