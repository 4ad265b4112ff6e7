"""Running sums and folds along an order, for groups that no task could hold.

``running_sums`` deals rows by ranges of (group, order), so a group of any size lies in many tasks; only sums of ranges meet.
``fold`` is for what has to be done in turn (a digest, a replay): a group's rows pass through one task, a batch at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from docquarry.sources.stage import Stage


def _changes(batch: pa.RecordBatch, before: pa.RecordBatch | None, group: list[str]) -> np.ndarray:
    """For each row whether its group differs from that of the row before it; nulls are equal to each other."""
    out = np.zeros(batch.num_rows, bool)
    if before is None:
        out[0] = True
    for name in group:
        column = batch.column(name)
        if before is None:
            ahead = column.slice(1)
            behind, at = column.slice(0, len(column) - 1), 1
        else:
            ahead, behind, at = column, pa.concat_arrays([before.column(name), column.slice(0, len(column) - 1)]), 0
        differ = pc.if_else(pc.or_(pc.is_null(ahead), pc.is_null(behind)), pc.xor(pc.is_null(ahead), pc.is_null(behind)), pc.not_equal(ahead, behind))
        out[at:] |= differ.to_numpy(zero_copy_only=False).astype(bool)
    return out


def running_sums(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column], stage: Stage, label: str = "running") -> DataFrame:
    """``df`` with a column for each of ``values`` (longs): the sum of the group's earlier rows in ``order``, 0 for the first.

    A value of 1 gives ranks from 0. ``order`` should tell rows apart, or equal rows share a task. Ranges of (group, order) are
    summed on their own and written; as ranges follow the order, only the first group of a range goes on from ranges before
    it, so what is carried over has at most one row a range. Nulls form a group and come first; null values count as 0.
    """
    names = list(values)
    marked = df.withColumns({n: F.coalesce(v.cast("long"), F.lit(0).cast("long")) for n, v in values.items()})
    schema = StructType([*marked.schema.fields, StructField("_part", IntegerType()), StructField("_head", BooleanType())])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, groups = TaskContext.get().partitionId(), None, 0
        carried = dict.fromkeys(names, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            first = _changes(batch, before, group)
            number = groups + np.cumsum(first)
            starts = np.flatnonzero(first)
            columns = dict(zip(batch.schema.names, batch.columns))
            for n in names:
                own = batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(own)
                base = np.r_[0, total][starts]  # of each group that begins here
                which = np.searchsorted(starts, np.arange(len(own)), "right") - 1
                offset = np.where(which >= 0, -base[which] if len(base) else 0, carried[n])
                columns[n] = pa.array(total - own + offset)
                carried[n] = int(total[-1] + offset[-1])
            groups = int(number[-1])
            before = batch.slice(batch.num_rows - 1).select(group) if group else batch.slice(batch.num_rows - 1)
            extra = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(number == 1)]
            yield pa.RecordBatch.from_arrays([*columns.values(), *extra], names=[*columns, "_part", "_head"])

    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    placed = marked.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
    stored = stage.save(placed, label)
    own = {n: values[n] for n in names}
    sums = stored.groupBy("_part", "_head", *group).agg(*(F.sum(F.coalesce(v.cast("long"), F.lit(0))).alias(n) for n, v in own.items()))
    earlier = Window.partitionBy(*group).orderBy("_part", F.desc("_head")).rowsBetween(Window.unboundedPreceding, -1) if group else Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col("_part").alias("_p"), F.col("_head").alias("_h"), *(F.sum(n).over(earlier).alias(f"_carry_{n}") for n in names)).where(F.col("_h") & F.col(f"_carry_{names[0]}").isNotNull())
    # at most one row a partition
    joined = stored.join(F.broadcast(carry), F.col("_head") & (F.col("_part") == F.col("_p")), "left")
    return joined.select(*df.columns, *((F.col(n) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))).alias(n) for n in names))


def running_last(df: DataFrame, group: list[str], order: list[str], column: str, into: str, stage: Stage, label: str = "last") -> DataFrame:
    """``df`` with ``into``: the last value of ``column`` that isn't null, up to and with the row, in ``order`` within its group.

    Dealt and carried over as in ``running_sums``: ranges are filled on their own and written, then the first group of a range takes
    what ranges before it ended with. A group of any size lies in many tasks.
    """
    schema = StructType([*df.schema.fields, StructField(into, df.schema[column].dataType), StructField("_part", IntegerType()), StructField("_head", BooleanType()), StructField("_row", LongType())])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, groups, rows, held = TaskContext.get().partitionId(), None, 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            first = _changes(batch, before, group)
            values = batch.column(column)
            known = values.is_valid().to_numpy(zero_copy_only=False)
            # place 0 is what the group before the batch had; a group that begins here has nothing yet
            at = np.where(known, np.arange(1, n + 1), 0)
            starts = np.flatnonzero(first)
            floor = np.zeros(n, np.int64)
            floor[starts] = starts + 1
            floor, at = np.maximum.accumulate(floor), np.maximum.accumulate(at)
            found = np.where((at >= floor) & (at > 0), at, np.where(floor == 0, 0, -1))
            held = pa.nulls(1, values.type) if held is None else held
            last = pa.concat_arrays([held, values]).take(pa.array(found, mask=found < 0))
            number = groups + np.cumsum(first)
            extra = [last, pa.array(np.full(n, part, np.int32)), pa.array(number == 1), pa.array(np.arange(rows, rows + n))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, into, "_part", "_head", "_row"])
            groups, rows, held = int(number[-1]), rows + n, last.slice(n - 1)
            before = batch.slice(n - 1).select(group)

    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    stored = stage.save(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema), label)
    ends = stored.groupBy("_part", "_head", *group).agg(F.max_by(into, "_row").alias("_end"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col("_part").alias("_p"), F.col("_head").alias("_h"), F.last("_end", ignorenulls=True).over(earlier).alias("_carry")).where(F.col("_h") & F.col("_carry").isNotNull())
    # at most one row a partition
    joined = stored.join(F.broadcast(carry.drop("_h")), F.col("_head") & (F.col("_part") == F.col("_p")), "left")
    return joined.select(*df.columns, F.coalesce(into, "_carry").alias(into))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], stage: Stage) -> DataFrame:
    """``left`` with ``columns`` of the latest row of ``right`` with equal ``by`` and a time not after its own; null if there is none.

    Both sides lie in one order of (by, time), and each row takes the last one of ``right`` before it, so neither a key's rows nor its times
    meet in one task. Of rows of ``right`` with one key and time the one with the greatest ``columns`` counts. A null key or time has no match.
    """
    kept, value = F.struct(*(F.col(f"`{c}`") for c in left.columns)), F.struct(*(F.col(f"`{c}`") for c in columns))
    known = lambda time: functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, time)])
    lefts = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_value"), kept.alias("_left"), F.monotonically_increasing_id().alias("_id"))
    rights = right.where(known(right_time)).select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), value.alias("_value"), F.lit(None).cast(lefts.schema["_left"].dataType).alias("_left"), F.lit(0).cast("long").alias("_id"))
    found = running_last(rights.unionByName(lefts), by, ["_t", "_side", "_value", "_id"], "_value", "_last", stage)
    return found.where("_side = 1").select("_left.*", *(F.when(known("_t"), F.col(f"_last.{c}")).alias(c) for c in columns))


def fold(df: DataFrame, group: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, pa.RecordBatch], list[dict]], finish: Callable[[Any], list[dict]], schema: StructType) -> DataFrame:
    """Rows that ``step`` and ``finish`` return while a group's rows pass by in ``order``; ``schema`` is without ``group``.

    ``start()`` makes a group's state, ``step(state, rows)`` takes the next rows of the group, ``finish(state)`` ends it. Returned
    rows are dicts, to which the group's columns are added. A task holds a batch of rows and one state, however long the
    group. Groups are dealt by hash; a group is one task's, as its rows have to be taken in turn.
    """
    types = {f.name: f for f in df.schema.fields}
    full = StructType([*(types[c] for c in group), *schema.fields])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(full)
        state, key, before = None, None, None

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**key, **row} for row in rows], schema=target)

        for batch in batches:
            if not batch.num_rows:
                continue
            borders = [0, *np.flatnonzero(_changes(batch, before, group)).tolist(), batch.num_rows]
            for low, high in zip(borders[:-1], borders[1:]):
                if low == high:
                    continue
                rows = batch.slice(low, high - low)
                if low or before is None or borders[1] == 0:  # a new group begins
                    if key is not None and (rest := finish(state)):
                        yield out(rest)
                    state, key = start(), rows.slice(0, 1).select(group).to_pylist()[0]
                if found := step(state, rows):
                    yield out(found)
            before = batch.slice(batch.num_rows - 1).select(group)
        if key is not None and (rest := finish(state)):
            yield out(rest)

    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    return df.repartition(parts, *group).sortWithinPartitions(*keys).mapInArrow(run, full)
