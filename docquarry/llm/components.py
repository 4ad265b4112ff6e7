"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.tables import Scratch


def components(links: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); component is the smallest node reachable.

    Each round points a node at its smallest neighbour, follows that pointer once more, and replaces the
    ends of the links by what they point at. Links inside a group vanish, so the table shrinks by a factor a
    round; chains take logarithmically many. Only sums by key and joins are used, which Spark can split
    for a hot node: no group of neighbours is gathered. Every round's tables are written.
    """
    rest = scratch.save(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), f"{label}-0")
    steps: list[DataFrame] = []
    while not rest.isEmpty():
        k = len(steps)
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(rest.select(F.col("b").alias("node"), F.col("a").alias("other")))
        near = scratch.save(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("to")), f"{label}-near-{k}")
        onward = near.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        step = scratch.save(near.join(onward, "to", "left").select("node", F.coalesce("to2", "to").alias("to")), f"{label}-step-{k}")
        scratch.drop(f"{label}-near-{k}")
        steps.append(step)
        at_a = step.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        at_b = step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = rest.join(at_a, "a").join(at_b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        rest = scratch.save(moved, f"{label}-{k + 1}")
        scratch.drop(f"{label}-{k}")
    if not steps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[0].withColumnRenamed("to", "component")
    for k, step in enumerate(steps[1:]):
        onward = step.select(F.col("node").alias("component"), "to")
        found = scratch.save(found.join(onward, "component", "left").select("node", F.coalesce("to", "component").alias("component")), f"{label}-found-{k}")
    return found
