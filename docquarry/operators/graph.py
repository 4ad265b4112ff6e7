"""Modules, dependencies, budgets, robots rules and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.ordered import running_sums
from docquarry.sources.stage import Stage


def budgeted_select(files: DataFrame, by: str, max_files: int = 2000, max_bytes: int = 512 * 1024, total: int = 48 * 1024 * 1024) -> DataFrame:
    """(by, path, size) in path order: larger files are skipped, the file count and the running total stop. No task sees a whole tree."""
    small = files.where(F.col("size") <= max_bytes)
    counted = running_sums(small, [by], ["path", "size"], {"_n": F.lit(1), "_sum": F.col("size")}, Stage(files.sparkSession, "selection"))
    return counted.where((F.col("_n") < max_files) & (F.col("_sum") + F.col("size") <= total)).drop("_n", "_sum")


def unique_suffixes(modules: DataFrame) -> DataFrame:
    """(suffix, resolved): the dotted suffixes that only one module has, with its path."""
    parts = F.split("module", r"\.")
    suffixes = modules.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"))
    return suffixes.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("resolved")).where("n = 1").drop("n")


def resolve_modules(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, module, resolved): a dotted name resolves to the only module that has it as a dotted suffix."""
    return imports.join(unique_suffixes(modules), F.col("module") == F.col("suffix"), "left").select("file", "module", "resolved")


def dependencies(resolved: DataFrame) -> DataFrame:
    """(source, target, scope, count): imports by file; unresolved ones count for the first part of their name."""
    target = F.coalesce(F.col("resolved").cast("string"), F.substring_index("module", ".", 1))
    return resolved.groupBy(F.col("file").alias("source"), target.alias("target"), F.when(F.col("resolved").isNull(), "external").otherwise("internal").alias("scope")).agg(F.count(F.lit(1)).alias("count"))


def robots_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url_id, allowed): of the rules of a host that match a target the longest pattern wins, allow on a tie; default allow.

    ``urls`` (url_id, host, target), ``rules`` (host, pattern, allow): ``*`` is any run, a final ``$`` anchors.
    """
    literal = F.regexp_replace(F.regexp_replace("pattern", r"([.+?^(){}\[\]|\\])", r"\\$1"), r"\*", ".*")
    regex = F.concat(F.lit("^"), F.regexp_replace(literal, r"\$(?!$)", r"\\\$"))
    patterns = rules.where("pattern <> ''").select(F.col("host").alias("_h"), F.length("pattern").alias("_n"), "allow", regex.alias("_re"))
    hits = urls.join(patterns, (F.col("host") == F.col("_h")) & F.expr("target rlike _re"), "left")
    best = hits.groupBy("url_id").agg(F.max_by("allow", F.struct("_n", "allow")).alias("allow"))
    return best.select("url_id", F.coalesce("allow", F.lit(True)).alias("allowed"))


def reachable(spark, edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within ``depth`` links of a seed at their least depth, each level one join against the unseen."""
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        front = seen.where(F.col("depth") == level - 1).select(F.col("node").alias("a"))
        fresh = edges.join(front, "a", "left_semi").select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(fresh.withColumn("depth", F.lit(level)))
    return seen
