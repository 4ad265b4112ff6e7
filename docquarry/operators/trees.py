"""Files of repositories from stored tree listings."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.ordered import running_sums
from docquarry.sources.stage import Stage


def repository_files(listings: DataFrame, entries: DataFrame, max_requests: int = 400, max_files: int = 5000, max_depth: int = 24) -> tuple[DataFrame, DataFrame]:
    """(repo, position, path, sha, size) of the files of each repository, and (repo, requests, files, submodules, symlinks, truncated, recovered).

    ``listings`` (repo, sha, recursive, truncated) are stored answers, ``entries`` (repo, sha, recursive, ordinal, path, kind, child, size) their rows; kind
    is blob, tree, symlink or submodule. A repository's recursive answer counts if it is whole. One that was cut short is replaced by a
    walk, a folder a request, level by level in the order of listings, until ``max_requests`` are spent (the recursive one is the first);
    folders below ``max_depth`` are left out. Files beyond ``max_files`` are dropped. ``truncated`` tells that anything is missing,
    ``recovered`` that a walk has found everything. Folders without a stored listing are empty. Each level is a join by folder
    and running sums, so a repository's folders lie in many tasks.
    """
    stage = Stage(listings.sparkSession, "trees")
    asked = listings.where("recursive").select("repo", "sha", F.coalesce("truncated", F.lit(False)).alias("_cut"))
    own = entries.where("not recursive").select(F.col("repo").alias("_repo"), F.col("sha").alias("_sha"), "ordinal", "path", "kind", "child", "size")
    level = asked.where("_cut").select("repo", "sha", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("place"))
    walked: list[DataFrame] = []
    faults: list[DataFrame] = []
    for depth in range(max_depth + 1):
        ranked = running_sums(stage.save(level, f"level{depth}"), ["repo"], ["parent", "place"], {"_n": F.lit(1)}, stage, f"ranked{depth}")
        if walked:
            before = functools.reduce(DataFrame.unionByName, walked).groupBy(F.col("repo").alias("_r")).agg(F.count(F.lit(1)).alias("_before"))
            ranked = ranked.join(before, F.col("repo") == F.col("_r"), "left").fillna(0, ["_before"])
        else:
            ranked = ranked.withColumn("_before", F.lit(0).cast("long"))
        placed = stage.save(ranked.select("repo", "sha", "prefix", (F.col("_n") + F.col("_before") + 1).alias("folder")), f"placed{depth}")
        taken = placed.where(F.col("folder") <= max_requests - 1)
        faults.append(placed.where(F.col("folder") > max_requests - 1).select("repo").distinct())
        if taken.isEmpty():
            break
        walked.append(taken)
        below = taken.join(own.where("kind = 'tree'"), (F.col("repo") == F.col("_repo")) & (F.col("sha") == F.col("_sha")))
        level = below.select("repo", F.col("child").alias("sha"), F.concat("prefix", "path", F.lit("/")).alias("prefix"), F.col("folder").alias("parent"), F.col("ordinal").cast("long").alias("place"))
    else:
        faults.append(level.select("repo").distinct())
    empty = level.select("repo", "sha", "prefix", F.col("parent").alias("folder")).limit(0)
    folders = functools.reduce(DataFrame.unionByName, walked, empty)
    found = folders.join(own, (F.col("repo") == F.col("_repo")) & (F.col("sha") == F.col("_sha"))).select("repo", "folder", F.col("ordinal").cast("long").alias("place"), F.concat("prefix", "path").alias("path"), "kind", F.col("child").alias("sha"), "size")
    whole = entries.where("recursive").join(asked.where("not _cut").select("repo", "sha"), ["repo", "sha"], "left_semi")
    everything = stage.save(found.unionByName(whole.select("repo", F.lit(0).cast("long").alias("folder"), F.col("ordinal").cast("long").alias("place"), "path", "kind", F.col("child").alias("sha"), "size")), "entries")
    ranked = running_sums(everything.where("kind = 'blob'"), ["repo"], ["folder", "place", "path"], {"position": F.lit(1)}, stage, "files")
    faults.append(ranked.where(F.col("position") >= max_files).select("repo").distinct())
    short = listings.where("not recursive and truncated").select("repo", "sha").join(folders.select("repo", "sha"), ["repo", "sha"], "left_semi")
    missing = functools.reduce(DataFrame.unionByName, [*faults, short.select("repo")]).distinct().withColumn("_missing", F.lit(True))
    files = ranked.where(F.col("position") < max_files).select("repo", "position", "path", "sha", "size")
    kinds = everything.groupBy("repo").agg(F.least(F.count_if(F.col("kind") == "blob"), F.lit(max_files)).alias("files"), F.count_if(F.col("kind") == "submodule").alias("submodules"), F.count_if(F.col("kind") == "symlink").alias("symlinks"))
    spent = folders.groupBy("repo").agg(F.count(F.lit(1)).alias("_spent"))
    report = asked.join(spent, "repo", "left").join(kinds, "repo", "left").join(missing, "repo", "left")
    truncated, count = F.coalesce("_missing", F.lit(False)), lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return files, report.select("repo", (F.coalesce("_spent", F.lit(0)) + 1).cast("long").alias("requests"), count("files"), count("submodules"), count("symlinks"), truncated.alias("truncated"), (F.col("_cut") & ~truncated).alias("recovered"))
