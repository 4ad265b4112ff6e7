"""Merkle manifest of a dataset: a digest for all rows, and for each row a proof of its place.

Leaves are numbered within their source by distributed running sums and cut into aligned blocks of ``run ** levels``. A task walks a block
in postorder: a call returns its subtree's digest and, as it unwinds, appends the siblings at its level to the proofs of the leaves
below it. Block digests are the leaves of the next traversal, until a source has one; the sources' digests are a last tree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.tables import Scratch
from docquarry.operators.ordered import running_sums


@dataclass(frozen=True)
class MerkleParameters:
    run: int = 3  # nodes that one node stands for
    levels: int = 7  # of a block, so a task holds run ** levels nodes of a block


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(name: str) -> Column:
    value = F.col(name).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, changed) of each row: ``changed`` is the leaf after tampering, where that applies.

    A field is "-" if null, else the octets of its text in UTF-8, ":" and the text. Tampering deletes the text's line feeds, in rows
    whose doc_id as decimal text has an even CRC-32; a null doc_id isn't tampered with.
    """
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("long" if c == "n_chars" else "string").alias(c) for c in _FIELDS[1:]))
    cut = typed.withColumn("_cut", F.translate("text", "\n", ""))
    own = [_field(c) for c in _FIELDS]
    tampered = F.when(chosen & (F.col("_cut") != F.col("text")), _digest(*own[:-1], _field("_cut")))
    with_leaf = cut.select("doc_id", "source", _digest(*own).alias("leaf"), tampered.alias("changed"))
    return with_leaf.withColumn("changed", F.coalesce("changed", "leaf")).withColumn("_row", F.monotonically_increasing_id())


def walk(nodes: list[str], folds: list[str], height: int, run: int, left: list[list[str]], right: list[list[str]], at: int = 0) -> str:
    """The digest of the subtree of ``height`` levels over ``nodes`` (from ``at`` on in the lists that are written to).

    Postorder: once the runs below have returned, their siblings are appended to the proofs ``left`` and ``right`` of the leaves
    they contain, and ``folds`` (what each leaf's own digest has become so far) goes up a level.
    """
    if height == 0:
        return nodes[0]
    size = run ** (height - 1)
    digests = [walk(nodes[k : k + size], folds, height - 1, run, left, right, at + k) for k in range(0, len(nodes), size)]
    for j, _ in enumerate(digests):
        before, after = "".join(digests[:j]), "".join(digests[j + 1 :])
        for leaf in range(at + j * size, min(at + (j + 1) * size, at + len(nodes))):
            left[leaf].append(before)
            right[leaf].append(after)
            folds[leaf] = hashlib.sha256((before + folds[leaf] + after).encode()).hexdigest()
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _traversed(nodes: DataFrame, p: MerkleParameters) -> DataFrame:
    """Nodes (tree, rank, digest, fold, name) with ``left`` and ``right`` siblings by level, and a row per block (rank null).

    A block's digest and its number within the tree come in the block's row. A block that isn't full is the last of
    its tree; if it is the first as well, the tree ends with it, lower than ``levels``.
    """
    size = p.run**p.levels

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", kind="stable")
        digests, folds = group["digest"].tolist(), group["fold"].tolist()
        block = int(group["rank"].iloc[0]) // size
        height = p.levels
        if block == 0 and len(group) < size:
            height = next(k for k in range(p.levels + 1) if p.run**k >= len(group))
        left, right = [[] for _ in digests], [[] for _ in digests]
        root = walk(digests, folds, height, p.run, left, right)
        rows = pd.DataFrame({"tree": group["tree"], "rank": group["rank"], "block": block, "digest": digests, "fold": folds, "name": group["name"], "left": left, "right": right})
        top = pd.DataFrame({"tree": [group["tree"].iloc[0]], "rank": [None], "block": [block], "digest": [root], "fold": [None], "name": [None], "left": [None], "right": [None]})
        return pd.concat([rows.astype(object), top.astype(object)], ignore_index=True)

    dealt = nodes.select("tree", "rank", "digest", "fold", "name", F.floor(F.col("rank") / size).alias("_block"))
    schema = "tree string, rank long, block long, digest string, fold string, name string, left array<string>, right array<string>"
    return dealt.groupBy("tree", "_block").applyInPandas(run, schema)


def _climb(nodes: DataFrame, p: MerkleParameters, scratch: Scratch, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each traversal, leaves first, and (tree, root) for each tree."""
    rounds = []
    while True:
        done = scratch.save(_traversed(nodes, p), f"{label}-{len(rounds)}")
        rounds.append(done.where("rank is not null"))
        tops = done.where("rank is null")
        if tops.where("block > 0").isEmpty():
            return rounds, tops.select("tree", F.col("digest").alias("root"))
        nodes = tops.select("tree", F.col("block").alias("rank"), "digest", F.col("digest").alias("fold"), F.lit(None).cast("string").alias("name"))


def _descend(rounds: list[DataFrame], ends: DataFrame, carried: list[str]) -> DataFrame:
    """Leaves with ``left`` and ``right`` up to the root and their ``fold`` there.

    ``ends`` (tree, left, right and the columns ``carried``) says how a tree's root goes on. Paths pass down from traversal to traversal; every
    join gives a path to the nodes of one block, so that no key has more than a block's nodes.
    """
    above = ends.withColumn("rank", F.lit(0).cast("long"))
    for nodes in reversed(rounds):
        upper = above.select(F.col("tree").alias("_tree"), F.col("rank").alias("_block"), F.col("left").alias("_left"), F.col("right").alias("_right"), *carried)
        joined = nodes.join(upper, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
        above = joined.select("tree", "rank", "name", "digest", F.concat("left", "_left").alias("left"), F.concat("right", "_right").alias("right"), _folded("fold", "_left", "_right").alias("fold"), *carried)
    return above


def _folded(fold: str, left: str, right: str) -> Column:
    """``fold`` with its siblings, level by level."""
    return F.aggregate(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r")), F.col(fold), lambda digest, level: _digest(level["l"], digest, level["r"]))


def manifest(docs: DataFrame, p: MerkleParameters = MerkleParameters()) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs`` (doc_id, source, lang, n_chars, text).

    Per source, leaves ascend by doc_id; while there are several nodes, each ``run`` of them (the last may be shorter) becomes the digest
    of their digests. ``subroot`` remains; subroots ordered by source, null first, become ``root`` likewise. ``proof_sha256`` is the digest
    of all siblings on the way up. ``folded_root`` is the root found from the row's leaf, tampered with where ``leaves`` says so, and
    those siblings; ``verified`` tells whether it is the root.

    Nulls are values of their own in a leaf and a null source is a source. A null doc_id comes first in its source; rows of one doc_id
    follow by leaf, and equal rows have equal leaves, each with a place. A lone leaf is its subroot, a lone subroot the root; a proof
    without siblings is the digest of nothing. Texts of any length, an empty table and extra columns are fine.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    rows = scratch.save(leaves(docs), "leaves")
    ranked = running_sums(rows, ["source"], ["doc_id", "leaf", "_row"], {"rank": F.lit(1)}, scratch, "ranked")
    nodes = ranked.select(F.col("source").alias("tree"), "rank", F.col("leaf").alias("digest"), F.col("changed").alias("fold"), F.col("doc_id").cast("string").alias("name"))
    by_source, roots = _climb(nodes, p, scratch, "source")
    ordered = running_sums(roots, [], ["tree"], {"rank": F.lit(1)}, scratch, "sources")
    nothing = F.lit(None).cast("string")
    sources = ordered.select(nothing.alias("tree"), "rank", F.col("root").alias("digest"), F.col("root").alias("fold"), F.col("tree").alias("name"))
    rounds, top = _climb(sources, p, scratch, "root")
    empty = F.array().cast("array<string>")
    paths = _descend(rounds, top.select("tree", empty.alias("left"), empty.alias("right"), "root"), ["root"])
    ends = scratch.save(paths.select(F.col("name").alias("tree"), "left", "right", F.col("digest").alias("subroot"), "root"), "ends")
    found = _descend(by_source, ends, ["subroot", "root"])
    proof = F.array_join(F.flatten(F.zip_with("left", "right", lambda a, b: F.array(a, b))), "")
    return found.select(F.col("name").cast("long").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", _digest(proof).alias("proof_sha256"), F.col("fold").alias("folded_root"), (F.col("fold") == F.col("root")).alias("verified"))
