"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

A hash is the quantised projection on a random Gaussian direction, floor((g.v + b) / width); normal
variables are 2-stable, so the chance of a collision depends only on the Euclidean distance, which for unit
vectors is a function of the cosine. A table's key joins ``k`` hashes; several tables make up for misses.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.components import components
from docquarry.llm.groups import binary_matrix, whole_groups
from docquarry.llm.shingles import mix
from docquarry.llm.tables import Scratch


@dataclass(frozen=True)
class CosineParameters:
    """The number of hashes and tables follows from the number of vectors, see ``plan``."""

    cosine: float = 0.95  # the least cosine of a link
    width: float = 2.0  # of a quantisation step
    miss: float = 1e-4  # chance that a pair at exactly ``cosine`` shares no table
    mates: float = 32.0  # unrelated vectors that share a bucket, on average
    block: int = 768  # members of a bucket that meet in one task at a time
    seed: int = 20240229


def collision(distance: float, width: float) -> float:
    """Chance that one quantised projection is equal for two points at ``distance`` (Datar et al. 2004)."""
    if distance <= 0:
        return 1.0
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(vectors: int, p: CosineParameters) -> tuple[int, int]:
    """(hashes per table, tables): buckets stay small as the input grows, the miss chance stays."""
    near, far = collision(math.sqrt(2 - 2 * p.cosine), p.width), collision(math.sqrt(2), p.width)
    k = max(4, math.ceil(math.log(max(vectors, 1) / p.mates + 1) / -math.log(far)))
    return k, math.ceil(math.log(p.miss) / math.log(1 - near**k))


def _stored(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(vec_id, vector as little-endian bytes or null if it can't link), and the number type of the bytes.

    Floats stay floats, which halves what is shuffled; norms and cosines are taken in doubles either way.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = None if not v or None in v else np.array(v, kind)
                out.append(None if x is None or not np.isfinite(x).all() or not x.any() else (x + 0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vector"])

    values = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("v")).mapInArrow(run, "vec_id long, vector binary"), kind


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1, in doubles; scaled first, else the squares of huge or tiny numbers leave the range."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(vectors: DataFrame, kind: str, k: int, tables: int, p: CosineParameters) -> DataFrame:
    """Adds ``keys``: for each table the vector's bucket, 32 bits that hash its k cells."""
    width = np.dtype(kind).itemsize

    def run(batches):
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lengths = np.array([len(v) // width for v in batch.column("vector").to_pylist()])
            for size in np.unique(lengths).tolist():  # vectors of other dimensions never link
                if size not in drawn:
                    rng = np.random.default_rng([p.seed, size])
                    drawn[size] = rng.standard_normal((size, k * tables)), rng.uniform(0, p.width, k * tables)
                g, shift = drawn[size]
                part = batch.take(pa.array(np.flatnonzero(lengths == size)))
                x = _units(binary_matrix(part.column("vector"), kind, size))
                cells = np.floor((x @ g + shift) / p.width).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
                keys = np.full((len(x), tables), 1000 * size, np.uint64)
                for j in range(k):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
                keys = (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("n_copies"), part.column("vector"), pa.array(list(keys), pa.list_(pa.int32()))], names=["vec_id", "n_copies", "vector", "keys"])

    return vectors.mapInArrow(run, "vec_id long, n_copies long, vector binary, keys array<int>")


def _met(hashed: DataFrame, kind: str, tables: int, p: CosineParameters) -> DataFrame:
    """(vec_id, links, root): per block of a bucket, the links of each vector and the smallest vector it reaches there.

    A pair counts only in the first table that it shares. Buckets above ``block`` are cut in blocks and each
    pair of blocks meets in a task of its own, so no task holds more than two blocks.
    """
    parts = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = hashed.select("vec_id", F.length("vector").alias("size"), F.posexplode("keys").alias("table", "bucket")).select("vec_id", "table", F.xxhash64("table", "bucket", "size").alias("key"))
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("key2"), F.ceil(F.col("n") / p.block).cast("int").alias("blocks"))
    dealt = (
        placed.join(sizes, F.col("key") == F.col("key2"))
        .withColumn("mine", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("vec_id", "table", "mine", (F.col("mine") != F.col("other")).alias("apart"), F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("gid"))
    )
    rows = dealt.join(hashed, "vec_id").select("gid", "table", "mine", "apart", "vec_id", "n_copies", "vector", "keys").repartition(parts, "gid").sortWithinPartitions("gid", "mine", "vec_id")

    def run(batches):
        for table, borders in whole_groups(batches, "gid"):
            ids, weights, mine, at_table, apart = (table.column(c).to_numpy() for c in ("vec_id", "n_copies", "mine", "table", "apart"))
            vectors = table.column("vector").combine_chunks()
            keys = table.column("keys").combine_chunks()
            keys = (pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys).flatten().to_numpy().reshape(len(ids), tables)
            for low, high in zip(borders[:-1], borders[1:]):
                size = len(vectors[low].as_buffer()) // np.dtype(kind).itemsize
                x = _units(binary_matrix(vectors.slice(low, high - low), kind, size))
                t = at_table[low]
                own = mine[low:high]
                if apart[low] and own[0] == own[-1]:  # the other block is empty; this one meets itself elsewhere
                    continue
                split = int(np.searchsorted(own, own[-1])) if own[0] != own[-1] else 0
                left = np.arange(split) if split else np.arange(high - low)
                right = np.arange(split, high - low)
                ok = x[left] @ x[right].T >= p.cosine
                if split == 0:
                    ok &= left[:, None] < right[None, :]
                a, b = np.nonzero(ok)
                if not len(a):
                    continue
                a, b = left[a], right[b]
                if t:
                    k = keys[low:high, :t]
                    fresh = np.ones(len(a), bool)
                    for at in range(0, len(a), 65536):
                        s = slice(at, at + 65536)
                        fresh[s] = ~(k[a[s]] == k[b[s]]).any(1)
                    a, b = a[fresh], b[fresh]
                    if not len(a):
                        continue
                w = weights[low:high]
                links = np.bincount(a, w[b], high - low) + np.bincount(b, w[a], high - low)
                root = _roots(a, b, ids[low:high])
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high][some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["vec_id", "links", "root"])

    return rows.mapInArrow(run, "vec_id long, links long, root long")


def _roots(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each row's group within a block, by pointer jumping over the block's links."""
    label = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = label
    low, x, y = rank.copy(), a, b
    while len(x):
        least = np.minimum(low[x], low[y])
        before = low.copy()
        np.minimum.at(low, x, least)
        np.minimum.at(low, y, least)
        low = np.minimum(low, low[order[low]])
        if (low == before).all():
            break
    return ids[order[low]]


def near_embeddings(vectors: DataFrame, p: CosineParameters = CosineParameters(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Links are pairs with cosine >= ``cosine`` (in doubles) that share a bucket in a table. n_links counts the other
    vectors linked directly, exact copies included; component_id is the smallest vec_id reachable.

    Vectors that are null, empty, zero or hold null or non-finite numbers have no links and are kept, as are
    vectors of another dimension than the rest. Equal vectors fall together first and weigh as many as
    they are, so a group of copies costs one vector. Repeated rows count as vectors of their own, each with the links of
    its own vector; rows of one id are in one component. A null vec_id comes back with null component and no links, kept.
    An empty table gives an empty result; labels and other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "lsh")
    stored, kind = _stored(vectors, id_col, vector_col)
    rows = scratch.save(stored, "rows")
    good = rows.where("vector is not null and vec_id is not null")
    # classes of equal vectors, by a number of their own: an id may be in several
    unique = scratch.save(good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n_copies")).withColumn("node", F.monotonically_increasing_id()), "unique")
    k, tables = plan(unique.count(), p)
    members = scratch.save(rows.join(unique.select(F.col("vector").alias("vector2"), "node"), (F.col("vector") == F.col("vector2")) & F.col("vec_id").isNotNull(), "left").select("vec_id", "node"), "members")
    hashed = scratch.save(_keys(unique.select(F.col("node").alias("vec_id"), "n_copies", "vector"), kind, k, tables, p), "hashed")
    met = scratch.save(_met(hashed, kind, tables, p), "met")
    counts = met.groupBy("vec_id").agg(F.sum("links").alias("links"))
    several = members.where("node is not null").groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    through_ids = members.where("node is not null").join(several, "vec_id").select("a", F.col("node").alias("b"))
    linked = met.where("root <> vec_id").select(F.col("root").alias("a"), F.col("vec_id").alias("b"))
    found = components(linked.unionByName(through_ids), scratch)
    classes = unique.select("node", "least", "n_copies").join(counts.withColumnRenamed("vec_id", "node"), "node", "left").join(found, "node", "left")
    classes = scratch.save(classes.select(F.col("node").alias("node2"), "least", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("group")), "classes")
    scratch.keep("members", "classes")
    named = classes.groupBy("group").agg(F.min("least").alias("component")).withColumnRenamed("group", "group2")
    classes = classes.join(named, F.col("group") == F.col("group2")).select("node2", "n_links", "component")
    out = members.join(classes, F.col("node") == F.col("node2"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
