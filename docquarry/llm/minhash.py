"""Near-duplicate groups by HyperMinHash signatures, banding and exact checks.

HyperMinHash keeps, for each of m buckets of the hash space, the smallest hash of a document as a leading-zero
count and a few mantissa bits. Equal registers of two documents estimate their Jaccard similarity, less
the share of registers that meet by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.components import components
from docquarry.llm.groups import binary_matrix, whole_groups
from docquarry.llm.shingles import mix, shingle_sets
from docquarry.llm.tables import Scratch, short_batches, sifted


@dataclass(frozen=True)
class MinHashParameters:
    """``bands`` x ``rows`` registers. 32 bands of 5: a pair of similarity 0.8 shares no band once in 300,000."""

    shingle_words: int = 5
    percent: int = 80  # the least similarity of a link
    bands: int = 32
    rows: int = 5
    mantissa_bits: int = 10
    errors: float = 6.5  # estimates this many standard errors below the threshold are not checked
    partners: int = 256  # of a document that meet it in one task
    block: int = 256  # members of a bucket that meet as many others in one task; twice the root of a bucket's size, if that is more
    most: int = 768  # but never more than so many

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _edges(m: int) -> np.ndarray:
    """The first hash of each bucket."""
    return np.array([-(-(k << 64) // m) for k in range(m)], dtype=np.uint64)


def _detours(m: int, tries: int = 48) -> np.ndarray:
    """For each bucket, in order, the buckets that an empty one borrows from."""
    cells = np.arange(m * tries, dtype=np.uint64).reshape(m, tries)
    return (mix(cells + np.uint64(77)) % np.uint64(m)).astype(np.int64)


def compress(minimum: np.ndarray, bits: int) -> np.ndarray:
    """A 64-bit minimum as leading-zero count and the ``bits`` after the leading one; the smaller, the more zeros."""
    zeros = np.full(minimum.shape, 63, np.uint64)
    shifted = minimum.copy()
    zeros[:] = 0
    for step in (32, 16, 8, 4, 2, 1):
        small = shifted < (np.uint64(1) << np.uint64(64 - step))
        zeros[small] += np.uint64(step)
        shifted[small] <<= np.uint64(step)
    mantissa = (shifted << np.uint64(1)) >> np.uint64(64 - bits)
    return ((np.minimum(zeros, np.uint64(63)) << np.uint64(bits)) | mantissa).astype(np.uint16)


def signature(hashes: np.ndarray, edges: np.ndarray, detours: np.ndarray, bits: int) -> np.ndarray:
    """Registers of one document from its sorted distinct hashes (at least one)."""
    m = len(edges)
    first = np.searchsorted(hashes, edges)
    filled = np.empty(m, bool)
    filled[:-1] = first[:-1] < first[1:]
    filled[-1] = first[-1] < len(hashes)
    out = np.zeros(m, np.uint16)
    out[filled] = compress(hashes[first[filled]] * np.uint64(m), bits)  # modulo 2**64: the place within the bucket
    if not filled.all():
        empty = np.flatnonzero(~filled)
        good = filled[detours[empty]]
        found = good.argmax(1)
        source = detours[empty, found]
        none = ~good.any(1)
        if none.any():  # hardly any bucket is filled: the next one on the circle
            full = np.flatnonzero(filled)
            source[none] = full[np.searchsorted(full, empty[none]) % len(full)]
        out[empty] = out[source]
    return out


def chance(n1: np.ndarray, n2: np.ndarray, m: int, bits: int) -> np.ndarray:
    """The share of registers that two unrelated documents of n1 and n2 shingles have in common."""
    powers = 2.0 ** -np.arange(0, 54)
    def exponents(n):
        k = np.maximum(np.asarray(n, float) / m, 1.0)[..., None]
        below = (1 - powers) ** k  # chance that the minimum exceeds 2**-e
        return below[..., 1:] - below[..., :-1]
    return (exponents(n1) * exponents(n2)).sum(-1) * 2.0**-bits


def estimate(equal: np.ndarray, n1: np.ndarray, n2: np.ndarray, m: int, bits: int) -> np.ndarray:
    """Collision-corrected Jaccard similarity from the share of equal registers."""
    c = chance(n1, n2, m, bits)
    return (equal - c) / (1 - c)


def hopeless(equal: np.ndarray, n1: np.ndarray, n2: np.ndarray, p: MinHashParameters) -> np.ndarray:
    """Pairs that are no links, by their sizes or their share of equal registers.

    Small sets fill few registers of their own, so their estimates err more.
    """
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    error = np.sqrt(0.16 / (0.75 * np.minimum(small, p.registers)))
    estimated = estimate(equal, n1, n2, p.registers, p.mantissa_bits)
    return (100 * small < p.percent * large) | (estimated < p.percent / 100 - p.errors * error)


def _digest(hashes: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([hashes.sum(dtype=np.uint64), mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64).tobytes()


def _registers(sets: list[np.ndarray], p: MinHashParameters) -> list[np.ndarray | None]:
    edges, detours = _edges(p.registers), _detours(p.registers)
    return [signature(s, edges, detours, p.mantissa_bits) if len(s) else None for s in sets]


def _band_keys(registers: list[np.ndarray | None], p: MinHashParameters) -> list[list[int] | None]:
    """A key for each band of registers; null for none."""
    full = [r for r in registers if r is not None]
    if not full:
        return [None] * len(registers)
    matrix = np.stack(full).astype(np.uint64).reshape(len(full), p.bands, p.rows)
    hashed = np.zeros(matrix.shape[:2], np.uint64) + mix(np.arange(p.bands, dtype=np.uint64) + np.uint64(991))
    for r in range(p.rows):
        hashed = mix(hashed * np.uint64(0x9E3779B97F4A7C15) + matrix[:, :, r])
    keys = iter(hashed.view(np.int64).tolist())
    return [None if r is None else next(keys) for r in registers]


def signatures(docs: DataFrame, p: MinHashParameters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys of its registers); the last two null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(1), p.shingle_words)
                columns = [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(_band_keys(_registers(sets, p), p), pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _estimated(pairs: DataFrame, sets: DataFrame, p: MinHashParameters) -> DataFrame:
    """Pairs (a, b) whose registers do not rule out a link."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (binary_matrix(batch.column(k), "<u2", p.registers) for k in ("ra", "rb"))
            n1, n2 = (batch.column(k).to_numpy() for k in ("na", "nb"))
            keep = pa.array(~hopeless((x == y).mean(1), n1, n2, p))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    at_a = sets.select(F.col("doc_id").alias("a"), F.col("registers").alias("ra"), F.col("n_shingles").alias("na"))
    at_b = sets.select(F.col("doc_id").alias("b"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"))
    return pairs.join(at_a, "a").join(at_b, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, asked: DataFrame, p: MinHashParameters, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, registers, sorted distinct shingle hashes) of the documents in ``asked`` (_id).

    Texts that may be asked for meet ``asked`` in a shuffle, at every size; a table of bits sifts out most of the others
    before. An id with several texts has a row for each.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(1), p.shingle_words)
                full = pa.array([bool(len(s)) for s in sets])
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([r if r is None else r.tobytes() for r in _registers(sets, p)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "registers", "hashes"]).filter(full)

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    own = sifted(texts, "_id", asked, "_maybe").where("_maybe").drop("_maybe").join(asked.hint("merge"), "_id", "left_semi").withColumn("_hash", F.xxhash64("text")).dropDuplicates(["_id", "_hash"]).drop("_hash")
    return own.mapInArrow(run, "doc_id long, n_shingles long, registers binary, hashes binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, p: MinHashParameters, scratch: Scratch) -> DataFrame:
    """The pairs that are links by their full sets.

    The partners of a document are dealt in blocks, so that each task gets the document once and at
    most ``partners`` with it, however many there are.
    """
    pairs = scratch.save(pairs, "pairs")
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("a", "a2")
    dealt = pairs.join(counts, F.col("a") == F.col("a2")).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / p.partners)).alias("part")).select("a", "b", F.xxhash64("a", "part").alias("gid"))
    dealt = scratch.save(dealt, "dealt")
    centres = dealt.select("gid", F.col("a").alias("doc_id")).distinct().join(sets, "doc_id").select("gid", F.lit(0).alias("role"), "doc_id", "hashes")
    partners = dealt.select("gid", F.col("b").alias("doc_id")).join(sets, "doc_id").select("gid", F.lit(1).alias("role"), "doc_id", "hashes")
    parts = pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def run(batches):
        for table, borders in whole_groups(batches, "gid"):
            ids, roles = table.column("doc_id").to_numpy(), table.column("role").to_numpy()
            hashes = table.column("hashes").combine_chunks()
            found_a, found_b = [], []
            for low, high in zip(borders[:-1], borders[1:]):
                centres, name = [], ids[low]  # more than one set only if the id has several texts
                for k in range(low, high):
                    own = np.frombuffer(hashes[k].as_buffer(), np.uint64)
                    if roles[k] == 0:
                        centres.append(own)
                        continue
                    for centre in centres:
                        both = np.intersect1d(centre, own, assume_unique=True).size
                        if 100 * both >= p.percent * (len(centre) + len(own) - both):
                            found_a.append(name)
                            found_b.append(ids[k])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    rows = centres.unionByName(partners).repartition(int(parts), "gid").sortWithinPartitions("gid", "role", "doc_id")
    links = scratch.save(rows.mapInArrow(run, "a long, b long"), "star-links")
    scratch.drop("pairs")
    scratch.drop("dealt")
    return links


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set, by matrix products."""
    sizes = np.array([len(s) for s in left + right])
    _, code = np.unique(np.concatenate(left + right), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    seen = np.bincount(code)
    shared = seen[code] > 1  # a hash of one set only is in no intersection
    renumber = np.cumsum(seen > 1) - 1
    code, owner = renumber[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        s = slice(*np.searchsorted(code, [low, low + columns]))
        part = np.zeros((len(sizes), columns), np.float32)
        part[owner[s], code[s] - low] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out.astype(np.int64)


def _candidates(registers, n, comps, band, split, p):
    """Pairs (x, y) of a group that are worth a check; y from the second block, or after x in the only one."""
    xs, ys = [], []
    for x in range(split):
        y = np.arange(split if split < len(n) else x + 1, len(n))
        y = y[comps[y] != comps[x]]
        if not len(y):
            continue
        same = registers[y] == registers[x]
        first = same.reshape(len(y), p.bands, p.rows).all(2).argmax(1)
        ok = (first == band) & ~hopeless(same.mean(1), n[y], np.full(len(y), n[x]), p)
        xs.append(np.full(int(ok.sum()), x))
        ys.append(y[ok])
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, int), np.zeros(0, int))


def _groups(batches, p: MinHashParameters):
    """(rows, first row, x, y) of each group: ``_candidates`` x and y count from its first row."""
    for table, borders in whole_groups(batches, "gid"):
        comps, mine, n, bands = (table.column(k).to_numpy() for k in ("comp", "mine", "n_shingles", "band"))
        registers = binary_matrix(table.column("registers"), "<u2", p.registers)
        for low, high in zip(borders[:-1].tolist(), borders[1:].tolist()):
            own, m = slice(low, high), mine[low:high]
            split = int(np.searchsorted(m, m[-1])) if m[0] != m[-1] else high - low
            x, y = _candidates(registers[own], n[own], comps[own], bands[low], split, p)
            if len(x):
                yield table, low, x, y


def _dealt(named: DataFrame, p: MinHashParameters) -> DataFrame:
    """(gid, band, doc_id, comp, mine): groups in which the members of one bucket (band, key, ``n`` members) but different components meet.

    Most members of a large bucket are in one component by now and need not meet each other. So the largest component of a
    bucket stands apart: its blocks meet the blocks of the rest, and those meet one another. A bucket of n members with r in
    the rest makes about n * r / block rows, not n * n / block. Joins by key are salted by the size of a bucket.
    """
    salts = F.ceil(F.col("n") / 256)
    dealt = named.where("n > 2").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(5)), salts))
    sizes = dealt.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    mains = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"), F.max("c").alias("n_main"), F.sum("c").alias("n_all"), F.max("n").alias("n")).where("n_main < n_all")
    size = F.greatest(F.lit(p.block), F.least(F.lit(p.most), F.ceil(2 * F.sqrt("n_all"))))
    blocks = mains.select(F.col("key").alias("key2"), "main", F.ceil(F.col("n_main") / size).cast("int").alias("main_blocks"), F.ceil((F.col("n_all") - F.col("n_main")) / size).cast("int").alias("rest_blocks"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt2"))
    placed = dealt.join(blocks, (F.col("key") == F.col("key2")) & (F.col("salt") == F.col("salt2")))
    in_main = F.col("comp") == F.col("main")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.when(in_main, F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    group = lambda mine, *parts: F.struct(mine.alias("mine"), F.xxhash64("key", *parts).alias("gid"))
    main_side = F.transform(upto("rest_blocks"), lambda j: group(F.lit(1), F.lit(1), F.col("own"), j))
    rest_side = F.concat(F.transform(upto("main_blocks"), lambda j: group(F.lit(0), F.lit(1), j, F.col("own"))), F.transform(upto("rest_blocks"), lambda j: group(F.col("own"), F.lit(0), F.least("own", j), F.greatest("own", j))))
    return placed.select("band", "doc_id", "comp", F.explode(F.when(in_main, main_side).otherwise(rest_side)).alias("_g")).select("_g.gid", "band", "doc_id", "comp", "_g.mine")


def _crossing(placed: DataFrame, sets: DataFrame, p: MinHashParameters, scratch: Scratch) -> DataFrame:
    """Links between members that meet in a group of ``placed`` (gid, band, doc_id, comp, mine) and are of different components.

    Members meet block by block, with their registers first: a pair counts only in its first common band. Those with
    a candidate meet once more with their full sets, and only links leave that task.
    """
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["gid", "mine", "doc_id"]
    signed = placed.join(sets.select("doc_id", "n_shingles", "registers"), "doc_id").repartition(parts, "gid").sortWithinPartitions(*order)

    def screen(batches):
        for table, low, x, y in _groups(batches, p):
            rows = np.unique(np.concatenate([x, y])) + low
            yield from table.select(["gid", "band", "mine", "comp", "doc_id"]).take(pa.array(rows)).to_batches()

    def check(batches):
        for table, low, x, y in _groups(batches, p):
            ids, hashes = table.column("doc_id").to_numpy(), table.column("hashes").combine_chunks()
            (ux, ix), (uy, iy) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
            left, right = ([np.frombuffer(hashes[low + k].as_buffer(), np.uint64) for k in u.tolist()] for u in (ux, uy))
            both = intersections(left, right)[ix, iy]
            sizes = np.array([len(s) for s in left])[ix] + np.array([len(s) for s in right])[iy]
            link = 100 * both >= p.percent * (sizes - both)
            a, b = ids[low + x[link]], ids[low + y[link]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    worth = scratch.save(signed.mapInArrow(screen, "gid long, band int, mine int, comp long, doc_id long").distinct(), "worth")
    full = worth.join(sets, "doc_id").repartition(parts, "gid").sortWithinPartitions(*order)
    return full.mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, p: MinHashParameters = MinHashParameters(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked if their shingle sets have a Jaccard similarity of at least ``percent`` / 100, checked on
    full sets; component_id is the smallest doc_id reachable, kept marks the row with that id.

    1. Equal sets fall together by digest; one document stands for them.
    2. In each band's bucket every member meets the smallest one: candidates grow with the members, not with
       their pairs. Estimates drop hopeless ones, full sets confirm the rest, and components follow.
    3. A bucket that still holds several components may hide links, so its members of different components
       meet, block by block, on full sets. Found links join the others and components are taken once more.

    Null or blank texts have an empty set: n_shingles 0, linked with nothing, kept. Repeated rows of one doc_id
    come back as often, in one component: where their texts differ, each text's links count for the id. A null
    doc_id comes back with a null component and kept true. An empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "minhash")
    signed = scratch.save(signatures(docs, p, id_col, text_col), "signed")
    filled = signed.where("doc_id is not null and n_shingles > 0")
    members = scratch.save(filled.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "members")
    banded = members.select(F.col("rep").alias("doc_id"), F.posexplode("bands").alias("band", "key"))
    centres = banded.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("n")).where("a <> z").select(F.col("key").alias("key2"), "a", "n")
    shared = scratch.save(banded.join(centres, F.col("key") == F.col("key2")).select("key", "band", "doc_id", "a", "n"), "shared")
    stars = scratch.save(shared.where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct(), "stars")
    asked = stars.select(F.col("a").alias("_id")).union(stars.select("b")).distinct()
    sets = scratch.save(_sets(docs, asked, p, id_col, text_col), "sets")
    links = _confirmed(_estimated(stars, sets, p), sets, p, scratch)
    first = scratch.save(components(links, scratch, "first"), "first-components")

    named = shared.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp"), "band", "key", "n")
    more = scratch.save(_crossing(_dealt(named, p), sets, p, scratch), "cross-links")
    scratch.drop("sets")
    classes = members.select(F.col("digest").alias("d2"), F.col("n_shingles").alias("n2"), "rep")
    same = (F.col("digest") == F.col("d2")) & (F.col("n_shingles") == F.col("n2"))
    chains = filled.select("doc_id", "digest", "n_shingles").join(classes, same).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    final = components(links.unionByName(more).unionByName(chains), scratch, "last")
    final = scratch.save(final, "final").select(F.col("node").alias("node"), "component")
    scratch.keep("signed", "final")
    out = signed.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
