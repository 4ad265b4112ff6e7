"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum over pairs <v_i, v_j>), over the distinct terms of a text. The factors learn what two
terms mean together, such as an insult and the mention of a group, which additive weights can't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shingles import mix, word_hashes
from docquarry.llm.tables import short_batches

_NOT_WORD = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_NOT_WORD, b" " * len(_NOT_WORD))


@dataclass(frozen=True)
class FactorizationParameters:
    bits: int = 18  # 2 ** bits terms
    factors: int = 4
    stems: tuple[int, ...] = (4, 5, 6)  # so many first octets of a word are terms, too: for words that training never saw
    sample_rows: int = 12_000  # labelled rows that training reads at most, about; all other steps use all rows
    least_rows: int = 4  # of the sample that hold a term, else it has no weight
    linear_z: float = 4.2  # least association with the label, as a signed root of the likelihood ratio
    factor_z: float = 2.5  # the same for a term that may matter together with another
    pair_terms: int = 1536  # the most frequent terms of labelled texts whose pairs are tested, whatever they tell alone
    pair_z: float = 6.5  # least association of a pair with the label; there are a million pairs
    pair_lead: float = 1.5  # by so much a pair must tell more than either of its terms
    epochs: int = 25
    batch: int = 256
    rate: float = 0.15
    l1: float = 1e-5
    l2: float = 1e-4
    seed: int = 7
    folds: int = 5
    held_out: int = 0


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray  # (terms,)
    factors: np.ndarray  # (terms, factors)

    def scores(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores of documents whose terms lie one after the other in ``terms``."""
        return 1 / (1 + np.exp(-np.clip(self._margin(terms, counts)[0], -30, 30)))

    def _margin(self, terms, counts):
        doc = np.repeat(np.arange(len(counts)), counts)
        n = len(counts)
        v = self.factors[terms]
        sums = np.stack([np.bincount(doc, v[:, f], n) for f in range(v.shape[1])], 1) if len(terms) else np.zeros((n, self.factors.shape[1]))
        squares = np.bincount(doc, (v * v).sum(1), n) if len(terms) else np.zeros(n)
        linear = np.bincount(doc, self.weights[terms], n) if len(terms) else np.zeros(n)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), doc, v, sums


def terms_of(texts: list[str | None], p: FactorizationParameters) -> list[np.ndarray]:
    """The distinct hashed terms of each text, sorted: its lower-cased words and their beginnings."""
    out = []
    for text in texts:
        words = {*(text or "").lower().encode().translate(_TO_SPACE).split()}
        if not words:
            out.append(np.zeros(0, np.int32))
            continue
        words |= {b"^" + w[:k] for w in words for k in p.stems if len(w) > k}
        joined = b" ".join(words)
        hashes, _ = word_hashes(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), fold=False)
        out.append(np.unique(mix(hashes) >> np.uint64(64 - p.bits)).astype(np.int32))
    return out


def association(seen: np.ndarray, marked: np.ndarray, rows: float, positive: float) -> np.ndarray:
    """Signed root of the likelihood ratio between a term's rate of the label and that of all rows."""
    base = (positive + 0.5) / (rows + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = marked / seen
        one = np.where(marked > 0, marked * np.log(rate / base), 0)
        other = np.where(seen > marked, (seen - marked) * np.log((1 - rate) / (1 - base)), 0)
    return np.where(seen > 0, np.sign(rate - base) * np.sqrt(np.maximum(2 * (one + other), 0)), 0)


def telling_pairs(terms: list[np.ndarray], labels: np.ndarray, seen: np.ndarray, z: np.ndarray, p: FactorizationParameters) -> np.ndarray:
    """Terms that tell the label in company of another one, though perhaps not alone.

    Rows are counted for all pairs of the most frequent terms, but not of those in nearly every text.
    """
    order = np.argsort(-np.where(seen <= 0.9 * len(labels), seen, 0), kind="stable")[: p.pair_terms]
    order = order[seen[order] >= p.least_rows]
    place = np.full(len(seen), -1)
    place[order] = np.arange(len(order))
    both, marked = (np.zeros((len(order), len(order)), np.float32) for _ in range(2))
    for at in range(0, len(terms), 1024):
        part = [place[t] for t in terms[at : at + 1024]]
        part = [t[t >= 0] for t in part]
        x = np.zeros((len(part), len(order)), np.float32)
        x[np.repeat(np.arange(len(part)), [len(t) for t in part]), np.concatenate(part)] = 1
        both += x.T @ x
        own = x[labels[at : at + 1024] > 0]
        marked += own.T @ own
    a, b = np.nonzero(np.triu(both, 1) >= p.least_rows)
    found = np.abs(association(both[a, b].astype(float), marked[a, b].astype(float), len(labels), labels.sum()))
    alone = np.abs(z[order])
    good = (found >= p.pair_z) & (found >= np.maximum(alone[a], alone[b]) + p.pair_lead)
    return order[np.unique(np.concatenate([a[good], b[good]]))]


def train(terms: list[np.ndarray], labels: np.ndarray, p: FactorizationParameters) -> FactorizationMachine:
    """Mini-batch AdaGrad on the log loss, over the terms whose association with the label is beyond chance.

    Among so many terms some keep company with the label by accident; without the screening they add up in
    long texts.
    """
    size = 1 << p.bits
    model = FactorizationMachine(0.0, np.zeros(size), np.zeros((size, p.factors)))
    if not len(labels):
        return model
    rng = np.random.default_rng(p.seed)
    every = np.concatenate(terms)
    seen = np.bincount(every, minlength=size).astype(float)
    marked = np.bincount(every, np.repeat(labels, [len(t) for t in terms]), size)
    z = association(seen, marked, len(labels), labels.sum())
    linear = (seen >= p.least_rows) & (np.abs(z) >= p.linear_z)
    common = (seen >= p.least_rows) & (np.abs(z) >= p.factor_z)
    company = telling_pairs(terms, labels, seen, z, p)
    linear[company] = common[company] = True
    terms = [t[common[t]] for t in terms]
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model.bias = float(np.log(share / (1 - share)))
    model.factors[common] = rng.normal(0, 0.01, (int(common.sum()), p.factors))
    model.factors[company] *= 10
    sum_w, sum_v, sum_b = np.full(size, 1e-3), np.full((size, p.factors), 1e-3), 1e-3
    for _ in range(p.epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), p.batch):
            rows = order[at : at + p.batch]
            counts = np.array([len(terms[r]) for r in rows])
            flat = np.concatenate([terms[r] for r in rows]) if counts.sum() else np.zeros(0, np.int32)
            margin, doc, v, sums = model._margin(flat, counts)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            sum_b += error.sum() ** 2
            model.bias -= p.rate * error.sum() / np.sqrt(sum_b)
            if not len(flat):
                continue
            ids, inverse = np.unique(flat, return_inverse=True)
            e = error[doc]
            g = np.bincount(inverse, e, len(ids))
            sum_w[ids] += g * g
            step = p.rate / np.sqrt(sum_w[ids])
            w = model.weights[ids] - step * g
            model.weights[ids] = np.where(linear[ids], np.sign(w) * np.maximum(np.abs(w) - step * p.l1, 0), 0)
            pull = e[:, None] * (sums[doc] - v)
            g = np.stack([np.bincount(inverse, pull[:, f], len(ids)) for f in range(p.factors)], 1) + p.l2 * model.factors[ids]
            sum_v[ids] += g * g
            model.factors[ids] -= p.rate * 0.3 * g / np.sqrt(sum_v[ids])
    return model


def fit(docs: DataFrame, labels: DataFrame, p: FactorizationParameters = FactorizationParameters(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Train on labelled rows outside the held-out fold: all of them, or a hash sample of about ``sample_rows``."""
    short_batches(docs.sparkSession)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(p.folds))
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id is not null and label is not null")
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label")).where(fold != p.held_out)
    n = marked.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, p.sample_rows / max(n, 1)) * (1 << 20)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(part)
    rows = texts.join(marked.where(part), "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = terms_of(batch.column(1).to_pylist(), p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([t.tobytes() for t in terms], pa.binary())], names=["doc_id", "label", "terms"])

    found = sorted((r[0], r[1], r[2]) for r in rows.mapInArrow(run, "doc_id long, label double, terms binary").collect())
    return train([np.frombuffer(r[2], np.int32) for r in found], np.array([r[1] for r in found]), p)


def score(docs: DataFrame, model: FactorizationMachine, p: FactorizationParameters = FactorizationParameters(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, from whole texts.

    Null and empty texts score the model's prior. Repeated rows score alike. A null doc_id comes back null
    and is not held out. An empty table gives an empty result; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    used = np.flatnonzero(model.weights.astype(bool) | model.factors.any(1)).astype(np.int32)
    packed = (float(model.bias), used, model.weights[used].astype(np.float32), model.factors[used].astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # at most 2 ** bits terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, used, weights, factors = shared.value
        own = FactorizationMachine(bias, np.zeros(1 << p.bits), np.zeros((1 << p.bits, p.factors)))
        own.weights[used], own.factors[used] = weights, factors
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                terms = terms_of(part.column(1).to_pylist(), p)
                flat = np.concatenate(terms) if terms else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores(flat, np.array([len(t) for t in terms])))], names=["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(p.folds)) == p.held_out, F.lit(False))
    return source.mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
