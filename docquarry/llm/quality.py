"""Quality rules as weak supervision.

Each rule votes good or bad or abstains. Expectation-maximisation estimates, from all documents and without
labels, how often each rule votes bad on good and on bad documents; a document's verdict is its posterior
probability of being good, so that no single rule decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.groups import text_buffers
from docquarry.llm.shingles import windows, word_hashes
from docquarry.llm.tables import Scratch, short_batches

#: Frequent words of the languages served.
FUNCTION_WORDS = (
    "a and are as at be by for from had has have he her his in is it not of on or she that the their they this to was were which with you "
    "als auch auf aus bei das dem den der des die ein eine einer es für hat ich im ist mit nicht sich sie sind und von war werden wie zu zum "
    "au aux avec ce cette dans de du elle en est et il ils je la le les mais ne nous ou par pas plus pour que qui sa se ses son sur un une vous "
    "al como con del el ella es esta este la las lo los más no para pero por se sin su sus también una y"
)
_FUNCTION_WORDS = frozenset(w.encode() for w in FUNCTION_WORDS.split())
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_ODD_RUN = re.compile(rb"[!?]{2,}|\|")

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_function", "n_upper", "n_lower", "n_odd", "n_distinct"]


@dataclass(frozen=True)
class Rule:
    """``value`` of the features, bad at or above ``bad`` and good at or below ``good``; null or between: abstains."""

    name: str
    value: str
    good: float
    bad: float


RULES = (
    Rule("few_words", "-n_words", -100, -49),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", 0.02, 0.1),
    Rule("repeated_lines", "n_dup_lines / nullif(n_lines, 0)", 0.05, 0.3),
    Rule("repeated_words", "n_repeat_words / nullif(n_words, 0)", 0.15, 0.4),
    Rule("word_length", "abs(word_chars / nullif(n_words, 0) - 6)", 2.5, 5),
    Rule("capitals", "n_upper / nullif(n_upper + n_lower, 0)", 0.15, 0.5),
    Rule("function_words", "-n_function / nullif(n_words, 0)", -0.1, -0.01),
    Rule("odd_marks", "n_odd / nullif(n_words, 0)", 0.05, 0.2),
    Rule("few_distinct", "-n_distinct / nullif(n_words, 0)", -0.4, -0.15),
)


@dataclass(frozen=True)
class QualityParameters:
    least_words: int = 50
    repeat_percent: int = 50
    posterior: float = 0.5  # documents below are dropped
    rounds: int = 200
    rules: tuple[Rule, ...] = RULES


def _repeated(h: np.ndarray) -> int:
    """Words in windows that occur twice or more; ``h``: the hash of each 3-word window."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    words = np.zeros(len(h) + 2, bool)
    for k in range(3):
        words[k : k + len(h)] |= twice
    return int(words.sum())


def _measure(texts: pa.Array) -> list[tuple]:
    octets, offsets = text_buffers(texts)
    hashes, counts = word_hashes(octets, offsets, fold=False)
    triples = windows(hashes, 3)
    whole, out, at = octets.tobytes(), [], 0
    for low, high, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), counts.tolist()):
        data = whole[low:high]
        words = data.lower().split()
        lines = [x for x in data.split(b"\n") if x.strip()]
        solid = data.translate(None, _SPACES)
        chars = len(solid.decode("utf-8", "replace")) if not solid.isascii() else len(solid)
        out.append(
            (
                n,
                chars,
                len(data) - len(data.translate(None, _SYMBOLS)),
                len(lines) - len(set(lines)),
                _repeated(triples[at : at + n - 2]) if n > 2 else 0,
                len(lines),
                sum(map(_FUNCTION_WORDS.__contains__, words)),
                len(data) - len(data.translate(None, _UPPER)),
                len(data) - len(data.translate(None, _LOWER)),
                len(_ODD_RUN.findall(data)),
                # distinct words of each 400 in a row, summed, so that long texts compare with short ones
                sum(len(set(words[k : k + 400])) for k in range(0, n, 400)),
            )
        )
        at += n
    return out


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and the ``FEATURES`` of the whole text (null: empty), as longs named with ``prefix``."""
    short_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + f, T.LongType()) for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(zip(*_measure(part.column(place))))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(f, pa.int64()) for f in found)], names=schema.names)

    return docs.mapInArrow(run, schema)


def votes(p: QualityParameters, prefix: str = "") -> list:
    """A column for each rule: 1 bad, 0 good, null abstains."""

    def vote(rule: Rule):
        value = F.expr(re.sub(r"\bn_\w+|\bword_chars", lambda m: f"`{prefix}{m[0]}`", rule.value))
        return F.when(value >= rule.bad, 1).when(value <= rule.good, 0)

    return [vote(r) for r in p.rules]


def pattern(p: QualityParameters, prefix: str = ""):
    """All votes as one number in base 3, abstentions 2."""
    out = F.lit(0)
    for v in votes(p, prefix):
        out = out * 3 + F.coalesce(v, F.lit(2))
    return out.cast("int")


def base_failed(p: QualityParameters, prefix: str = ""):
    n, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < p.least_words) | (100 * repeat > p.repeat_percent * n)


def expectation_maximisation(counts: dict[int, int], rules: int, rounds: int) -> tuple[dict[int, float], np.ndarray, float]:
    """(posterior of good by pattern, chance of a bad vote by rule on good and bad documents, share of good ones).

    Starts from the share of bad votes. A rule keeps at least as high a rate of bad votes on bad documents as
    on good ones, else the two classes could change names.
    """
    if not counts:
        return {}, np.zeros((rules, 2)), 1.0
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes.tolist()], float)
    vote = np.array([[c // 3 ** (rules - 1 - k) % 3 for k in range(rules)] for c in codes.tolist()]).reshape(len(codes), rules)
    bad, good = vote == 1, vote == 0
    belief = 1 - 0.15 ** bad.sum(1) * 0.999  # of being bad
    for _ in range(rounds):
        before = belief
        share = ((n * belief).sum() + 1) / (n.sum() + 10)
        rate = np.empty((rules, 2))
        for k, w in enumerate((n * (1 - belief), n * belief)):
            rate[:, k] = ((w[:, None] * bad).sum(0) + (0.05, 0.5)[k]) / ((w[:, None] * (bad | good)).sum(0) + 1)
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        rate[:, 1] = np.maximum(rate[:, 0], rate[:, 1])
        odds = np.log(share / (1 - share)) + (bad * np.log(rate[:, 1] / rate[:, 0]) + good * np.log((1 - rate[:, 1]) / (1 - rate[:, 0]))).sum(1)
        belief = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        if np.abs(belief - before).max() < 1e-9:
            break
    return dict(zip(codes.tolist(), (1 - belief).tolist())), rate, 1 - share


def _posteriors(table: DataFrame, p: QualityParameters, column: str) -> DataFrame:
    """(pattern, posterior): at most 3 ** rules rows, whatever the input."""
    counts = {r[0]: r[1] for r in table.groupBy(column).agg(F.count(F.lit(1))).collect()}
    found, _, _ = expectation_maximisation(counts, len(p.rules), p.rounds)
    return F.broadcast(table.sparkSession.createDataFrame(sorted(found.items()), f"`{column}` int, `{column}_posterior` double"))


def judge(docs: DataFrame, p: QualityParameters = QualityParameters(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior) per row.

    Null and empty texts have no words and fail. Repeated rows are judged alike, each on its own. An empty table
    gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    own = measured(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).drop("text")
    table = scratch.save(own.select("*", base_failed(p).alias("base_failed"), pattern(p).alias("pattern")), "measured")
    out = table.join(_posteriors(table, p, "pattern"), "pattern").withColumnRenamed("pattern_posterior", "posterior")
    kept = ~F.col("base_failed") & (F.col("posterior") >= p.posterior)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "posterior")


def keep_good(docs: DataFrame, p: QualityParameters = QualityParameters(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns and nothing else.

    Votes are counted over all rows, those that fail the base rules included, as ``judge`` does; of those only the
    votes are stored. Null and empty texts fail. Repeated rows are judged alike, each on its own; nulls in other columns
    don't matter, and columns may have any name. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality-filter")
    prefix = "_quality_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    code, row = f"{prefix}pattern", f"{prefix}row"
    stored = F.when(~base_failed(p, prefix), F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(row)
    table = scratch.save(measured(docs, text_col, prefix).select(stored, pattern(p, prefix).alias(code)), "measured")
    out = table.join(_posteriors(table, p, code), code)
    return out.where(F.col(row).isNotNull() & (F.col(f"{code}_posterior") >= p.posterior)).select(*(F.col(row)[c].alias(c) for c in docs.columns))
