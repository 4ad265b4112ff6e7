"""Language identification by Bayesian fusion of text, declared language, address and host.

posterior(l | page) ~ prior(l | host) * P(text | l)^t * P(declared | l) * P(address code | l)

Text likelihoods are octet trigram counts of labelled texts, over all of them. The host prior is smoothed
hierarchically, host <- domain <- address suffix <- everything, from sums by key of first-pass posteriors, a page's own
share taken out. How far declarations are to be trusted is counted from the first pass, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.groups import text_buffers
from docquarry.llm.tables import Scratch, short_batches

_OPENS = re.compile(rb"<(?:!--|(script|style|noscript|template)\b)", re.I)
_CLOSES = {name: re.compile(b"</" + name + rb"\s*>", re.I) for name in (b"script", b"style", b"noscript", b"template")} | {None: re.compile(b"-->")}
_DECLARED = re.compile(rb"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_META = re.compile(rb"<meta\b([^<>]*)", re.I)
_EQUIV = re.compile(rb"\bhttp-equiv\s*=\s*[\"']?content-language\b", re.I)
_CONTENT = re.compile(rb"\bcontent\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
#: Labels below a country's suffix that anybody may register under.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "net", "or", "org")


@dataclass(frozen=True)
class LanguageParameters:
    cells: int = 1 << 14  # hashed trigrams
    smoothing: float = 0.5  # added to each cell's count
    evidence: float = 40.0  # trigrams that a text counts as at most, for neighbours are not independent
    host_weight: float = 8.0  # pages that the level above weighs in a host's prior
    least: float = 0.5  # posteriors below give no language ("und")
    languages: int = 200  # of the model, the most frequent labels; texts with others count as unlabelled, as the model's size follows their number


def _trigram_cells(octets: np.ndarray, offsets: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each trigram, its text); A-Z lower-cased, digits and marks as spaces."""
    table = np.arange(256, dtype=np.uint32)
    table[:128] = 32
    table[97:123] = table[65:91] = np.arange(97, 123)
    b = table[octets]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    cell = (h >> np.uint32(7)) % np.uint32(cells)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (text[:-2] == text[2:]) & ~((b[:-2] == 32) & (b[1:-1] == 32))
    return cell[inside].astype(np.int64), text[:-2][inside]


def text_model(docs: DataFrame, p: LanguageParameters, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each cell by language), counted over all labelled texts.

    Each task adds up its own counts, so languages * ``cells`` rows a task are shuffled, and as many in all collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                octets, offsets = text_buffers(part.column(0))
                cell, text = _trigram_cells(octets, offsets, p.cells)
                names, codes = np.unique(np.array(part.column(1).to_pylist(), object), return_inverse=True)
                both = np.bincount(codes[text] * p.cells + cell, minlength=len(names) * p.cells).reshape(len(names), p.cells) if len(names) else []
                for name, row in zip(names, both):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            some = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some), pa.array(row[some].astype(np.int64))], names=["lang", "cell", "n"])

    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.lower(F.col(lang_col).cast("string")).alias("lang")).where("text is not null and lang is not null")
    # the most frequent labels, in a list that is bounded by a parameter
    common = [r.lang for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(p.languages).collect()]
    labelled = labelled.where(F.col("lang").isin(common)) if common else labelled
    rows = labelled.mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r[0] for r in rows})
    counts = np.full((len(languages), p.cells), p.smoothing)
    at = {name: k for k, name in enumerate(languages)}
    for name, cell, n in rows:
        counts[at[name], cell] += n
    return languages, np.log(counts / counts.sum(1, keepdims=True)) if languages else counts


def declared_language(html: bytes) -> str | None:
    """What the root element declares, else the first content-language tag. A tag ends at the next angle bracket."""
    if m := _DECLARED.search(html):
        return m[1].decode().lower()
    for tag in _META.finditer(html):
        named = _EQUIV.search(tag[1])
        if m := named and _CONTENT.search(tag[1], named.end()):
            return m[1].decode().lower()
    return None


def visible_text(html: bytes) -> bytes:
    """The octets between tags, without scripts, styles and comments; each of those becomes a blank.

    What isn't closed is a tag like any other. Once a closing mark isn't found it isn't looked for again, and without
    a further ">" there is no further tag, so a page is gone over a bounded number of times.
    """
    out, at, missing = [], 0, set()
    while (low := html.find(b"<", at)) >= 0:
        opened = _OPENS.match(html, low)
        name = opened[1] and opened[1].lower() if opened else None
        closed = _CLOSES[name].search(html, opened.end()) if opened and name not in missing else None
        if opened and not closed:
            missing.add(name)
        end = closed.end() if closed else html.find(b">", low) + 1
        if not end:
            break
        out += html[at:low], b" "
        at = end
    return b"".join([*out, html[at:]])


def _text_evidence(pages: DataFrame, languages: list[str], logs: np.ndarray, p: LanguageParameters) -> DataFrame:
    """(page_id, url, declared, n_trigrams, loglik): loglik is scaled to at most ``evidence`` trigrams."""
    shared = pages.sparkSession.sparkContext.broadcast(logs.astype(np.float32))  # languages * cells numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [(h or "").encode() for h in part.column(2).to_pylist()]
                declared = [declared_language(h) for h in raw]
                texts = [visible_text(h) for h in raw]
                offsets = np.cumsum([0, *map(len, texts)])
                cell, text = _trigram_cells(np.frombuffer(b"".join(texts), np.uint8), offsets, p.cells)
                n = np.bincount(text, minlength=len(texts))
                sums = np.stack([np.bincount(text, row[cell], len(texts)) for row in logs], 1) if len(logs) else np.zeros((len(texts), 0))
                scaled = sums * np.minimum(1, p.evidence / np.maximum(n, 1))[:, None]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(declared, pa.string()), pa.array(n.astype(np.int64)), pa.array(list(scaled), pa.list_(pa.float64()))], names=["page_id", "url", "declared", "n_trigrams", "loglik"])

    return pages.mapInArrow(run, "page_id long, url string, declared string, n_trigrams long, loglik array<double>")


def _softmax(scores: Column) -> Column:
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, keys: list[str], posterior: str, n: int) -> DataFrame:
    """Sums of posteriors by key, as an array; partial sums go first, so a hot host costs a row a task."""
    total = df.groupBy(*keys).agg(*(F.sum(F.col(posterior)[k]).alias(f"s{k}") for k in range(n)))
    return total.select(*keys, F.array(*(F.col(f"s{k}") for k in range(n))).alias("sums"))


def _address(url: Column) -> tuple[Column, Column, Column, Column]:
    """(host, domain, suffix, language code in the path or before the host) of an address."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    parts = F.split(host, r"\.")
    suffix = F.element_at(parts, -1)
    shared = (F.size(parts) > 2) & (F.length(suffix) == 2) & F.get(parts, F.size(parts) - 2).isin(*SECOND_LEVEL)
    own = F.when(shared, 3).otherwise(2)  # labels of a domain that one owner has
    domain = F.array_join(F.slice(parts, F.greatest(F.size(parts) - own + 1, F.lit(1)), own), ".")
    before = F.nullif(F.regexp_extract(host, r"^([a-z]{2})\.[^.]+\.", 1), F.lit(""))
    code = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    return host, domain, suffix, F.coalesce(F.nullif(code, F.lit("")), before)


def identify(pages: DataFrame, labelled: DataFrame, p: LanguageParameters = LanguageParameters(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(page_id, lang, posterior, text_lang, declared, host, n_trigrams) for every row of ``pages``.

    ``labelled`` has texts and their languages. A page without visible text, declaration and address is decided
    by the priors; lang is "und" below ``least``. Unknown declared or address codes say nothing. Null urls and html
    are empty. Repeated rows are judged alike; null ids come back null. Empty ``pages`` give an empty result; without
    labelled texts all is "und". Other columns are ignored.
    """
    spark = pages.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "langid")
    languages, logs = text_model(labelled, p, text_col, lang_col)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    evidence = _text_evidence(source, languages, logs, p)
    host, domain, suffix, code = _address(F.col("url"))
    n = len(languages)
    if not n:
        return evidence.select("page_id", F.lit("und").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit("und").alias("text_lang"), "declared", host.alias("host"), "n_trigrams")
    known = lambda c: F.when(c.isin(languages), c)
    first = evidence.select("page_id", "declared", known(F.col("declared")).alias("said"), known(code).alias("code"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), "n_trigrams", "loglik", _softmax(F.col("loglik")).alias("belief"))
    table = scratch.save(first, "first")

    # how often each language is declared, or in the address, as each language: at most n * n numbers
    def trust(column: str) -> np.ndarray:
        rows = _sums(table.where(f"{column} is not null"), [column], "belief", n).collect()
        seen = np.full((n, n), 0.5) + 2.0 * np.eye(n)  # a prior in favour of what is said
        for r in rows:
            seen[:, languages.index(r[0])] += np.array(r["sums"])
        return np.log(seen / seen.sum(1, keepdims=True))

    def said(column: str, logs: np.ndarray) -> Column:
        out = F.array(*(F.lit(0.0) for _ in languages))
        for k, name in enumerate(languages):
            out = F.when(F.col(column) == name, F.array(*(F.lit(float(x)) for x in logs[:, k]))).otherwise(out)
        return out

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = table.withColumn("score", add(add(F.col("loglik"), said("said", trust("said"))), said("code", trust("code")))).withColumn("belief", _softmax(F.col("score")))
    fused = scratch.save(fused, "fused")
    hosts = scratch.save(_sums(fused, ["suffix", "domain", "host"], "belief", n), "hosts")
    up = lambda t, keys: t.groupBy(*keys).agg(*(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(n))).select(*keys, F.array(*(F.col(f"s{k}") for k in range(n))).alias("sums"))
    total = hosts.agg(*(F.coalesce(F.sum(F.col("sums")[k]), F.lit(0.0)) for k in range(n))).first()
    everything = np.array(total) + 1.0
    everything = everything / everything.sum()
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    smooth = lambda sums, above: F.transform(F.arrays_zip(sums.alias("own"), above.alias("above")), lambda z: (z["own"] + p.host_weight * z["above"]) / (size(sums) + p.host_weight))
    suffixes = up(hosts, ["suffix"]).select(F.col("suffix").alias("suffix2"), smooth(F.col("sums"), F.array(*(F.lit(float(x)) for x in everything))).alias("above"))
    domains = up(hosts, ["suffix", "domain"]).join(suffixes, F.col("suffix") == F.col("suffix2")).select(F.col("domain").alias("domain2"), smooth(F.col("sums"), F.col("above")).alias("above"))
    priors = hosts.join(domains, F.col("domain") == F.col("domain2")).select(F.col("host").alias("host2"), F.col("sums"), "above")
    priors = scratch.save(priors, "priors")
    joined = fused.join(priors, F.col("host") == F.col("host2"), "left")
    without = F.zip_with("sums", "belief", lambda s, b: F.greatest(s - b, F.lit(0.0)))  # a page is no evidence for itself
    prior = smooth(without, F.col("above"))
    final = joined.withColumn("final", _softmax(F.zip_with("score", prior, lambda s, q: s + F.log(q))))
    best = F.array_max("final")
    name = lambda scores: F.element_at(F.array(*(F.lit(x) for x in languages)), F.array_position(scores, F.array_max(scores)).cast("int"))
    return final.select("page_id", F.when(best >= p.least, name(F.col("final"))).otherwise("und").alias("lang"), best.alias("posterior"), F.when(F.col("n_trigrams") > 0, name(F.col("loglik"))).otherwise("und").alias("text_lang"), "declared", "host", "n_trigrams")
