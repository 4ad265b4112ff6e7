"""Frequent lines, Merkle manifests and ranked search against plain versions, on odd tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docquarry.llm import lexical, line_dedup, merkle
from docquarry.llm.perfect import PerfectHash, build
from docquarry.llm.tables import Scratch

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, rank int, term string"


def corpus(spark, n=120):
    rng = np.random.default_rng(4)
    lines = [f"line {k} of the Set" for k in range(40)] + ["", "  ", "ÄÖÜ straße", "x", " wide ", "tab\there", "Σίγμα"]
    rows = []
    for k in range(n):
        text = "\n".join(lines[j] + (" \r" if rng.random() < 0.2 else "") for j in rng.zipf(1.3, rng.integers(0, 30)) % len(lines))
        rows.append((k, text, "en" if k % 3 else None, None if k % 11 == 0 else f"src{k % 4}", len(text), 1, 2, "x"))
    rows += [(3, "again\nLINE 3 of the set", "en", "src0", 5, 1, 2, "y"), rows[5], rows[5], (None, "line 1 of the set\nline 2 of the set", "de", "src1", None, 1, 2, "z")]
    rows += [(500, None, None, None, None, None, None, None), (501, "", "", "", 0, None, None, None), (502, "\n" * 50, "en", "Ä", 50, None, None, None), (503, "long " * 200_000 + "\nx", "en", "lone", 1, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), [(r[0], r[1], r[2], r[3], r[4]) for r in rows]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        high, low = rng.integers(0, 2**63, (2, n), dtype=np.uint64)
        high[: n // 2] = 7  # only the other half tells them apart
        numbers = PerfectHash(*build(high, low)).numbers(high, low)
        assert sorted(numbers.tolist()) == list(range(n))
    sizes, words = build(high, low)
    assert 64 * len(words) < 6 * n and (PerfectHash(sizes, words).numbers(low, high) < n).all()


def plain_lines(rows, least, chars=1):
    keys = [[line.strip(WHITE).translate(LOWER) for line in (r[1] or "").split("\n")] for r in rows]
    often = {k for k, c in Counter(k for own in keys for k in set(own)).items() if c >= least and len(k) >= chars}
    out = []
    for r, own in zip(rows, keys):
        parts = (r[1] or "").split("\n")
        kept = [line for line, k in zip(parts, own) if k not in often]
        out.append((r[0], "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("p", [line_dedup.LineParameters(), line_dedup.LineParameters(least_documents=3, least_chars=2, block_octets=500, shard_lines=10), line_dedup.LineParameters(least_documents=300)])
def test_frequent_lines(spark, p):
    docs, rows = corpus(spark)
    found = line_dedup.drop_frequent_lines(docs.repartition(3), p).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found), key=repr) == plain_lines(rows, p.least_documents, p.least_chars)
    assert sum(r.n_dropped for r in found) > 0 or p.least_documents > 100
    assert line_dedup.drop_frequent_lines(docs.limit(0), p).count() == 0


def test_a_line_that_all_documents_hold_is_an_entry_a_block(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('Same line\\nown ', id) as text").repartition(4)
    p = line_dedup.LineParameters(block_octets=4000)
    scratch = Scratch(spark, "test")
    blocks = scratch.save(line_dedup._blocks(docs, p), "blocks")
    sharded = line_dedup._sharded(blocks, 5)
    index = line_dedup.index_lines(sharded, p).collect()
    assert sum(len(r.fingerprints) for r in index) == 4 * 3001 and sum(len(r.counts) for r in index) == 3001
    counts = np.concatenate([np.frombuffer(r.counts, np.uint8) for r in index])
    assert sorted(counts.tolist())[-2:] == [1, 255]  # counters stay at their end
    out = line_dedup.drop_frequent_lines(docs, p).collect()
    assert {(r.text, r.n_dropped) for r in out} == {(f"own {k}", 1) for k in range(3000)}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def up(levels, place, fold, proof):
    for nodes in levels[:-1]:
        low = place // 3 * 3
        before, after = nodes[low:place], nodes[place + 1 : low + 3]
        proof, fold, place = [*proof, *before, *after], sha(*before, fold, *after), place // 3
    return fold, proof


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda doc, text, lang, source, n: sha(*map(field, (doc, source, lang, n, text)))
    sources = {}
    for doc, text, lang, source, n in rows:
        cut = text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text
        sources.setdefault(source, []).append((doc is not None, doc or 0, leaf(doc, text, lang, source, n), leaf(doc, cut, lang, source, n), doc))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for place, x in enumerate(sorted(sources[s])):
            fold, proof = up(trees[s], place, x[3], [])
            fold, proof = up(top, names.index(s), fold, proof)
            out.append((x[4], x[2], trees[s][-1][0], top[-1][0], sha(*proof), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(spark, levels):
    docs, rows = corpus(spark)
    p = merkle.MerkleParameters(levels=levels)
    found = sorted((tuple(r) for r in merkle.manifest(docs, p).collect()), key=repr)
    assert found == plain_manifest(rows)
    assert {r[-1] for r in found} == {True, False}
    assert merkle.manifest(docs.limit(0), p).count() == 0
    lone = rows[:1]
    assert [tuple(r) for r in merkle.manifest(docs.where("doc_id = 0"), p).collect()] == plain_manifest(lone)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 27, 28, 81, 82])
def test_manifest_of_full_blocks(spark, n):
    rows = [(k, f"a\n{k}", "en", "s", 1) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted((tuple(r) for r in merkle.manifest(docs, merkle.MerkleParameters(levels=2)).collect()), key=repr)
    assert found == plain_manifest(rows)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, top=20):
    docs = [(r[0], TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    docs = [(i, w) for i, w in docs if w]
    n, total = len(docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in items:
        asked, scored = TERM.findall((text or "").translate(LOWER)), []
        for doc, words in docs:
            tf, m = Counter(words), 75 + (25 * len(words) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in asked if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k, None if null else doc, -score) for k, (score, null, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("p", [lexical.LexicalParameters(), lexical.LexicalParameters(top=3, block=4, shard_octets=2000, queries_together=2, small_terms=0)])
def test_ranked_search(spark, p):
    docs, rows = corpus(spark)
    items = [(1, "line 3 of the SET"), (2, "Σίγμα straße x x x"), (3, None), (4, ""), (5, "nowhere"), (1, "tab here wide"), (6, "--;;!"), (7, "again"), (None, "line 7")]
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, query int")
    found = lexical.ranked_search(docs.repartition(3), asked, p).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_search(rows, items, p.top)
    assert lexical.ranked_search(docs.limit(0), asked, p).count() == 0 and lexical.ranked_search(docs, asked.limit(0), p).count() == 0


def test_search_passes_blocks_without_decompressing_them():
    rng = np.random.default_rng(3)
    n, m = 20_000, np.full(20_000, 100)
    lists = []
    for df in (12_000, 9000, 4000, 700, 60, 3):
        docs = np.sort(rng.choice(n, df, replace=False) if df > 1000 else 3500 + rng.choice(1000, df, replace=False))
        tf = np.where(docs // 500 == 7, rng.integers(20, 300, df), rng.zipf(3.5, df).clip(1, 9))
        (row,) = lexical.pack_postings(np.zeros(df, int), docs, tf, lexical.impact(tf, m[docs]), 128)
        postings = lexical.Postings(*row[1:], 128)
        back = [postings.block(k, m) for k in range(len(postings.last))]
        assert np.array_equal(np.concatenate([b[0] for b in back]), docs) and np.array_equal(np.concatenate([b[1] for b in back]), lexical.impact(tf, m[docs]))
        postings.open.clear()
        lists.append((postings, int(1000 * math.log(2 * n / (2 * df + 1))), docs, lexical.impact(tf, m[docs])))
    scores = np.zeros(n, np.int64)
    for _, weight, docs, impacts in lists:
        scores[docs] += weight * impacts
    want = np.lexsort((np.arange(n), -scores))[:20]
    docs, found = lexical.block_max_wand([(p, w) for p, w, *_ in lists], m, 20)
    assert docs.tolist() == want.tolist() and found.tolist() == scores[want].tolist()
    opened = sum(len(p.open) for p, *_ in lists)
    assert opened < 0.3 * sum(len(p.last) for p, *_ in lists)


def test_terms():
    texts = pa.array(["Ab-c ÄÖ", "", None, "x", "y z9_ q"])
    words, counts = lexical.terms_of(texts)
    assert counts.tolist() == [3, 0, 0, 1, 3] and words.to_pylist() == ["ab", "c", "ÄÖ", "x", "y", "z9", " q"]
