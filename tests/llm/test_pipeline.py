"""The corpus pipeline against a plain version of its stages."""

from __future__ import annotations

import re

import corpus_pipeline
from docquarry.llm import quality

SMALL = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    sets = {}
    for d in docs.collect():
        if d.doc_id in kept:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text))
            sets[d.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {d for d in sets if find(d) == d}

    packed = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(packed.doc_id) == left
    packed = packed.sort_values(["sequence_id", "offset"])
    assert (packed.groupby("sequence_id").length.cumsum() - packed.length == packed.offset).all() and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_keep_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    secret = docs.where("text rlike 'AKIA[A-Z0-9]{16}|[0-9a-f]{18}'").count()
    marked = corpus_pipeline.secret_scans(spark, docs, SMALL)
    assert marked.columns == docs.columns and marked.count() == docs.count()
    assert marked.where("text like '%[SECRET]%'").count() >= secret > 0
    assert corpus_pipeline.mix_sources(spark, docs, SMALL).columns == docs.columns


ODD = "doc_id long, text string, lang string, source string, n_chars long, gone string, _gone int, _candidates string, _words int, _row int, mix_slot string, place int, rank int, doc string, _quality_n_words int, digest string"


def odd_table(spark):
    good = " ".join(f"the river{k} of {k} words runs{k} on and is{k} not in {k * k} the same{k} place." for k in range(40))
    near = good.replace("river7 ", "river seven ")
    rest = ("g", 1, "c", 2, 3, "m", 4, 5, "d", 6, "x")
    rows = [(1, good, "en", "a", 1), (2, near, None, "b", None), (3, None, "en", None, 0), (None, good + " tail of another kind.", "en", "a", 2), (4, "", None, None, None)]
    rows += [(5, "And " + " ".join(f"another {k} text{k} with its{k} own {k * k} matter of{k} the day{k}" for k in range(300)), "en", "a", 9)] * 3
    rows += [(6, " ".join(f"w{k} and the {k % 7}" for k in range(20_000)), "en", "c", 10), (7, good, "fr", "c", 1)]
    return spark.createDataFrame([(*r, *rest) for r in rows], ODD)


def test_stages_of_odd_tables(spark):
    odd = odd_table(spark)
    for name, stage in corpus_pipeline.STAGES:
        whole, empty = stage(spark, odd, SMALL), stage(spark, odd.limit(0), SMALL)
        assert empty.count() == 0, name
        if name != "best_fit_packing":
            assert whole.columns == odd.columns and empty.columns == odd.columns, name
    keys = lambda df: sorted((r.doc_id is None, r.doc_id) for r in df.select("doc_id").collect())
    every = keys(odd)
    good = keys(corpus_pipeline.quality_rules(spark, odd, SMALL))
    assert {3, 4}.isdisjoint(k for _, k in good) and good.count((False, 5)) in (0, 3) and (False, 1) in good
    left = keys(corpus_pipeline.minhash_dedup(spark, odd, SMALL))
    assert left == sorted([(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (True, None)])
    assert keys(corpus_pipeline.secret_scans(spark, odd, SMALL)) == every == keys(corpus_pipeline.mix_sources(spark, odd, SMALL))
    pieces = corpus_pipeline.best_fit_packing(spark, odd, SMALL).where("piece = 0")
    assert keys(pieces) == every


def test_mix_reaches_the_sequences(spark, tmp_path):
    """Within a window's sequences the sources have the shares that the mix gives them there."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    corpus_pipeline.mix_sources(spark, docs, SMALL).write.parquet(f"{tmp_path}/m")
    mixed = spark.read.parquet(f"{tmp_path}/m")
    order = [r.doc_id for r in mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    from docquarry.llm import mixing, packing, queries

    wanted = [r.doc_id for r in mixing.mix(docs.select("doc_id", "source")).orderBy("mix_position").collect()]
    assert order == wanted
    packed = packing.pack_in_order(mixed, queries.tokenizer_file(), 2048, window_docs=200).toPandas()
    place = {d: k for k, d in enumerate(order)}
    first = packed.assign(window=packed.doc_id.map(place) // 200).groupby("sequence_id").window.first().sort_index()
    assert first.is_monotonic_increasing
