"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import embed_lsh, langid, lexical, licenses, line_dedup, merkle, minhash, mixing, packing, quality, secret_scan, toxicity, warc


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = F.when(F.col("digest_matches"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record is not what was written")))
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = secret_scan.SecretParameters()
    trees = secret_scan.default_forest(spark, p)
    found = secret_scan.findings(_table(spark, sf_dir, "documents"), trees, p)
    return found.selectExpr("doc_id", "finding", "word", "sha2(cast(value as binary), 256) as value_sha256", *secret_scan.FEATURES, "score", "is_secret")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file(), 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.MinHashParameters(shingle_words=4))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_lsh.near_embeddings(_table(spark, sf_dir, "embeddings"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc, op2_secret_scan, op3_packing, op4_quality_rules, op5_toxicity, op6_language_id, op7_mixing, op8_license_scan, op9_minhash, op10_embedding_dedup, op11_line_dedup, op12_merkle_manifest, op13_lexical_search)
    return {f.__name__: f for f in own}


#: DuckDB SQL; the other operators have no SQL form and are tested against brute force.
ORACLE = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM f""",
    "op9_minhash": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM t),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        e AS (SELECT doc_id, unnest(s) AS g FROM s),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, sym.b FROM r JOIN sym ON sym.a = r.c),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)""",
    "op10_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        k AS (SELECT a, count(*) AS n FROM l GROUP BY a),
        r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c),
        m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
        SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.component_id, v.vec_id = m.component_id AS kept
        FROM v JOIN m USING (vec_id) LEFT JOIN k ON k.a = v.vec_id""",
    "op11_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        x AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
        k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
        f AS (SELECT key AS often FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(often) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN f ON key = often GROUP BY r, doc_id""",
    "op12_merkle_manifest": r"""
        WITH RECURSIVE crc AS (
            SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) AS c FROM documents),
        t AS (SELECT *, CASE WHEN xor(c, 4294967295::UBIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS text2 FROM crc),
        f AS (SELECT doc_id, source, text, text2, concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
              coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS h FROM t),
        l AS (SELECT doc_id, source, sha256(h || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(h || coalesce(strlen(text2) || ':' || text2, '-')) AS changed FROM f),
        n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS k FROM l),
        g AS (SELECT source, 0 AS level, list(leaf ORDER BY k) AS d FROM n GROUP BY source
              UNION ALL SELECT source, level + 1, list_transform(range(0, (len(d) + 2) // 3), lambda i: sha256(array_to_string(d[3 * i + 1:3 * i + 3], ''))) FROM g WHERE len(d) > 1),
        s AS (SELECT source, d[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k FROM g WHERE len(d) = 1),
        u AS (SELECT 0 AS level, list(subroot ORDER BY k) AS d FROM s
              UNION ALL SELECT level + 1, list_transform(range(0, (len(d) + 2) // 3), lambda i: sha256(array_to_string(d[3 * i + 1:3 * i + 3], ''))) FROM u WHERE len(d) > 1),
        up AS (SELECT doc_id, source, leaf, k AS place, 0 AS level, changed AS acc, '' AS proof FROM n
               UNION ALL SELECT up.doc_id, up.source, leaf, place // 3, up.level + 1,
                   sha256(array_to_string(d[3 * (place // 3) + 1:place], '') || acc || array_to_string(d[place + 2:3 * (place // 3) + 3], '')),
                   proof || array_to_string(d[3 * (place // 3) + 1:place], '') || array_to_string(d[place + 2:3 * (place // 3) + 3], '')
               FROM up JOIN g ON g.source IS NOT DISTINCT FROM up.source AND g.level = up.level AND len(d) > 1),
        top AS (SELECT up.doc_id, up.source, leaf, acc, proof FROM up JOIN g ON g.source IS NOT DISTINCT FROM up.source AND g.level = up.level AND len(d) = 1),
        up2 AS (SELECT top.doc_id, leaf, subroot, k AS place, 0 AS level, acc, proof FROM top JOIN s ON s.source IS NOT DISTINCT FROM top.source
               UNION ALL SELECT doc_id, leaf, subroot, place // 3, up2.level + 1,
                   sha256(array_to_string(d[3 * (place // 3) + 1:place], '') || acc || array_to_string(d[place + 2:3 * (place // 3) + 3], '')),
                   proof || array_to_string(d[3 * (place // 3) + 1:place], '') || array_to_string(d[place + 2:3 * (place // 3) + 3], '')
               FROM up2 JOIN u ON u.level = up2.level AND len(d) > 1)
        SELECT doc_id, leaf, subroot, d[1] AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = d[1] AS verified
        FROM up2 JOIN u ON u.level = up2.level AND len(d) = 1""",
    "op13_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        n AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
        s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM n),
        tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
        df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
        b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
        q AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM b) GROUP BY ALL),
        x AS (SELECT q, item_id, tf.r, sum(times * floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
                * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))))::BIGINT AS score
              FROM q JOIN df USING (t) JOIN tf USING (t) JOIN n ON n.r = tf.r CROSS JOIN s GROUP BY ALL),
        k AS (SELECT item_id, n.doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, n.doc_id) AS rank FROM x JOIN n ON n.r = x.r WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20""",
}
