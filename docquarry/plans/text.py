"""Queries on text: terms, excerpts, fences, markers, slugs and line windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import text as t
from docquarry.operators import chunks
from docquarry.sources.tables import table


def _shingles(spark, sf_dir):
    grams = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(t.word_bigrams(F.coalesce("text", F.lit("")))).alias("g"))
    return grams.select("doc_id", F.size("g").alias("n_shingles"), F.sha2(F.array_join("g", "|").cast("binary"), 256).alias("digest"))


def _bottomk(spark, sf_dir):
    grams = table(spark, sf_dir, "documents").select("doc_id", t.word_bigrams(F.coalesce("text", F.lit(""))).alias("g"))
    hashed = grams.select("doc_id", F.slice(F.array_sort(F.transform("g", lambda s: F.substring(F.sha2(s.cast("binary"), 256), 1, 16))), 1, 256).alias("k"))
    return hashed.select("doc_id", F.size("k").alias("n"), F.array_min("k").alias("lowest"), F.sha2(F.array_join("k", "").cast("binary"), 256).alias("sketch"))


def _terms(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select("item_id", t.query_terms(F.coalesce("text", F.lit(""))).alias("terms"))
    return own.select("item_id", F.size("terms").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


def _excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.excerpt(F.coalesce("text", F.lit(""))).alias("excerpt"))


#: A documents row out of seven gets a fence or a marker, which the table itself lacks.
_MARKED = "CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN concat(text, ' ```code') WHEN 1 THEN concat('```', text, '```') WHEN 2 THEN concat(text, ' API_KEY = 1 sk-x') WHEN 3 THEN concat('-----begin ', text) ELSE text END"


def _marked(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MARKED} AS text")


def _fences(spark, sf_dir):
    n = t.fence_count(F.col("text"))
    return _marked(spark, sf_dir).select("doc_id", n.alias("fences"), (n % 2 == 1).alias("unclosed"))


def _secrets(spark, sf_dir):
    found = _marked(spark, sf_dir).select("doc_id", t.secret_markers(F.col("text")).alias("m"))
    return found.where(F.size("m") > 0).select("doc_id", F.size("m").cast("int").alias("n_markers"), F.array_join("m", ",").alias("markers"))


def _slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.slug(F.col("text")).alias("slug"))


#: Documents as Markdown: first words as heading, a list and emphasis.
_MARKDOWN = "concat('## ', substring(text, 1, 20), chr(10), '- one [link](http://x.example/a) *two*', chr(10), '```', chr(10), text, chr(10), '```', chr(10), '**end** ')"
#: With a numbered list, an image and other line ends.
_NUMBERED = _MARKDOWN[:-1] + ", chr(13), chr(10), ' 1. first ![alt](x.png) _', lang, '_', chr(13), '23. second ', chr(12), '~~~ ', source, chr(11), '   ### third ***', lang, chr(9), chr(10), '1.none')"


def _markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_NUMBERED} AS md").select("doc_id", F.sha2(t.markdown_to_text(F.col("md")).cast("binary"), 256).alias("digest"), F.length(t.markdown_to_text(F.col("md"))).alias("n_chars"))


def _lines(spark, sf_dir):
    return chunks.line_windows(table(spark, sf_dir, "documents"), 3)


#: Sections in order: before the first heading, with a fence that holds a whole text, twice the same, below it, and a bare heading.
_PARTS = ["concat('intro ', doc_id, chr(10), chr(10))", "concat('# Title ', lang, chr(10), '```', chr(10), text, chr(10), '```', chr(10))", "concat('## Same', chr(10), 'x y ', doc_id, chr(10))", "concat('## Same ##', chr(10))", "concat('### Deep ', source, chr(10), '~~~', chr(10), '# no heading', chr(10), '~~~', chr(10))", "concat('# Last', chr(10))"]
_BOOK = f"concat({', '.join(_PARTS)})"
_FILES = f"SELECT doc_id, concat('d/', doc_id, CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.MD' END) AS path, CASE WHEN doc_id % 3 = 0 THEN text ELSE {_BOOK} END AS text FROM documents WHERE text IS NOT NULL"


def _sections(spark, sf_dir):
    found = chunks.markdown_chunks(table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", f"{_BOOK} AS text"))
    return found.select("doc_id", "ordinal", "heading", "heading_path", "anchor", "char_start", "char_end", "token_count", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def _routed(spark, sf_dir):
    """Both chunkers from SQL, by path."""
    chunks.register_file_chunks(spark)
    files = spark.sql(_FILES.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return spark.sql("SELECT f.path, c.* FROM {files} f, LATERAL file_chunks(f.path, f.text, false) c", files=files)


QUERIES = {
    "chunk_markdown": _sections,
    "chunk_files": _routed,
    "shingles": _shingles,
    "minhash_bottomk": _bottomk,
    "query_terms": _terms,
    "excerpt": _excerpt,
    "fence_balance": _fences,
    "secret_scan": _secrets,
    "slugify": _slugs,
    "markdown_to_text": _markdown,
    "chunk_lines": _lines,
}

_GRAMS = r"""
    w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
    g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w)"""

_SECTIONED = f"""
    p AS (SELECT doc_id, lang, source, [{', '.join(_PARTS)}] AS s FROM ({{source}})),
    x AS (SELECT doc_id, lang, source, array_to_string(s, '') AS whole, generate_subscripts(s, 1) AS i, unnest(s) AS part FROM p),
    y AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_start FROM x),
    z AS (SELECT *, (char_start + length(part) - 1)::INT AS char_end FROM y),
    t AS (SELECT doc_id, (i - 1)::INT AS ordinal, ['', 'Title ' || lang, 'Same', 'Same', 'Deep ' || source, 'Last'][i] AS heading,
          ['', 'Title ' || lang, 'Title ' || lang || ' > Same', 'Title ' || lang || ' > Same', 'Title ' || lang || ' > Same > Deep ' || source, 'Last'][i] AS heading_path,
          ['section', 'title-' || lang, 'same', 'same-2', 'deep-' || source, 'last'][i] AS anchor, char_start, char_end, trim(part, chr(10) || ' ') AS body,
          (char_start - length(replace(substring(whole, 1, char_start), chr(10), '')) + 1)::INT AS first, (char_end - 1 - length(replace(substring(whole, 1, char_end - 1), chr(10), '')) + 1)::INT AS last FROM z)"""

ORACLE = {
    "shingles": f"WITH {_GRAMS} SELECT doc_id, len(g)::INT AS n_shingles, sha256(array_to_string(list_sort(g), '|')) AS digest FROM g",
    "minhash_bottomk": f"""WITH {_GRAMS}, k AS (SELECT doc_id, list_sort(list_transform(g, lambda s: substring(sha256(s), 1, 16)))[1:256] AS k FROM g)
        SELECT doc_id, len(k)::INT AS n, list_min(k) AS lowest, sha256(array_to_string(k, '')) AS sketch FROM k""",
    "query_terms": r"""
        WITH w AS (SELECT item_id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM benchmark)),
        f AS (SELECT item_id, t, min(i) AS i FROM w WHERE length(t) >= 3 OR (length(t) = 2 AND regexp_matches(t, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]')) GROUP BY ALL)
        SELECT item_id, count(*)::INT AS n_terms, string_agg(t, ' ' ORDER BY i) AS terms FROM f GROUP BY item_id""",
    "excerpt": r"""
        WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS f FROM documents)
        SELECT doc_id, CASE WHEN length(f) <= 400 THEN f ELSE rtrim(substring(f, 1, 399)) || '…' END AS excerpt FROM f""",
    "fence_balance": f"""
        WITH m AS (SELECT doc_id, {_MARKED} AS text FROM documents), n AS (SELECT doc_id, ((length(text) - length(replace(text, '```', ''))) // 3)::INT AS fences FROM m)
        SELECT doc_id, fences, fences % 2 = 1 AS unclosed FROM n""",
    "secret_scan": f"""
        WITH m AS (SELECT doc_id, lower({_MARKED}) AS text FROM documents),
        f AS (SELECT doc_id, list_filter({list(t.SECRET_MARKERS)!r}, lambda x: contains(text, lower(x))) AS m FROM m)
        SELECT doc_id, len(m)::INT AS n_markers, array_to_string(m, ',') AS markers FROM f WHERE len(m) > 0""",
    "slugify": r"""
        WITH k AS (SELECT doc_id, regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_\s-]', '', 'g') AS k FROM documents),
        s AS (SELECT doc_id, regexp_replace(regexp_replace(k, '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM k)
        SELECT doc_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM s""",
    "markdown_to_text": rf"""
        WITH m AS (SELECT doc_id, string_split(replace(translate({_NUMBERED}, chr(11) || chr(12), chr(10) || chr(10)), chr(13) || chr(10), chr(10)), chr(13)) AS l FROM documents),
        r AS (SELECT doc_id, flatten(list_transform(l, lambda x: string_split(x, chr(10)))) AS l FROM m),
        k AS (SELECT doc_id, list_filter(l, lambda x: left(ltrim(x, ' ' || chr(9)), 3) NOT IN ('```', '~~~')) AS l FROM r),
        h AS (SELECT doc_id, list_transform(l, lambda x: regexp_replace(regexp_replace(x, '^ {{0,3}}#{{1,6}}\s+', ''), '^\s*(-|\*|\+|[0-9]+\.)\s+', '')) AS l FROM k),
        t AS (SELECT doc_id, trim(array_to_string(list_transform(l, lambda x: rtrim(translate(regexp_replace(x, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '*_`', ''), ' ' || chr(9))), chr(10)), ' ' || chr(9) || chr(10)) AS t FROM h)
        SELECT doc_id, sha256(t) AS digest, length(t)::INT AS n_chars FROM t""",
    "chunk_markdown": rf"""
        WITH {_SECTIONED.format(source="SELECT doc_id, lang, source, text FROM documents WHERE text IS NOT NULL")}
        SELECT doc_id, ordinal, heading, heading_path, anchor, char_start, char_end, len(regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+'))::INT AS token_count, sha256(body) AS sha256 FROM t""",
    "chunk_files": rf"""
        WITH {_SECTIONED.format(source="SELECT doc_id, lang, source, text FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0")},
        c AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) - ends_with(text, chr(10))::INT AS n FROM documents WHERE doc_id % 3 = 0 AND text <> ''),
        w AS (SELECT doc_id, unnest(range(0, n, 60)) AS low, l, n, text FROM c),
        b AS (SELECT doc_id, low, least(low + 60, n) AS high, array_to_string(l[low + 1:least(low + 60, n)], chr(10)) || CASE WHEN low + 60 < n OR ends_with(text, chr(10)) THEN chr(10) ELSE '' END AS body FROM w),
        k AS (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY doc_id ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS at1 FROM b)
        SELECT 'd/' || doc_id || '.MD' AS path, ordinal, 'L' || first || '-L' || last AS anchor, CASE WHEN heading_path = '' THEN 'd/' || doc_id || '.MD' ELSE heading_path END AS heading_path, char_start, char_end,
               len(regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+'))::INT AS token_count, sha256(body) AS sha256, first AS start_line, last AS end_line FROM t
        UNION ALL SELECT 'd/' || doc_id || '.py', (low // 60)::INT, 'L' || (low + 1) || '-L' || high, 'd/' || doc_id || '.py', at1, (at1 + length(body))::INT, len(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> ''))::INT, sha256(body), (low + 1)::INT, high::INT FROM k""",
    "chunk_lines": r"""
        WITH l AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line, len(l) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        g AS (SELECT doc_id, (i // 3)::INT AS ordinal, min(i) AS low, max(i) AS high, string_agg(line, chr(10) ORDER BY i) AS body, max(n) AS n FROM l GROUP BY ALL)
        SELECT doc_id, ordinal, 'L' || (low + 1) || '-L' || (high + 1) AS anchor, sha256(body) AS sha256, len(list_filter(regexp_split_to_array(trim(regexp_replace(body, '\s+', ' ', 'g')), ' '), lambda x: x <> ''))::INT AS token_count
        FROM g WHERE regexp_matches(body, '\S')""",
}
