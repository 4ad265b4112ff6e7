"""Queries on assembled documents, JSON documents and parts of files; driver tables stand for chapters, facts and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import documents as d
from docquarry.operators import assembly as a
from docquarry.operators import search
from docquarry.sources.tables import table

_FACTS = "SELECT concat('ch', p_partkey % 40) AS chapter, concat('f', p_partkey % 300) AS fact_id, CASE WHEN p_partkey % 3 = 0 THEN 'fact' ELSE 'opinion' END AS kind, p_name AS statement, concat('e', p_size) AS cited FROM part"
_BLOCKS = "SELECT concat('ch', o_orderkey % 40) AS chapter, o_orderkey AS position, CASE WHEN o_orderkey % 3 = 0 THEN 'code' ELSE 'markdown' END AS type, concat('call(', o_custkey, ')', chr(10), 'end') AS code, o_orderkey % 5 = 0 AS illustrative, concat('e', o_custkey % 50) AS cited FROM orders"
_VERDICTS = "SELECT CASE WHEN c_custkey % 2 = 0 THEN concat('f', c_custkey % 290) ELSE concat('ch', c_custkey % 40, ':f', c_custkey % 300) END AS key, CASE WHEN c_custkey % 7 < 4 THEN 'supported' ELSE 'unsupported' END AS verdict FROM customer"
_PROSE = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'code' ELSE 'markdown' END AS type, text AS markdown FROM documents"
_TERMS = [("the", "THE"), ("de", "$1 of\\"), ("a+b", "x"), ("las", "los")]
_GLOSSARY = "SELECT p_partkey AS term, concat('e', p_size) AS c1, concat('e', p_partkey % 97) AS c2 FROM part"
_KNOWN = "SELECT DISTINCT concat('e', p_size) AS citation_id FROM part WHERE p_size % 4 <> 0"
_PROPOSED = "SELECT concat('s', c_custkey) AS slug, c_name AS title FROM customer WHERE c_custkey % 10 <> 3"
_CHOSEN = "SELECT concat('s', c_custkey) AS slug, c_custkey * 7 % 1000 AS position, c_custkey % 4 = 0 AS named FROM customer WHERE c_custkey % 3 = 0"
_CITED = "SELECT l_suppkey AS document, l_linenumber AS chapter, l_orderkey AS seq, concat('e', l_partkey % 20) AS citation_id, concat('s', l_partkey % 3) AS snapshot_id, concat('l', l_partkey % 11) AS locator FROM lineitem"
_USED = "SELECT o_custkey % 100 AS document, CAST(o_orderkey % 7 AS INT) AS chapter, o_orderkey AS seq, concat('e', o_orderkey % 25) AS citation_id FROM orders"
_CHAPTERS = "SELECT o_custkey AS document, concat('s', o_orderkey % 90) AS slug, o_orderkey % 4 AS ordinal, o_orderkey % 4 + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS position FROM orders"
_WRITES = "SELECT l_suppkey AS run, concat('d', l_partkey % 30) AS slug, l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS drawn, CAST(l_quantity AS INT) - 10 AS attempt FROM lineitem"
_JSON = """concat('{"z": ', event_id, ', "props": ', props, ', "a": ["', event_type, '", null, true], "ü": "', user_id, '"}')"""
_REPLY = f"""CASE CAST(event_id % 6 AS INT) WHEN 0 THEN {_JSON} WHEN 1 THEN concat('```json', chr(10), {_JSON}, chr(10), '```') WHEN 2 THEN concat('Sure: ', {_JSON}, ' I hope so') WHEN 3 THEN concat('no {{ "json": ', event_id) WHEN 4 THEN concat('  ```', chr(10), {_JSON}) ELSE '' END"""
_REPORT = """concat('{"root": "r', p_partkey, '", "extra": 1, "files": [{"path": "a.ts", "bytes": ', p_size, '}, {"path": "b.ts", "bytes": 5}], "symbols": [{"id": "s', p_partkey, '", "name": "', p_brand, '", "kind": "class", "exported": true, "file": "a.ts"}, {"id": "t", "qualifiedName": "q.', p_type, '", "isAsync": ',
    CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END, '}], "callEdges": [{"id": "e", "resolution": "', CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'resolved' WHEN 1 THEN 'external' ELSE 'unresolved' END, '"}]}')"""
_FILE = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN concat('version https://git-lfs.github.com/spec/v1', chr(10), 'oid sha256:', doc_id) WHEN 1 THEN concat(text, text, text, text) ELSE text END"
_HEADINGS = "SELECT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS ordinal, concat(l_returnflag, '  -_', l_linestatus, '!') AS heading FROM lineitem"


def _sql(spark, sf_dir, sql):
    name = sql.split(" FROM ")[1].split()[0]
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}", 1), source=table(spark, sf_dir, name))


def _claims(spark, sf_dir):
    ids = lambda df: df.withColumn("citation_ids", F.array("cited"))
    claims = a.document_claims(ids(_sql(spark, sf_dir, _FACTS)), ids(_sql(spark, sf_dir, _BLOCKS)))
    return a.with_verdicts(claims, _sql(spark, sf_dir, _VERDICTS)).select("chapter", "claim_id", "kind", "statement", F.array_join("citation_ids", ",").alias("citations"), "verdict")


def _revised(spark, sf_dir):
    return a.revised_blocks(_sql(spark, sf_dir, _PROSE), _TERMS).select("doc_id", F.sha2(F.col("markdown").cast("binary"), 256).alias("digest"))


def _dropped(spark, sf_dir):
    facts = _sql(spark, sf_dir, _FACTS)
    return a.revised_facts(facts, facts.where("kind = 'opinion'").select("fact_id")).select("chapter", "fact_id", "statement")


def _glossary(spark, sf_dir):
    return a.revised_glossary(_sql(spark, sf_dir, _GLOSSARY).select("term", F.array("c1", "c2").alias("citation_ids")), _sql(spark, sf_dir, _KNOWN))


def _outline(spark, sf_dir):
    chosen = _sql(spark, sf_dir, _CHOSEN)
    titles = chosen.where("named").select("slug", F.concat(F.lit("New "), "slug").alias("new_title"))
    return a.outline_decision(_sql(spark, sf_dir, _PROPOSED), chosen.drop("named"), titles).select("slug", "position", F.coalesce("title", F.lit("")).alias("title"), "known")


def _violations(spark, sf_dir):
    cited = _sql(spark, sf_dir, _CITED).select(F.col("document"), F.concat("citation_id", F.lit("-"), "seq").alias("citation_id"), "snapshot_id")
    approved = _sql(spark, sf_dir, _CITED).where("snapshot_id <> 's2'").select("document", "snapshot_id")
    used = _sql(spark, sf_dir, _USED).select("document", F.concat("citation_id", F.lit("-"), "seq").alias("citation_id"))
    return a.violations(_sql(spark, sf_dir, _CHAPTERS), cited, approved, used)


def _reply(spark, sf_dir):
    found = table(spark, sf_dir, "events").select("event_id", d.reply_json(F.expr(_REPLY)).alias("j"))
    return found.select("event_id", F.col("j").isNotNull().alias("ok"), F.coalesce(F.get_json_object("j", "$.z"), F.lit("")).alias("z"), F.coalesce(F.get_json_object("j", "$.props.k"), F.lit("")).alias("k"))


def _pins(spark, sf_dir):
    kind, repo = F.when(F.col("page_id") % 3 == 0, "web").otherwise("repository"), F.when(F.col("page_id") % 4 != 1, "own/er")
    locator = F.when(F.col("page_id") % 6 == 3, F.lit("//src/a.py#L1")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(d.pinned_locator(kind, locator, repo, F.lit("abc")), F.lit("")).alias("pinned"))


def _pack_queries(spark, sf_dir):
    requests = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chapter"), F.col("p_name").alias("title"), F.array("p_type", F.lit(" "), "p_brand").alias("questions"), F.when(F.col("p_partkey") % 3 == 0, F.array("p_brand", F.lit(""))).otherwise(F.array().cast("array<string>")).alias("symbols"))
    return search.pack_queries(requests, "chapter")


_ITEMS = "SELECT l_suppkey AS chapter, concat('l', l_partkey % 17) AS locator, l_orderkey * 10 + l_linenumber AS seq, CAST(l_quantity AS DOUBLE) AS score, concat('r', l_linenumber) AS reason FROM lineitem"


QUERIES = {
    "document_audit": _claims,
    "terminology_rewrite": _revised,
    "fact_revision": _dropped,
    "glossary_revision": _glossary,
    "outline_decision": _outline,
    "reference_remap": lambda spark, sf_dir: a.remapped(_sql(spark, sf_dir, _USED), _sql(spark, sf_dir, _CITED)),
    "schema_violations": _violations,
    "diagram_overlay": lambda spark, sf_dir: a.overlaid(_sql(spark, sf_dir, _WRITES), ["run", "slug"]).select("run", "slug", "seq", F.date_format("drawn", "yyyy-MM-dd").alias("drawn")),
    "attempts_merge": lambda spark, sf_dir: a.merged_attempts(_sql(spark, sf_dir, _WRITES), ["run", "slug"]),
    "sanitisation_tally": lambda spark, sf_dir: a.tally(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]),
    "confidence_score": lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", F.coalesce(a.confidence_score(F.expr("CASE event_type WHEN 'view' THEN 'high' WHEN 'click' THEN 'medium' WHEN 'error' THEN 'low' ELSE event_type END")), F.lit(-1)).cast("double").alias("confidence")),
    "content_digest": lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", d.content_digest(F.expr(_JSON)).alias("digest")),
    "input_digest": lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", d.input_digest(user=F.col("user_id"), kind=F.col("event_type"), event=F.col("event_id")).alias("digest")),
    "reply_json": _reply,
    "report_symbols": lambda spark, sf_dir: d.report_symbols(table(spark, sf_dir, "part").select("p_partkey", F.expr(_REPORT).alias("j")), "p_partkey", "j"),
    "report_stats": lambda spark, sf_dir: d.report_stats(table(spark, sf_dir, "part").select("p_partkey", F.expr(_REPORT).alias("j")), "p_partkey", "j"),
    "fence_neutralise": lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.sha2(d.fenced(F.concat(F.lit("x<<<EVIDENCE>>>"), "text"), "<<<EVIDENCE>>>").cast("binary"), 256).alias("digest")),
    "offset_lines": lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", d.line_of(F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")).alias("line")),
    "heading_anchors": lambda spark, sf_dir: d.anchors(_sql(spark, sf_dir, _HEADINGS), "doc_id", "ordinal", "heading").drop("heading"),
    "content_rules": lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.coalesce(d.content_reason(F.expr(_FILE), 60_000), F.lit("")).alias("reason")),
    "locator_pins": _pins,
    "pack_queries": _pack_queries,
    "evidence_reasons": lambda spark, sf_dir: search.best_with_reasons(_sql(spark, sf_dir, _ITEMS), ["chapter"]).select("chapter", "locator", "seq", "score", F.array_join("reasons", ",").alias("reasons")),
}


def _rewrites(text: str) -> str:
    """DuckDB SQL: the terms of ``_TERMS`` as whole words, as RE2 knows word borders of ASCII only."""
    for term, form in _TERMS:
        literal = "".join("\\" + c if not c.isalnum() else c for c in term)
        edge = r"[^\p{L}\p{N}_]"
        into = form.replace("\\", "\\\\")
        for _ in range(2):  # neighbours share their border
            text = f"regexp_replace({text}, '(^|{edge}){literal}($|{edge})', '\\1{into}\\2', 'g')"
    return text


ORACLE = {
    "document_audit": f"""
        WITH f AS ({_FACTS}), b AS ({_BLOCKS}), v AS (SELECT key, max(verdict) AS verdict FROM ({_VERDICTS}) GROUP BY key),
        c AS (SELECT chapter, fact_id AS claim_id, kind, statement, cited FROM f UNION ALL SELECT chapter, chapter || ':code:' || position, 'api_signature', split_part(code, chr(10), 1), cited FROM b WHERE type = 'code' AND NOT illustrative)
        SELECT chapter, claim_id, kind, statement, cited AS citations, coalesce(x.verdict, y.verdict, 'not_checked') AS verdict FROM c LEFT JOIN v x ON x.key = chapter || ':' || claim_id LEFT JOIN v y ON y.key = claim_id""",
    "terminology_rewrite": f"SELECT doc_id, sha256(CASE WHEN type = 'markdown' THEN {_rewrites('markdown')} ELSE markdown END) AS digest FROM ({_PROSE})",
    "fact_revision": f"WITH f AS ({_FACTS}) SELECT chapter, fact_id, statement FROM f WHERE fact_id NOT IN (SELECT fact_id FROM f WHERE kind = 'opinion')",
    "glossary_revision": f"""
        WITH g AS ({_GLOSSARY}), k AS ({_KNOWN})
        SELECT term, CASE WHEN c1 IN (FROM k) THEN '' ELSE c1 END || CASE WHEN c1 IN (FROM k) OR c2 IN (FROM k) THEN '' ELSE ', ' END || CASE WHEN c2 IN (FROM k) THEN '' ELSE c2 END AS unknown FROM g""",
    "outline_decision": f"""
        WITH p AS ({_PROPOSED}), c AS ({_CHOSEN})
        SELECT c.slug, position, CASE WHEN p.slug IS NULL THEN '' WHEN named THEN 'New ' || c.slug ELSE title END AS title, p.slug IS NOT NULL AS known FROM c LEFT JOIN p USING (slug)""",
    "reference_remap": f"""
        WITH c AS ({_CITED}), u AS ({_USED}), o AS (SELECT document, snapshot_id, locator, min(chapter * 1000000000000 + seq) AS first FROM c GROUP BY ALL),
        n AS (SELECT *, 'c' || row_number() OVER (PARTITION BY document ORDER BY first, snapshot_id, locator) AS number FROM o),
        m AS (SELECT c.document, chapter, citation_id, number FROM c JOIN n USING (document, snapshot_id, locator) QUALIFY row_number() OVER (PARTITION BY c.document, chapter, citation_id ORDER BY seq DESC, snapshot_id DESC, locator DESC) = 1)
        SELECT document, chapter, u.seq, number FROM u JOIN m USING (document, chapter, citation_id)""",
    "schema_violations": f"""
        WITH c AS (SELECT document, citation_id || '-' || seq AS citation_id, snapshot_id FROM ({_CITED})), k AS (SELECT DISTINCT document, snapshot_id FROM c WHERE snapshot_id <> 's2'),
        u AS (SELECT DISTINCT document, citation_id || '-' || seq AS citation_id FROM ({_USED})), h AS ({_CHAPTERS})
        SELECT document, 'duplicate_citation' AS rule, citation_id AS detail FROM c GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT document, 'duplicate_chapter', slug FROM h GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT document, 'ordinal', slug FROM h WHERE ordinal <> position
        UNION ALL SELECT DISTINCT document, 'unapproved_snapshot', citation_id FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.document = c.document AND k.snapshot_id = c.snapshot_id)
        UNION ALL SELECT document, 'unknown_citation', citation_id FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.document = u.document AND c.citation_id = u.citation_id)""",
    "diagram_overlay": f"SELECT run, slug, seq, strftime(drawn, '%Y-%m-%d') AS drawn FROM ({_WRITES}) QUALIFY row_number() OVER (PARTITION BY run, slug ORDER BY seq DESC, drawn DESC) = 1",
    "attempts_merge": f"SELECT run, slug, greatest(max(attempt), 0) AS attempt FROM ({_WRITES}) GROUP BY run, slug",
    "sanitisation_tally": "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL",
    "confidence_score": "SELECT event_id, CASE event_type WHEN 'view' THEN 0.95 WHEN 'click' THEN 0.6 WHEN 'error' THEN 0.2 ELSE -1 END::DOUBLE AS confidence FROM events",
    "content_digest": """SELECT event_id, sha256('{"a":["' || event_type || '",null,true],"props":' || replace(props, ' ', '') || ',"z":' || event_id || ',"ü":"' || user_id || '"}') AS digest FROM events""",
    "input_digest": """SELECT event_id, sha256('{"event":' || event_id || ',"kind":"' || event_type || '","user":' || user_id || '}') AS digest FROM events""",
    "reply_json": "SELECT event_id, event_id % 6 IN (0, 1, 2, 4) AS ok, CASE WHEN event_id % 6 IN (0, 1, 2, 4) THEN event_id::VARCHAR ELSE '' END AS z, CASE WHEN event_id % 6 IN (0, 1, 2, 4) THEN json_extract_string(props, '$.k') ELSE '' END AS k FROM events",
    "report_symbols": """
        SELECT p_partkey, 0 AS position, 's' || p_partkey AS id, p_brand AS name, '' AS qualified_name, 'class' AS kind, 'a.ts' AS file, true AS exported, false AS is_async FROM part
        UNION ALL SELECT p_partkey, 1, 't', '', 'q.' || p_type, 'variable', '', false, p_partkey % 2 = 0 FROM part""",
    "report_stats": "SELECT p_partkey, 2 AS files, (p_size + 5)::BIGINT AS total_bytes, 2 AS symbols, 1 AS calls, (p_partkey % 3 = 0)::INT AS resolved, (p_partkey % 3 = 1)::INT AS external, (p_partkey % 3 = 2)::INT AS unresolved FROM part",
    "fence_neutralise": "SELECT doc_id, sha256(replace('x<<<EVIDENCE>>>' || text, '<<<EVIDENCE>>>', '<evidence-delimiter-removed>')) AS digest FROM documents",
    "offset_lines": "SELECT doc_id, len(string_split(substring(coalesce(text, ''), 1, length(coalesce(text, '')) // 2), chr(10)))::INT AS line FROM documents",
    "heading_anchors": f"""
        WITH h AS (SELECT *, CASE WHEN b = '' THEN 'section' ELSE b END AS base FROM (SELECT *, lower(heading[1:1]) || '-' || lower(heading[6:6]) AS b FROM ({_HEADINGS})))
        SELECT doc_id, ordinal, base || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || row_number() OVER w END AS anchor FROM h WINDOW w AS (PARTITION BY doc_id, base ORDER BY ordinal)""",
    "content_rules": f"SELECT doc_id, CASE WHEN starts_with(f, 'version https://git-lfs.github.com/spec/v1') AND contains(f, chr(10) || 'oid ') THEN 'git_lfs' WHEN octet_length(encode(f)) > 60000 THEN 'too_large' ELSE '' END AS reason FROM (SELECT doc_id, {_FILE} AS f FROM documents)",
    "locator_pins": """
        WITH p AS (SELECT page_id, CASE WHEN page_id % 6 = 3 THEN '//src/a.py#L1' ELSE url END AS l FROM pages)
        SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CASE WHEN starts_with(l, 'http://') OR starts_with(l, 'https://') THEN l ELSE '' END WHEN page_id % 4 <> 1 THEN 'own/er@abc/' || ltrim(l, '/') ELSE '' END AS pinned FROM p""",
    "pack_queries": """
        SELECT p_partkey AS chapter, 0 AS position, p_name AS text, 'all' AS kinds FROM part UNION ALL SELECT p_partkey, 1, p_type, 'all' FROM part UNION ALL SELECT p_partkey, 3, p_brand, 'all' FROM part
        UNION ALL SELECT p_partkey, 4, p_brand, 'code_symbol' FROM part WHERE p_partkey % 3 = 0""",
    "evidence_reasons": f"""
        WITH i AS ({_ITEMS}), b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY chapter, locator ORDER BY score DESC, seq) = 1), f AS (SELECT chapter, locator, reason, min(seq) AS first FROM i GROUP BY ALL),
        r AS (SELECT chapter, locator, string_agg(reason, ',' ORDER BY first) AS reasons FROM f GROUP BY ALL)
        SELECT chapter, locator, seq, score, reasons FROM b JOIN r USING (chapter, locator)""",
}
