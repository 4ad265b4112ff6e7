"""Documents assembled from chapters: claims, verdicts, revisions, outlines, references, invariants and merged states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A qualitative confidence as a number.
CONFIDENCE = {"high": "0.950", "medium": "0.600", "low": "0.200"}


def document_claims(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chapter, claim_id, kind, statement, citation_ids): every fact, and every code block that is not illustrative.

    ``facts`` (chapter, fact_id, kind, statement, citation_ids), ``blocks`` (chapter, position, type, code, illustrative,
    citation_ids). A block's claim is named by its chapter and position; its statement is the code's first line.
    """
    code = blocks.where("type = 'code' and not illustrative").select(
        "chapter",
        F.concat("chapter", F.lit(":code:"), F.col("position").cast("string")).alias("claim_id"),
        F.lit("api_signature").alias("kind"),
        F.substring_index("code", "\n", 1).alias("statement"),
        "citation_ids",
    )
    return facts.select("chapter", F.col("fact_id").alias("claim_id"), "kind", "statement", "citation_ids").unionByName(code)


def with_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds verdict: that of ``chapter:claim_id``, else of the bare claim_id, else not_checked; ``verdicts`` (key, verdict)."""
    own = verdicts.groupBy("key").agg(F.max("verdict").alias("verdict"))
    full = own.select(F.col("key").alias("_k1"), F.col("verdict").alias("_v1"))
    bare = own.select(F.col("key").alias("_k2"), F.col("verdict").alias("_v2"))
    joined = claims.join(full, F.concat("chapter", F.lit(":"), "claim_id") == F.col("_k1"), "left").join(bare, F.col("claim_id") == F.col("_k2"), "left")
    return joined.withColumn("verdict", F.coalesce("_v1", "_v2", F.lit("not_checked"))).drop("_k1", "_k2", "_v1", "_v2")


def rewritten(text: Column, terms: list[tuple[str, str]]) -> Column:
    """``text`` with each whole-word term replaced by its canonical form, in the order of ``terms``."""
    for term, form in terms:
        if term:
            literal = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in term)
            text = F.regexp_replace(text, rf"(?U)\b{literal}\b", form.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def revised_blocks(blocks: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """Blocks with terms rewritten in prose; code keeps matching the source that it cites."""
    return blocks.withColumn("markdown", F.when(F.col("type") == "markdown", rewritten(F.col("markdown"), terms)).otherwise(F.col("markdown")))


def revised_facts(facts: DataFrame, dropped: DataFrame) -> DataFrame:
    """Facts but those whose id is in ``dropped`` (fact_id)."""
    return facts.join(dropped.select("fact_id").distinct(), "fact_id", "left_anti")


def revised_glossary(terms: DataFrame, citations: DataFrame) -> DataFrame:
    """(term, unknown): cited ids of each term that ``citations`` (citation_id) lacks, in order; a term with any is refused."""
    each = terms.select("term", F.posexplode_outer("citation_ids").alias("_at", "_c"))
    known = citations.select(F.col("citation_id").alias("_k")).distinct()
    judged = each.join(known, F.col("_c") == F.col("_k"), "left")
    bad = F.when(F.col("_c").isNotNull() & F.col("_k").isNull(), F.struct("_at", "_c"))
    return judged.groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(bad)), lambda x: x["_c"]), ", ").alias("unknown"))


def outline_decision(proposed: DataFrame, chosen: DataFrame, titles: DataFrame) -> DataFrame:
    """(slug, position, title, known): the chapters a reviewer chose, in their order, with new titles where given.

    ``proposed`` (slug, title), ``chosen`` (slug, position), ``titles`` (slug, new_title). A slug that nobody proposed comes
    back unknown, so that the caller may refuse the decision.
    """
    names = proposed.select(F.col("slug").alias("_p"), "title")
    joined = chosen.join(names, F.col("slug") == F.col("_p"), "left").join(titles, "slug", "left")
    known = F.col("_p").isNotNull()
    return joined.select("slug", "position", F.when(known, F.coalesce("new_title", "title")).alias("title"), known.alias("known"))


def remapped(references: DataFrame, citations: DataFrame, by: str = "document") -> DataFrame:
    """(by, chapter, seq, number): references by a chapter's own citation ids under the document's numbers.

    ``citations`` (by, chapter, seq, citation_id, snapshot_id, locator) in reading order (chapter, seq); the same place gets one
    number however many chapters cite it, and ties go by its name. References to ids that the chapter lacks are left out.
    """
    place = [by, "snapshot_id", "locator"]
    first = citations.groupBy(*place).agg(F.min(F.struct("chapter", "seq")).alias("_first"))
    numbered = first.withColumn("number", F.concat(F.lit("c"), F.row_number().over(Window.partitionBy(by).orderBy("_first", "snapshot_id", "locator")).cast("string")))
    names = citations.join(numbered, place).groupBy(by, "chapter", "citation_id").agg(F.max_by("number", F.struct("seq", "snapshot_id", "locator")).alias("number"))
    return references.join(names, [by, "chapter", "citation_id"]).select(by, "chapter", "seq", "number")


def violations(chapters: DataFrame, citations: DataFrame, approved: DataFrame, references: DataFrame, by: str = "document") -> DataFrame:
    """(by, rule, detail) of each broken invariant of a document.

    ``chapters`` (by, slug, ordinal, position), ``citations`` (by, citation_id, snapshot_id), ``approved`` (by, snapshot_id),
    ``references`` (by, citation_id): slugs and citation ids are unique, ordinals are positions, snapshots approved and ids known.
    """
    twice = lambda df, column, rule: df.groupBy(by, column).count().where("count > 1").select(by, F.lit(rule).alias("rule"), F.col(column).cast("string").alias("detail"))
    out = twice(citations, "citation_id", "duplicate_citation").unionByName(twice(chapters, "slug", "duplicate_chapter"))
    out = out.unionByName(chapters.where("ordinal <> position").select(by, F.lit("ordinal").alias("rule"), F.col("slug").alias("detail")))
    off = citations.join(approved.distinct(), [by, "snapshot_id"], "left_anti")
    out = out.unionByName(off.select(by, F.lit("unapproved_snapshot").alias("rule"), F.col("citation_id").cast("string").alias("detail")).distinct())
    lost = references.select(by, "citation_id").distinct().join(citations, [by, "citation_id"], "left_anti")
    return out.unionByName(lost.select(by, F.lit("unknown_citation").alias("rule"), F.col("citation_id").cast("string").alias("detail")))


def overlaid(writes: DataFrame, by: list[str]) -> DataFrame:
    """The last write (seq) of each key; of writes with one seq the largest."""
    others = ["seq", *(c for c in writes.columns if c not in (*by, "seq"))]
    return writes.groupBy(*by).agg(F.max(F.struct(*others)).alias("_r")).select(*by, "_r.*")


def merged_attempts(counts: DataFrame, by: list[str]) -> DataFrame:
    """The highest attempt of each key, so that a replay can't reset it."""
    return counts.groupBy(*by).agg(F.greatest(F.max("attempt"), F.lit(0)).alias("attempt"))


def tally(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts by key, such as what a sanitiser removed and why."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def confidence_score(confidence: Column) -> Column:
    """high, medium and low as decimal(4,3); null for others."""
    out = F.lit(None).cast("decimal(4,3)")
    for name, value in CONFIDENCE.items():
        out = F.when(confidence == name, F.lit(value).cast("decimal(4,3)")).otherwise(out)
    return out
