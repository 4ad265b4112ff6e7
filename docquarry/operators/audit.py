"""Claims against their evidence, and the numbering of citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def claim_audit(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, status, reason): the first failing rule decides.

    ``claims`` (claim_id, citation_ids), ``citations`` (citation_id, snapshot_id, locator, quote), ``evidence`` (snapshot_id,
    locator, text). Unknown ids come first, then a claim without citations, then each citation in order: its snapshot
    is not in evidence, its locator was not retrieved, its quote is not in the text.
    """
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    used = claims.select("claim_id", F.posexplode("citation_ids").alias("position", "citation_id"))
    known = evidence.select(F.col("snapshot_id").alias("_s")).distinct()
    texts = evidence.select(F.col("snapshot_id").alias("_s2"), F.col("locator").alias("_l2"), flat(F.col("text")).alias("_text"))
    joined = used.join(citations, "citation_id", "left").join(known, F.col("snapshot_id") == F.col("_s"), "left").join(texts, (F.col("snapshot_id") == F.col("_s2")) & (F.col("locator") == F.col("_l2")), "left")
    fault = (
        F.when(F.col("snapshot_id").isNull(), "unknown_citation")
        .when(F.col("_s").isNull(), "off_snapshot")
        .when(F.col("_text").isNull(), "not_retrieved")
        .when((F.coalesce("quote", F.lit("")) != "") & ~F.contains("_text", flat(F.col("quote"))), "quote_absent")
    )
    order = F.when(fault == "unknown_citation", F.col("position") - 1_000_000).otherwise(F.col("position"))
    found = joined.groupBy("claim_id").agg(F.min_by(fault, F.when(fault.isNotNull(), order)).alias("fault"))
    out = claims.select("claim_id", F.size("citation_ids").alias("n")).join(found, "claim_id", "left")
    reason = F.when(F.col("n") <= 0, "missing_citation").otherwise(F.col("fault"))
    return out.select("claim_id", F.when(reason.isNull(), "verified").otherwise("unsupported").alias("status"), F.coalesce(reason, F.lit("")).alias("reason"))


def renumber(uses: DataFrame, by: str = "document") -> DataFrame:
    """(by, seq, number): uses of (by, seq, snapshot_id, locator) get c1, c2, ... by first appearance of their place; ties by its name."""
    first = uses.groupBy(by, "snapshot_id", "locator").agg(F.min("seq").alias("_first"))
    ranked = first.withColumn("number", F.concat(F.lit("c"), F.row_number().over(Window.partitionBy(by).orderBy("_first", "snapshot_id", "locator")).cast("string")))
    return uses.join(ranked, [by, "snapshot_id", "locator"]).select(by, "seq", "number")
