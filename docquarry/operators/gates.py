"""Gates on assembled documents, pruning of what nothing backs, and the rendering of a document."""

from __future__ import annotations

import ast
import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from docquarry.functions.text import fence_count, secret_markers
from docquarry.operators.ordered import fold

#: Kinds of claim that need evidence, and languages whose samples can't be verified.
GROUNDED = ("fact", "api_signature", "behaviour")
UNVERIFIED = ("typescript", "javascript", "ts", "js", "tsx", "jsx")


@F.pandas_udf(T.BooleanType())
def parses(code: pd.Series) -> pd.Series:
    """Whether Python source parses; null stays null."""

    def fine(source: str | None) -> bool | None:
        try:
            return None if source is None else ast.parse(source) is not None
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False

    return code.map(fine)


def block_findings(blocks: DataFrame) -> DataFrame:
    """(chapter, position, code) of each rule that a block breaks.

    ``blocks`` (chapter, position, type, markdown, language, code, illustrative, citation_ids): Python must parse, other
    samples must be illustrative, cited Python must name something, fences must close, no block may hold a secret marker.
    Only distinct Python sources reach Python workers.
    """
    is_code, lang = F.col("type") == "code", F.lower("language")
    sources = blocks.where(is_code & (lang == "python")).select("code").distinct().select(F.col("code").alias("_code"), parses("code").alias("_parses"))
    text = F.coalesce(F.when(F.col("type") == "markdown", F.col("markdown")).when(is_code, F.col("code")), F.lit(""))
    cited = is_code & ~F.col("illustrative") & (F.size("citation_ids") > 0)
    vague = ~F.col("code").rlike(r"\b[a-z_]\w*(?:\.[a-zA-Z_]\w*)+\b") & ~F.col("code").rlike("import |from |def |class ")
    rules = (
        ("code.syntax", is_code & (lang == "python") & ~F.col("_parses")),
        ("code.unverified", is_code & lang.isin(*UNVERIFIED) & ~F.col("illustrative")),
        ("code.untraceable", cited & (lang == "python") & vague),
        ("markdown.unclosed-fence", (F.col("type") == "markdown") & (fence_count(F.col("markdown")) % 2 == 1)),
        ("secret.marker", F.size(secret_markers(text)) > 0),
    )
    broken = F.filter(F.array(*(F.when(holds, F.lit(name)) for name, holds in rules)), lambda x: x.isNotNull())
    joined = blocks.join(sources, is_code & (lang == "python") & (F.col("code") == F.col("_code")), "left")
    return joined.select("chapter", "position", F.explode(broken).alias("finding"))


def citation_findings(uses: DataFrame, citations: DataFrame, approved: DataFrame) -> DataFrame:
    """(document, citation_id, finding): uses (document, citation_id) of unknown citations, and citations (document,
    citation_id, snapshot_id) outside the snapshots that are ``approved`` (document, snapshot_id)."""
    unknown = uses.select("document", "citation_id").distinct().join(citations, ["document", "citation_id"], "left_anti").withColumn("finding", F.lit("citation.unknown"))
    outside = citations.join(approved, ["document", "snapshot_id"], "left_anti").select("document", "citation_id").distinct().withColumn("finding", F.lit("citation.out-of-scope"))
    return unknown.unionByName(outside)


def prune(facts: DataFrame, pack: DataFrame) -> DataFrame:
    """Facts (chapter, fact_id, kind, citation_ids) with the ids that ``pack`` (chapter, citation_ids) holds, in order,
    and kept: false for kinds that need evidence and have none left. A pack is a bounded list, a row for each chapter."""
    joined = facts.join(pack.select("chapter", F.col("citation_ids").alias("_known")), "chapter", "left")
    left = F.filter("citation_ids", lambda c: F.array_contains(F.coalesce("_known", F.expr("cast(array() as array<string>)")), c))
    return joined.select("chapter", "fact_id", "kind", left.alias("citation_ids"), ((F.size(left) > 0) | ~F.col("kind").isin(*GROUNDED)).alias("kept"))


def keep_first(rows: DataFrame, known: DataFrame, by: list[str], order: str) -> DataFrame:
    """What is to be appended: the first row of each new key, none for keys that ``known`` holds."""
    others = [c for c in rows.columns if c not in by]
    fresh = rows.join(known.select(*by).distinct(), by, "left_anti")
    return fresh.groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("_r")).select(*by, "_r.*")


def bundle_parts(documents: DataFrame, chapters: DataFrame, blocks: DataFrame, exercises: DataFrame | None = None) -> DataFrame:
    """(document, ordinal, position, part): the paragraphs of each document in order, its title and description first.

    A chapter's ``exercises`` (document, chapter, position, prompt, solution) follow its blocks.
    """
    body = F.when(F.col("type") == "code", F.concat(F.lit("```"), "language", F.lit("\n"), "code", F.lit("\n```"))).otherwise(F.coalesce("markdown", F.lit("")))
    first = documents.select("document", F.lit(-1).cast("long").alias("ordinal"), F.posexplode(F.array(F.concat(F.lit("# "), "title"), F.col("description"))).alias("position", "part"))
    named = chapters.join(documents, "document", "left_semi")
    heads = F.array(F.concat(F.lit("## "), "title"), F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")))
    head = named.select("document", F.col("ordinal").cast("long").alias("ordinal"), F.posexplode(heads).alias("position", "part"))
    own = named.select("document", "chapter", F.col("ordinal").cast("long").alias("ordinal"))
    rest = blocks.join(own, ["document", "chapter"]).select("document", "ordinal", (F.col("position") + 2).alias("position"), body.alias("part"))
    found = [first, head, rest]
    if exercises is not None:
        asked = F.array(F.concat(F.lit("### Exercise: "), "prompt"), F.nullif("solution", F.lit("")))
        each = exercises.join(own, ["document", "chapter"]).select("document", "ordinal", F.col("position").cast("long").alias("_at"), F.posexplode(asked).alias("_k", "part"))
        found.append(each.select("document", "ordinal", (F.col("_at") * 2 + F.col("_k") + (1 << 40)).alias("position"), "part"))
    typed = [x.select("document", F.col("ordinal").cast("long").alias("ordinal"), F.col("position").cast("long").alias("position"), "part") for x in found]
    return functools.reduce(DataFrame.unionByName, typed).where("part is not null")


def markdown_bundle(documents: DataFrame, chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document, markdown): title, description, then chapters and their blocks in order, as they pass by."""

    def step(state, rows):
        state.extend(rows.column("part").to_pylist())
        return []

    finish = lambda state: [{"markdown": "\n\n".join(state).strip() + "\n"}]
    return fold(bundle_parts(documents, chapters, blocks), ["document"], ["ordinal", "position", "part"], list, step, finish, StructType.fromDDL("markdown string"))
