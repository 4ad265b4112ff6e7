"""JSON documents and parts of text files as column expressions."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docquarry.functions.text import slug

#: How a pointer to a large file begins, and how much of a file is looked at for a NUL.
LFS_HEADER = "version https://git-lfs.github.com/spec/v1"
SNIFF_BYTES = 8192
#: The parts of an analyser's report that are read; unknown fields are ignored, missing ones get defaults.
REPORT = """tool struct<name: string, version: string, typescript: string, runtime: string>, root string, schemaVersion string,
    files array<struct<path: string, language: string, bytes: bigint, lines: bigint>>,
    symbols array<struct<id: string, name: string, qualifiedName: string, kind: string, file: string, exported: boolean, isAsync: boolean>>,
    callEdges array<struct<id: string, `from`: string, calleeText: string, resolution: string, confidence: string>>"""


@F.arrow_udf(StringType())
def canonical_json(text: pa.Array) -> pa.Array:
    """A JSON text with sorted keys, no blanks and letters as they are; null if it is none. SQL can't sort keys."""

    def one(value: str | None) -> str | None:
        try:
            return None if value is None else json.dumps(json.loads(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return pa.array([one(v) for v in text.to_pylist()], pa.string())


def content_digest(text: Column) -> Column:
    """SHA-256 of the canonical form, so that equal documents have one digest whatever the order of their keys."""
    return F.sha2(canonical_json(text).cast("binary"), 256)


def input_digest(**parts: Column) -> Column:
    """SHA-256 of named inputs as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts)))).cast("binary"), 256)


def reply_json(text: Column) -> Column:
    """The JSON that a reply holds: all of it, without a code fence, or what stands between its outermost braces; else null."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = F.when(F.contains(bare, F.lit("\n")), F.regexp_replace(bare, r"(?s)^[^\n]*\n", "")).otherwise("")
    inside = F.when(F.contains(body, F.lit("```")), F.regexp_replace(body, r"(?s)```(?!.*```).*$", "")).otherwise(body)
    candidate = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(inside, r"^\s+|\s+$", "")).otherwise(bare)
    braces = F.regexp_extract(candidate, r"(?s)\{.*\}", 0)
    sound = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(sound(candidate), sound(F.nullif(braces, F.lit(""))))


def report(text: Column) -> Column:
    """An analyser's JSON report as a struct of ``REPORT``; null if the text is no JSON object."""
    return F.from_json(text, REPORT)


def report_symbols(reports: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, id, name, qualified_name, kind, file, exported, is_async) of each symbol of each report."""
    own = reports.select(key, F.posexplode(report(F.col(text))["symbols"]).alias("position", "s"))
    texts = lambda name: F.coalesce(F.col("s")[name], F.lit(""))
    flag = lambda name: F.coalesce(F.col("s")[name], F.lit(False))
    return own.select(key, "position", texts("id").alias("id"), texts("name").alias("name"), texts("qualifiedName").alias("qualified_name"), F.coalesce(F.col("s")["kind"], F.lit("variable")).alias("kind"), texts("file").alias("file"), flag("exported").alias("exported"), flag("isAsync").alias("is_async"))


def report_stats(reports: DataFrame, key: str, text: str) -> DataFrame:
    """(key, files, total_bytes, symbols, calls, resolved, external, unresolved) of each report."""
    own = reports.select(key, report(F.col(text)).alias("r"))
    n = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0))
    calls = F.col("r.callEdges")
    of = lambda kind: n(F.filter(calls, lambda e: e["resolution"] == kind))
    total = F.coalesce(F.aggregate("r.files", F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f["bytes"], F.lit(0))), F.lit(0))
    return own.select(key, n("r.files").alias("files"), total.alias("total_bytes"), n("r.symbols").alias("symbols"), n(calls).alias("calls"), of("resolved").alias("resolved"), of("external").alias("external"), of("unresolved").alias("unresolved"))


def fenced(text: Column, fence: str = "<<<EVIDENCE>>>", instead: str = "<evidence-delimiter-removed>") -> Column:
    """Text without the delimiter of the envelope that it is to be put in."""
    return F.replace(text, F.lit(fence), F.lit(instead))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, that a character offset is in."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def anchors(sections: DataFrame, key: str, ordinal: str, heading: str) -> DataFrame:
    """Adds anchor: the heading's slug, with ``-2``, ``-3`` ... for its repeats in the order of ``ordinal``."""
    base = sections.withColumn("_base", slug(F.coalesce(F.col(heading), F.lit(""))))
    nth = F.row_number().over(Window.partitionBy(key, "_base").orderBy(ordinal))
    return base.withColumn("_n", nth).withColumn("anchor", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_n").cast("string")))).drop("_base", "_n")


def content_reason(content: Column, most: int = 512 * 1024) -> Column:
    """Why a file's own bytes keep it out; null if they don't."""
    text = content.cast("binary")
    has = lambda data, part: F.contains(data, F.lit(part))
    return (
        F.when(F.startswith(text, F.lit(LFS_HEADER.encode())) & has(text, b"\noid "), "git_lfs")
        .when(F.length(text) > most, "too_large")
        .when(has(F.substring(text, 1, SNIFF_BYTES), b"\x00"), "binary")
    )


def pinned_locator(kind: Column, locator: Column, repo: Column, commit: Column) -> Column:
    """The durable name of a place: web addresses as they are, repository paths under name and commit; null if it can't be pinned."""
    web = F.when(locator.rlike("^https?://"), locator)
    code = F.when((F.coalesce(repo, F.lit("")) != "") & (F.coalesce(commit, F.lit("")) != ""), F.concat(repo, F.lit("@"), commit, F.lit("/"), F.regexp_replace(locator, "^/+", "")))
    return F.when(kind == "web", web).otherwise(code)
