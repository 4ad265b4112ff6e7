"""Chunks of code by lines and of Markdown by sections."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from docquarry.functions.rules import PROSE
from docquarry.functions.text import heading_slug


def line_windows(docs: DataFrame, lines: int = 60, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ordinal, anchor, sha256, token_count): windows of ``lines`` lines, blank ones dropped.

    Windows are cut inside each row's array of lines, so nothing is shuffled.
    """
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    own = docs.select(key, split.alias("l")).select(key, "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / lines))).alias("o"))
    part = F.slice("l", (F.col("o") * lines + 1).cast("int"), lines)
    cut = own.select(key, F.col("o").cast("int").alias("ordinal"), (F.col("o") * lines + 1).alias("low"), F.size(part).alias("n"), F.array_join(part, "\n").alias("body"))
    anchor = F.concat(F.lit("L"), F.col("low").cast("string"), F.lit("-L"), (F.col("low") + F.col("n") - 1).cast("string"))
    tokens = F.size(F.regexp_extract_all("body", F.lit(r"(?U)\S+"), F.lit(0)))
    return cut.where(F.col("body").rlike(r"(?U)\S")).select(key, "ordinal", anchor.alias("anchor"), F.sha2(F.col("body").cast("binary"), 256).alias("sha256"), tokens.alias("token_count"))


#: How a heading and a fence begin, what counts as a word, and what joins a path of headings.
_HEADING = re.compile(r"^\s{0,3}(#{1,6})\s+")
_FENCE = re.compile(r"^\s*(```|~~~)")
_WORD = re.compile(r"\w+")
_JOIN = " > "
#: Characters of a prose chunk, lines of a code chunk.
CHUNK_CHARACTERS, CHUNK_LINES = 1500, 60


class _Line(NamedTuple):
    start: int
    end: int  # without the line's end
    fenced: bool  # a fence or inside one
    solid: bool  # belongs to a block
    heading: tuple[int, str] | None


def _outline(markdown: str) -> list[_Line]:
    out, at, inside = [], 0, False
    for raw in markdown.splitlines(keepends=True):
        bare = raw.rstrip("\r\n")
        mark = _FENCE.match(bare) is not None
        fenced = mark or inside
        found = None if fenced else _HEADING.match(bare)
        heading = (len(found[1]), bare[found.end() :].rstrip().rstrip("#").strip()) if found else None
        out.append(_Line(at, at + len(bare), fenced, fenced or bool(bare.strip()), heading))
        inside ^= mark
        at += len(raw)
    return out


def _sections(lines: list[_Line]) -> Iterator[tuple[str, str, list[_Line]]]:
    """(heading, path of headings, lines) of each section, in order."""
    above: list[tuple[int, str]] = []
    begins = [k for k, line in enumerate(lines) if line.heading]
    if lines and (not begins or begins[0] > 0):
        yield "", "", lines[: begins[0] if begins else None]
    for low, high in zip(begins, [*begins[1:], len(lines)]):
        level, title = lines[low].heading
        above = [h for h in above if h[0] < level] + [(level, title)]
        yield title, _JOIN.join(t for _, t in above), lines[low:high]


def _spans(markdown: str, lines: list[_Line], limit: int) -> Iterator[tuple[int, int]]:
    """A section's chunks: itself if it fits, else as many whole blocks as fit; a block with a fence stays whole, another one is cut at blanks."""
    if lines[-1].end - lines[0].start <= limit:
        yield lines[0].start, lines[-1].end
        return
    filling: tuple[int, int] | None = None
    for solid, run in itertools.groupby(lines, lambda line: line.solid):
        if not solid:
            continue
        block = list(run)
        low, high = block[0].start, block[-1].end
        if filling and high - filling[0] <= limit:
            filling = filling[0], high
            continue
        if filling:
            yield filling
        fits = high - low <= limit
        filling = (low, high) if fits else None
        if not fits and any(line.fenced for line in block):
            yield low, high
        elif not fits:
            while high - low > limit:
                blank = markdown.rfind(" ", low, low + limit)
                cut = blank if blank > low else low + limit
                yield low, cut
                low = cut
            if low < high:
                yield low, high
    if filling:
        yield filling


def _prose(markdown: str, limit: int) -> Iterator[tuple[str, str, int, int, str]]:
    """(heading, path, first character, end, stripped text) of the chunks that aren't blank."""
    for heading, path, lines in _sections(_outline(markdown)):
        for low, high in _spans(markdown, lines, limit):
            if text := markdown[low:high].strip():
                yield heading, path, low, high, text


def markdown_chunks(docs: DataFrame, limit: int = CHUNK_CHARACTERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ordinal, heading, heading_path, anchor, char_start, char_end, token_count, text) per chunk of a Markdown text.

    A section of at most ``limit`` characters is a chunk; longer ones are packed by blocks. Blank chunks are dropped. The
    anchor is the heading's slug, with ``-2``, ``-3`` ... for repeats in a text.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                used: dict[str, int] = {}
                for n, (heading, path, low, high, piece) in enumerate(_prose(body or "", limit)):
                    slug = heading_slug(heading)
                    used[slug] = used.get(slug, 0) + 1
                    anchor = slug if used[slug] == 1 else f"{slug}-{used[slug]}"
                    rows.append((name, n, heading, path, anchor, low, high, len(_WORD.findall(piece)), piece))
            columns = list(zip(*rows)) or [[]] * 9
            kinds = [batch.column(0).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[key, "ordinal", "heading", "heading_path", "anchor", "char_start", "char_end", "token_count", "text"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ordinal int, heading string, heading_path string, anchor string, char_start int, char_end int, token_count int, text string")


class FileChunks:
    """SQL: ``SELECT ... FROM files, LATERAL file_chunks(path, text)``; a third argument ``false`` leaves the texts out of the schema.

    Prose files are cut by sections, others by windows of lines; both are cited by their lines.
    """

    @staticmethod
    def analyze(path: AnalyzeArgument, text: AnalyzeArgument, with_text: AnalyzeArgument | None = None) -> AnalyzeResult:
        if with_text is not None and not with_text.isConstantExpression:
            raise ValueError("whether texts are returned has to be a constant")
        whole = with_text is None or bool(with_text.value)
        schema = StructType()
        for column in ("ordinal", "anchor", "heading_path", "char_start", "char_end", "token_count", "sha256", "start_line", "end_line", *(["chunk"] if whole else [])):
            schema = schema.add(column, StringType() if column in ("anchor", "heading_path", "sha256", "chunk") else IntegerType())
        return AnalyzeResult(schema)

    def eval(self, path: str, text: str, with_text: bool = True):
        path, text = path or "", text or ""
        dot = path[path.rfind(".") :].lower().removeprefix(".") if "." in path else ""
        chunks = self._sections(path, text) if dot in PROSE else self._windows(path, text)
        for n, (heading, low, high, tokens, hashed, first, end, piece) in enumerate(chunks):
            row = (n, f"L{first}-L{end}", heading, low, high, tokens, hashlib.sha256(hashed.encode()).hexdigest(), first, end)
            yield (*row, piece) if with_text else row

    @staticmethod
    def _sections(path: str, text: str):
        line = lambda at: text.count("\n", 0, at) + 1
        for _, above, low, high, piece in _prose(text, CHUNK_CHARACTERS):
            yield above or path, low, high, len(_WORD.findall(piece)), piece, line(low), line(max(high - 1, low)), piece

    @staticmethod
    def _windows(path: str, text: str):
        lines, at = text.splitlines(keepends=True), 0
        for low in range(0, len(lines), CHUNK_LINES):
            block = lines[low : low + CHUNK_LINES]
            body = "".join(block)
            yield path, at, at + len(body), len(body.split()), body, low + 1, low + len(block), body.rstrip("\n")
            at += len(body)


def register_file_chunks(spark: SparkSession, name: str = "file_chunks") -> None:
    """Make ``FileChunks`` a table function of the session."""
    spark.udtf.register(name, udtf(FileChunks))
