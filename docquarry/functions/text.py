"""Text expressions without Python, but for ``nfkc``; those over arrays (``transform``, ``filter``) are interpreted by the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What a leaked secret tends to begin with.
SECRET_MARKERS = ("-----BEGIN", "sk-", "ghp_", "xoxb-", "aws_access_key_id", "api_key =")
EXCERPT_LENGTH = 400
CJK = "[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"


def words(text: Column) -> Column:
    """Unicode words in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


#: What ends a line, and the marks of Markdown in a line.
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
FENCE_LINE = r"(?U)^\s*(```|~~~)"
HEADING_MARK = r"(?U)^\s{0,3}#{1,6}\s+"
BULLET_MARK = r"(?U)^\s*([-*+]|\d+\.)\s+"
LINK = r"\[([^\]]*)\]\([^)]*\)"
EMPHASIS = r"[*_`]{1,3}"
#: White space that is trimmed at the ends.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once; else a lambda would evaluate it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring lower-case words; the words themselves if there are fewer than two."""

    def pairs(w: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
        return F.array_distinct(F.when(F.size(w) >= 2, two).otherwise(w))

    return bound(words(F.lower(text)), pairs)


def query_terms(text: Column) -> Column:
    """Distinct words in order of appearance: three characters, or two with a CJK or kana one."""
    return F.array_distinct(F.filter(words(text), lambda t: F.length(t) >= F.when(t.rlike(CJK), 2).otherwise(3)))


def excerpt(text: Column, limit: int = EXCERPT_LENGTH) -> Column:
    """White space collapsed; a longer text is cut before ``limit`` and ends in an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def fence_count(text: Column) -> Column:
    """Occurrences of a code fence."""
    return ((F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("")))) / 3).cast("int")


def secret_markers(text: Column) -> Column:
    """The markers that the text holds, case ignored, in their fixed order."""
    low = F.lower(text)
    return F.filter(F.array(*(F.lit(m) for m in SECRET_MARKERS)), lambda m: F.contains(low, F.lower(m)))


def markdown_to_text(markdown: Column) -> Column:
    """Fence lines dropped; heading, bullet and number marks, links and emphasis stripped; ends trimmed."""
    lines = F.filter(F.split(markdown, LINE_END), lambda x: ~x.rlike(FENCE_LINE))

    def clean(line: Column) -> Column:
        for pattern, into in ((HEADING_MARK, ""), (BULLET_MARK, ""), (LINK, "$1"), (EMPHASIS, "")):
            line = F.regexp_replace(line, pattern, into)
        return F.rtrim(line, F.lit(BLANKS))

    return F.btrim(F.array_join(F.transform(lines, clean), "\n"), F.lit(BLANKS))


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility forms as plain ones; SQL has no such function."""
    return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in text.to_pylist()], pa.string())


def heading_slug(heading: str) -> str:
    """``slug`` of one heading, for what runs in Python."""
    kept = re.sub(r"[^\w\s-]", "", unicodedata.normalize("NFKC", heading).strip().lower())
    return re.sub(r"[\s_-]+", "-", kept).strip("-") or "section"


def slug(heading: Column) -> Column:
    """NFKC, lower case, marks dropped, runs of blanks, underscores and hyphens as one hyphen; ``section`` if nothing is left."""
    kept = F.regexp_replace(F.lower(F.trim(nfkc(heading))), r"(?U)[^\w\s-]", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_-]+", "-"), "^-+|-+$", "")
    return F.when(dashed == "", "section").otherwise(dashed)
