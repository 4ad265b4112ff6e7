"""Decisions on keys, failures, roles and code paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by extension, and extensions of prose.
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}
PROSE = ("md", "mdx", "markdown", "rst", "txt")


def idempotency_key(parts: list[Column], limit: int = 191) -> Column:
    """Trimmed parts joined by colons, those inside escaped; longer keys end in a digest of the whole; null without any part."""
    escaped = [F.replace(F.replace(F.regexp_replace(p, r"^\s+|\s+$", ""), F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:")) for p in parts]
    whole = F.concat_ws(":", *escaped)
    short = F.concat(F.substring(whole, 1, limit - 65), F.lit(":"), F.sha2(whole.cast("binary"), 256))
    return F.when(F.concat(*escaped) != "", F.when(F.length(whole) <= limit, whole).otherwise(short))


def error_class(status: Column) -> Column:
    """What a provider's status means."""
    return (
        F.when(status == 429, "rate_limited")
        .when(status == 408, "timeout")
        .when(status.isin(401, 403), "authentication")
        .when(status == 402, "quota_exhausted")
        .when(status.isin(400, 404, 422), "invalid_request")
        .when((status == 425) | status.between(500, 599), "server_error")
        .otherwise("call_failed")
    )


def retryable(cls: Column) -> Column:
    return cls.isin("rate_limited", "timeout", "server_error", "connection")


def backoff(failures: Column, hint: Column, first: float = 0.5, factor: float = 2.0, most: float = 8.0) -> Column:
    """Seconds to wait: grows by ``factor``, a provider's hint may raise it, ``most`` caps both."""
    return F.least(F.greatest(first * F.pow(F.lit(factor), F.greatest(failures - 1, F.lit(0))), F.coalesce(hint, F.lit(0.0))), F.lit(most))


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))


def language(path: Column) -> Column:
    """Language of a source path by its extension; null for others and for names that are all extension."""
    out = F.when(~F.contains(F.substring(path, 2, 1_000_000), F.lit(".")), F.lit(None).cast("string"))
    for extension, name in LANGUAGES.items():
        out = out.when(_extension(path) == extension, name)
    return out


def chunker(path: Column) -> Column:
    """Which chunker a file gets."""
    return F.when(_extension(path).isin(*PROSE), "sections").otherwise("lines")


def effective_roles(asked: DataFrame, users: DataFrame, projects: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, project_id, role) of each pair that is ``asked`` for: joins by key.

    Inactive users and unknown projects have no role (null), administrators and owners own, others have their membership's.
    """
    who = users.select("user_id", "active", "admin")
    whole = asked.join(who, "user_id", "left").join(projects.select("project_id", "owner_id"), "project_id", "left").join(members.select("user_id", "project_id", F.col("role").alias("_role")), ["user_id", "project_id"], "left")
    owns = F.col("admin") | (F.col("owner_id") == F.col("user_id"))
    role = F.when(F.coalesce("active", F.lit(False)) & F.col("owner_id").isNotNull(), F.when(owns, "owner").otherwise(F.col("_role")))
    return whole.select("user_id", "project_id", role.alias("role"))


def merge_drafts(writes: DataFrame, by: list[str]) -> DataFrame:
    """The surviving write of each key: the last one, but nothing after the first locked one; ``writes`` has seq and locked."""
    others = F.struct(*(c for c in writes.columns if c not in by))
    first = F.min_by(F.when(F.col("locked"), others), F.when(F.col("locked"), F.col("seq")))
    return writes.groupBy(*by).agg(F.coalesce(first, F.max_by(others, "seq")).alias("_r")).select(*by, "_r.*")
