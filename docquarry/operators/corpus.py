"""Searches and statements over the corpus tables: projects, snapshots, sources, documents, chunks and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import excerpt
from docquarry.operators.search import WEIGHTS
from docquarry.sources.stage import Stage

_WEIGHT = dict(WEIGHTS)


def in_snapshots(rows: DataFrame, snapshots: list[str] | None, column: str = "snapshot_id") -> DataFrame:
    """Rows of the approved snapshots; an empty list restricts nothing."""
    return rows.where(F.col(column).isin(list(snapshots))) if snapshots else rows


def like_score(terms: list[str], columns: list[str]) -> Column:
    """Number of (column, term) pairs that match; a term's wildcards stand for themselves, case is ignored."""
    hits = [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(t.lower())), F.lit(False)).cast("int") for c in columns for t in terms]
    return sum(hits[1:], hits[0])


def _best(rows: DataFrame, kind: str, terms: list[str], columns: list[str], limit: int, locator: Column, title: str, shown: str, key: str) -> DataFrame:
    """The best ``limit`` rows of an index; each task keeps its own best before they meet."""
    scored = rows.withColumn("_s", like_score(terms, columns)).where("_s > 0")
    best = scored.orderBy(F.desc("_s"), key).limit(limit)
    return best.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), (F.col("_s") * _WEIGHT[kind]).alias("score"), "snapshot_id", locator.alias("locator"), F.col(title).alias("title"), excerpt(F.coalesce(F.col(shown), F.lit(""))).alias("excerpt"))


def document_search(documents: DataFrame, kind: str, project: str, terms: list[str], snapshots: list[str] | None = None, limit: int = 20) -> DataFrame:
    """(kind, id, score, snapshot_id, locator, title, excerpt): documents of a project by title or body."""
    column = "title" if kind == "document_title" else "body"
    own = in_snapshots(documents.where(F.col("project_id") == project), snapshots)
    return _best(own, kind, terms, [column], limit, F.col("uri"), "title", column, "id")


def chunk_search(chunks: DataFrame, documents: DataFrame, project: str, terms: list[str], snapshots: list[str] | None = None, limit: int = 20) -> DataFrame:
    """The same for chunks, each joined with its document; the locator ends in its anchor or ordinal.

    Chunks are scored before the join, so only those that match meet the documents.
    """
    docs = in_snapshots(documents, snapshots).select(F.col("id").alias("_d"), "uri", "title", "snapshot_id")
    hits = chunks.where((F.col("project_id") == project) & (like_score(terms, ["text"]) > 0)).join(docs, F.col("document_id") == F.col("_d"))
    locator = F.concat("uri", F.lit("#"), F.coalesce(F.nullif("anchor", F.lit("")), F.concat(F.lit("chunk-"), F.col("ordinal").cast("string"))))
    return _best(hits, "document_chunk", terms, ["text"], limit, locator, "title", "text", "id")


def symbol_search(symbols: DataFrame, documents: DataFrame, project: str, terms: list[str], snapshots: list[str] | None = None, limit: int = 20) -> DataFrame:
    """The same for symbols by name, qualified name, signature and docstring; the locator is path and lines."""
    columns = ["name", "qualified_name", "signature", "docstring"]
    docs = in_snapshots(documents, snapshots).select(F.col("id").alias("_d"), "path", "snapshot_id")
    hits = symbols.where((F.col("project_id") == project) & (like_score(terms, columns) > 0)).join(docs, F.col("document_id") == F.col("_d"))
    locator = F.concat("path", F.lit("#L"), F.col("start_line").cast("string"), F.lit("-L"), F.col("end_line").cast("string"))
    return _best(hits, "code_symbol", terms, columns, limit, locator, "qualified_name", "signature", "id")


def ordered(rows: DataFrame, by: str, order: list[Column], name: str = "position") -> DataFrame:
    """Adds a position from 1 within ``by``, for lists that are read in order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def snapshot_refs(snapshots: DataFrame, sources: DataFrame, wanted: list[str]) -> DataFrame:
    """(snapshot_id, kind, locator, commit_sha): what citations need to know of the wanted snapshots; a list restricts them."""
    own = snapshots.where(F.col("snapshot_id").isin(wanted))
    return own.join(sources.select("source_id", "kind", "locator"), "source_id").select("snapshot_id", "kind", "locator", "commit_sha")


def reused_documents(snapshots: DataFrame, documents: DataFrame, chunks: DataFrame, project: str, fingerprint: str) -> DataFrame:
    """(snapshot_id, document_id, chunks) of the snapshot of ``project`` with that fingerprint: what a new capture may keep."""
    found = snapshots.where((F.col("project_id") == project) & (F.col("fingerprint") == fingerprint)).select("snapshot_id")
    docs = documents.join(found, "snapshot_id", "left_semi").select("snapshot_id", F.col("id").alias("document_id"))
    counts = chunks.join(docs, "document_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    return docs.join(counts, "document_id", "left").select("snapshot_id", "document_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def scoped_get(rows: DataFrame, parents: list[tuple[DataFrame, str]], **keys) -> DataFrame:
    """Rows with the given key values whose parents exist: each of ``parents`` is (table, shared column)."""
    out = rows
    for column, value in keys.items():
        out = out.where(F.col(column) == value)
    for table, column in parents:
        out = out.join(table.select(column).distinct(), column, "left_semi")
    return out


def get_or_create(existing: DataFrame, offered: DataFrame, key: str, order: str) -> DataFrame:
    """(row of each key, created): rows that exist win, else the first one offered."""
    every = existing.withColumn("_new", F.lit(1)).unionByName(offered.withColumn("_new", F.lit(2)))
    others = [c for c in existing.columns if c != key]
    best = every.groupBy(key).agg(F.min_by(F.struct(*others, "_new"), F.struct("_new", order)).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in others), (F.col("_r._new") == 2).alias("created"))


def upsert(existing: DataFrame, writes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after writes by key: the last write of a key replaces its row."""
    every = existing.withColumn("_w", F.lit(0)).unionByName(writes.withColumn("_w", F.lit(1)))
    others = [c for c in existing.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("_w", order)).alias("_r")).select(*keys, "_r.*")


def insert_checked(existing: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, accepted): an insert whose key exists, or came earlier in the batch, is refused."""
    taken = existing.select(F.col(key).alias("_k")).distinct()
    firsts = rows.groupBy(key).agg(F.min(order).alias("_first"))
    joined = rows.join(firsts, key).join(taken, F.col(key) == F.col("_k"), "left")
    return joined.select(key, order, (F.col("_k").isNull() & (F.col(order) == F.col("_first"))).alias("accepted"))


def delete_cascade(tables: dict[str, DataFrame], links: dict[str, tuple[str, str, str]], root: str, gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """The tables after the rows of ``gone`` (key) left ``root``: dependants go with them.

    ``links`` has, for each dependent table and after its parent, (its column, parent table, parent's column).
    """
    lost = {root: tables[root].join(gone.select(key).distinct(), key, "left_semi")}
    left = {root: tables[root].join(gone.select(key).distinct(), key, "left_anti")}
    for name, (column, parent, parent_key) in links.items():
        keys = lost[parent].select(F.col(parent_key).alias(column)).distinct()
        lost[name] = tables[name].join(keys, column, "left_semi")
        left[name] = tables[name].join(keys, column, "left_anti")
    return left


def bulk_revoke(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions with revoked_at set to ``now`` for the open ones of ``users`` (user_id)."""
    hit = users.select(F.col("user_id").alias("_u")).distinct()
    joined = sessions.join(hit, F.col("user_id") == F.col("_u"), "left")
    return joined.withColumn("revoked_at", F.when(F.col("_u").isNotNull() & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))).drop("_u")


def session_state(sessions: DataFrame, now: Column, absolute: str = "12 hours", idle: str = "2 hours", refresh: str = "1 minute") -> DataFrame:
    """Adds state (revoked, expired, idle, active) and refresh: whether last_seen is old enough to be written again."""
    span = lambda x: F.expr(f"interval {x}")
    state = (
        F.when(F.col("revoked_at").isNotNull(), "revoked")
        .when(F.col("created_at") + span(absolute) <= now, "expired")
        .when(F.col("last_seen") + span(idle) < now, "idle")
        .otherwise("active")
    )
    out = sessions.withColumn("state", state)
    return out.withColumn("refresh", (F.col("state") == "active") & (F.col("last_seen") + span(refresh) <= now))
