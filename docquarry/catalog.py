"""All queries of the engine with their DuckDB counterparts, gathered from the modules of ``plans``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.plans import assembly, audit, code, corpus, crawl, dedupe, files, gates, ledger, rules, search, state, text, urls

_MODULES = (dedupe, text, ledger, urls, state, search, files, audit, crawl, rules, code, gates, corpus, assembly)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _MODULES:
        out |= module.ORACLE
    return out
