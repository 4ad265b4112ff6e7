"""Diagrams as rows: their source text, their faults, and a guard on foreign source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes by role, arrows by kind, words of the diagram language, marks that labels may not hold.
SHAPES = {"actor": ("([", "])"), "service": ("[", "]"), "component": ("[", "]"), "datastore": ("[(", ")]"), "external": ("[[", "]]"), "process": ("[", "]"), "decision": ("{", "}"), "terminal": ("([", "])")}
RESERVED = ("class", "classdef", "click", "end", "flowchart", "graph", "linkstyle", "sequencediagram", "style", "subgraph")
UNSAFE_MARKS = r"[<>`;{}|\"\\\n\r\t]"
LIFELINES = ("actor", "service", "component", "datastore", "external")
FORBIDDEN_KEYS = ("securityLevel", "secure", "startOnLoad", "htmlLabels", "dompurifyConfig", "themeCSS", "altFontFamily")
DANGEROUS_TAGS = ("script", "iframe", "object", "embed", "link", "meta", "style", "img", "svg", "foreignObject", "form", "input", "button", "base", "animate", "set", "handler")


def _side(role: Column, k: int) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pair in SHAPES.items():
        out = out.when(role == name, pair[k])
    return out


def mermaid_text(kind: Column, direction: Column, nodes: Column, edges: Column) -> Column:
    """The source of a diagram from its nodes (id, label, role) and edges (source, target, label, kind), in their order."""
    chart = F.concat(
        F.lit("flowchart "),
        F.when(direction == "top_down", "TD").otherwise("LR"),
        F.lit("\n"),
        F.array_join(F.transform(nodes, lambda n: F.concat(F.lit("  "), n["id"], _side(n["role"], 0), n["label"], _side(n["role"], 1), F.lit("\n"))), ""),
        F.array_join(F.transform(edges, lambda e: F.concat(F.lit("  "), e["source"], F.when(e["kind"] == "dependency", " -.->").otherwise(" -->"), F.when(e["label"] != "", F.concat(F.lit("|"), e["label"], F.lit("|"))).otherwise(""), F.lit(" "), e["target"], F.lit("\n"))), ""),
    )
    sequence = F.concat(
        F.lit("sequenceDiagram\n"),
        F.array_join(F.transform(nodes, lambda n: F.concat(F.lit("  participant "), n["id"], F.lit(" as "), n["label"], F.lit("\n"))), ""),
        F.array_join(F.transform(edges, lambda e: F.concat(F.lit("  "), e["source"], F.when(e["kind"] == "return", "-->>").otherwise("->>"), e["target"], F.when(e["label"] != "", F.concat(F.lit(": "), e["label"])).otherwise(""), F.lit("\n"))), ""),
    )
    return F.when(kind == "sequence", sequence).otherwise(chart)


def diagram_faults(kind: Column, nodes: Column, edges: Column, max_nodes: int = 24, max_edges: int = 48) -> Column:
    """All rules that a diagram breaks, in a fixed order; each is decided inside its row."""
    ids = F.transform(nodes, lambda n: n["id"])
    labels = F.concat(F.transform(nodes, lambda n: n["label"]), F.transform(edges, lambda e: e["label"]))
    rules = (
        ("node_count", ~F.size(nodes).between(2, max_nodes)),
        ("edge_count", ~F.size(edges).between(1, max_edges)),
        ("bad_id", F.exists(ids, lambda i: ~i.rlike("^[A-Za-z][A-Za-z0-9_]{0,31}$"))),
        ("reserved_id", F.exists(ids, lambda i: F.lower(i).isin(*RESERVED))),
        ("duplicate_node", F.size(F.array_distinct(ids)) < F.size(ids)),
        ("empty_label", F.exists(nodes, lambda n: F.trim(n["label"]) == "")),
        ("unsafe_label", F.exists(labels, lambda x: x.rlike(UNSAFE_MARKS))),
        ("unknown_endpoint", F.exists(edges, lambda e: ~F.array_contains(ids, e["source"]) | ~F.array_contains(ids, e["target"]))),
        ("duplicate_edge", F.size(F.array_distinct(edges)) < F.size(edges)),
        ("not_a_lifeline", (kind == "sequence") & F.exists(nodes, lambda n: ~n["role"].isin(*LIFELINES))),
    )
    return F.filter(F.array(*(F.when(holds, F.lit(name)) for name, holds in rules)), lambda x: x.isNotNull())


#: Lines that react to clicks, addresses that run code, and what opens a setting.
INTERACTION = r"(?i)^\s*(click|callback)\s+\S"
UNSAFE_ADDRESS = r"(?i)(javascript|vbscript|data)\s*:"
SETTING_OPENS = r"%%\{\s*(?:init|initialize)\s*:"


def source_guard(df: DataFrame, source: str = "source", max_bytes: int = 64 * 1024, max_lines: int = 2000) -> DataFrame:
    """Adds code and line: the first reason not to draw a source, nulls if there is none; nothing is shuffled."""
    s = F.col(source)
    lines = F.split(s, r"\r?\n")
    keys = "|".join(FORBIDDEN_KEYS)
    setting = rf"(?is){SETTING_OPENS}(?:(?!\}}%%).)*?[\"']?(?:{keys})[\"']?\s*:"
    tag = rf"(?i)<\s*/?\s*({'|'.join(DANGEROUS_TAGS)})\b"
    fault = lambda x: F.when(x.rlike(INTERACTION), "interaction").when(x.rlike(tag), "raw_html").when(x.rlike(UNSAFE_ADDRESS), "unsafe_url")
    found = F.get(F.filter(F.transform(lines, lambda x, i: F.struct(fault(x).alias("code"), (i + 1).alias("line"))), lambda x: x["code"].isNotNull()), F.lit(0))
    unsafe = s.rlike(setting)
    ahead = F.substring_index(F.lower(F.regexp_replace(s, setting, "\u0001")), "\u0001", 1)
    code = F.when(F.trim(F.regexp_replace(s, r"\s+", " ")) == "", "empty").when(F.octet_length(s) > max_bytes, "too_large").when(F.size(lines) > max_lines, "too_many_lines").when(unsafe, "unsafe_directive")
    line = F.when(code == "unsafe_directive", F.length(ahead) - F.length(F.replace(ahead, F.lit("\n"), F.lit(""))) + 1).when(code.isNull(), found["line"])
    return df.withColumn("code", F.coalesce(code, found["code"])).withColumn("line", line.cast("int"))
