"""Examples for code analysis, greedy verdicts, crawls and gates."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from docquarry.operators import code, crawl, dedupe, gates
from docquarry.plans import code as code_plans
from docquarry.sources.stage import Stage

_A = '''import os
from .core import Engine as E
__all__ = ["A", "go"]
X = 1
class A(E):
    "Doc."
    def run(self, n: int = 1, *, k="z", **kw) -> int:
        def inner(): return n
        return self.step() + self.no() + inner() + E.go(n) + os.getpid() + E.gone()
    def step(self): return go()(1)
def go(cb=None):
    cb(); len([]); nope(); A(); return X[0]()
def go(): pass
'''
_CORE = "class Engine:\n    def go(self): pass\n"


def test_python_analysis(spark):
    files = spark.createDataFrame([("p/a.py", _A), ("p/core.py", _CORE), ("p/bad.py", "def ("), ("p/none.py", None), ("p/empty.py", "")], "path string, text string")
    parsed = code.analysed(files)
    assert {r.path for r in parsed.where("error is not null").collect()} == {"p/bad.py"}
    own = {r.id: r for r in code.symbols(parsed).collect()}
    assert own["p/a.py#A.run"].signature == "(self, n: int = 1, *, k='z', **kw) -> int"
    assert own["p/a.py#A.run.<locals>.inner"].parent_id == "p/a.py#A.run" and own["p/a.py#A"].doc_summary == "Doc."
    assert "p/a.py#go~2" in own and not own["p/a.py#X"].exported and own["p/core.py#Engine.go"].kind == "method"
    assert {(r.module, r.resolved) for r in code.imports(parsed).collect()} == {("os", None), ("p.core", "p/core.py")}
    found = {r.callee: (r.reason, r.target, r.confidence) for r in code.calls(parsed).where("file = 'p/a.py'").collect()}
    assert found == {
        "self.step": ("self-method", "p/a.py#A.step", "medium"),
        "self.no": ("self-attribute-not-defined-in-class", None, "low"),
        "inner": ("local-binding", None, "low"),
        "E.go": ("imported-class-member", "p/core.py#Engine.go", "medium"),
        "E.gone": ("imported-name-not-defined-in-target", None, "low"),
        "os.getpid": ("external-module", None, "medium"),
        "go()": ("dynamic-call-result", None, "low"),
        "go": ("module-level-definition", "p/a.py#go", "high"),
        "cb": ("parameter-invocation", None, "low"),
        "len": ("builtin", None, "medium"),
        "nope": ("no-binding-for-callee", None, "low"),
        "A": ("module-level-definition", "p/a.py#A", "high"),
        "X[0]": ("computed-callee", None, "low"),
    }


def test_python_files_are_dealt_to_tasks(spark):
    assert len(code_plans._parsed(spark, "/root/testdata/sf0.01").inputFiles()) > 1  # from a table of one file


def test_python_imports_and_symbols_alone(spark):
    text = "def f(a, /, b: int = 1, *, c=2, **kw: x.y) -> A[int]: pass\ntry:\n    import b.c as d\nexcept E:\n    from . import e\ndef f(*a: T, k): pass\n"
    files = spark.createDataFrame([("p/a.py", text), ("p/b.py", "def f(x):\n    global x\n"), ("p/e.py", "")], "path string, text string")
    every = code.analysed(files)
    for name in ("symbols", "imports", "calls"):
        assert code.analysed(files, [name]).orderBy("path").collect() == every.select("path", "module", "error", name).orderBy("path").collect()
    assert [r.signature for r in code.symbols(every).orderBy("ordinal").collect()] == ["(a, /, b: int = 1, *, c=2, **kw: x.y) -> A[int]", "(*a: T, k)"]
    assert [(r.module, r.resolved, r.ordinal) for r in code.imports(every).orderBy("ordinal").collect()] == [("b.c", None, 0), ("p", None, 1)]
    assert "(b.py, line 2)" in every.where("path = 'p/b.py'").first().error


def test_first_come(spark):
    pick = random.Random(3)
    pairs = [p for p in itertools.combinations(range(30), 2) if pick.random() < 0.08]
    gone = set()
    for b in range(30):
        if any(a not in gone for a, x in pairs if x == b):
            gone.add(b)
    stage = Stage(spark, "test")
    assert {r.node for r in dedupe.first_come(spark.createDataFrame(pairs, "a long, b long"), stage).collect()} == gone
    assert dedupe.first_come(spark.createDataFrame([], "a long, b long"), stage).count() == 0


def test_verdicts_edges(spark):
    words = " ".join(f"word{i}" for i in range(120))
    rows = [(1, words), (2, words.upper() + " "), (3, words.replace("word60", "other")), (4, words.replace("word60", "other")), (5, None), (6, ""), (7, "Not found."), (8, "Not found!")]
    found = {r.doc_id: (r.kind, r.original) for r in dedupe.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ("unique", None), 2: ("exact", 1), 3: ("near", 1), 4: ("exact", 1), 5: ("unique", None), 6: ("exact", 5), 7: ("unique", None), 8: ("unique", None)}
    assert dedupe.verdicts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_pairs_all_sizes(spark):
    pick, texts = random.Random(5), []
    for size in (30, 45, 80, 150, 300, 500):
        base = [f"w{pick.randrange(400)}" for _ in range(size)]
        for k in range(9):  # families whose members drift apart, are cut or go on
            texts.append(" ".join(w if pick.random() > 0.012 * k else f"x{pick.randrange(9)}" for w in base))
        texts += [" ".join(base[: size * 9 // 10]), " ".join(base + base[: size // 12]), " ".join(base + [f"y{j}" for j in range(size)])]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(dict.fromkeys(texts))], "doc_id long, text string")
    want = {}
    sketches = {r.doc_id: {int(h, 16) for h in r.sketch} for r in dedupe.sketches(docs).collect() if r.chars >= 120}
    for a, b in itertools.combinations(sorted(sketches), 2):
        m = min(len(sketches[a]), len(sketches[b]))
        shared = len(set(sorted(sketches[a] | sketches[b])[:m]) & sketches[a] & sketches[b])
        if shared / m >= 0.85:
            want[a, b] = shared / m
    stored = dedupe.long_sketches(docs, docs, Stage(spark, "test"), chars=120)
    assert {(r.a, r.b): r.similarity for r in dedupe.near_pairs(stored).collect()} == want
    assert {len(sketches[a]) == 256 for a, _ in want} == {True, False} and any(len(sketches[a]) != len(sketches[b]) for a, b in want)
    packed = stored.withColumnRenamed("doc_id", "b")
    every = docs.selectExpr("doc_id as a").join(packed, F.col("a") < F.col("b")).select("a", "b").join(stored.selectExpr("doc_id as a"), "a")
    found = dedupe.similar_pairs(every, stored, 0.85, together=3).collect()  # many blocks
    assert {(r.a, r.b): r.similarity for r in found} == want


def test_strangers_with_common_phrases_do_not_meet(spark, monkeypatch):
    common = " ".join(f"common{k}" for k in range(30))
    docs = [(n, f"{common} " + " ".join(f"own{n}x{k}" for k in range(40))) for n in range(200)]
    docs.append((200, docs[7][1] + " more"))
    met, plain = [], dedupe.similar_pairs
    monkeypatch.setattr(dedupe, "similar_pairs", lambda pairs, *rest: met.append(pairs.count()) or plain(pairs, *rest))
    found = {r.doc_id: r.original for r in dedupe.verdicts(spark.createDataFrame(docs, "doc_id long, text string")).where("kind = 'near'").collect()}
    assert found == {200: 7} and sum(met) < 20


def test_crawl_edges(spark):
    bodies = [("a", 200, "Disallow: /x"), ("b", 200, None), ("c", None, None), ("d", 404, "x"), ("e", 200, "user-agent: *\nuser-agent: docbot\nDisallow: /e\n\nuser-agent: doc\nallow: /")]
    rules = crawl.robots_rules(spark.createDataFrame(bodies, "host string, status int, body string"), "DocBot/2")
    assert {(r.host, r.pattern, r.allow) for r in rules.collect()} == {("c", "/", False), ("e", "/e", False)}
    maps = [(1, None), (2, ""), (3, "<urlset><url><loc>http://h.example/a</loc><priority>x</priority><lastmod>never</lastmod></url></urlset>"), (4, "<!ENTITY x><url><loc>http://h.example/</loc></url>")]
    entries = crawl.sitemap_entries(spark.createDataFrame(maps, "sitemap_id int, xml string")).collect()
    assert [(r.sitemap_id, r.canonical, r.lastmod, r.priority) for r in entries] == [(3, "http://h.example/a", None, None)]
    hosts = spark.createDataFrame([("docs.example.com",), ("::1",), ("a.home.arpa.",), (None,), ("x",)], "h string")
    assert [r[0] for r in hosts.select(crawl.hostname_reason(F.col("h"))).collect()] == [None, None, "private_hostname", "private_hostname", "private_hostname"]


def test_gates_edges(spark):
    empty = spark.createDataFrame([], "chapter long, position long, type string, markdown string, language string, code string, illustrative boolean, citation_ids array<string>")
    assert gates.block_findings(empty).count() == 0
    one = spark.createDataFrame([(1, 1, "code", None, None, None, False, []), (1, 2, "markdown", None, None, None, None, None)], empty.schema)
    assert gates.block_findings(one).count() == 0
