"""Queries on Python sources: a small package for each row of ``part``; tests hold the analysis to examples."""

from __future__ import annotations

from docquarry.operators import code
from docquarry.sources.stage import Stage
from docquarry.sources.tables import table

_SOURCES = r"""array(
    struct(concat('src/pkg', k, '/core.py') AS path, concat('import os\nLIMIT: int = ', k, '\nclass Engine:\n    "An engine."\n    def run(self, n: int = 1):\n        return self.step(n) + self.gone()\n    def step(self, n):\n        return os.getpid() + len(str(n))\ndef make', k, '():\n    return Engine()\n') AS text),
    struct(concat('src/pkg', k, '/app.py') AS path, concat('from .core import Engine, make', k, ' as m\nimport pkg', k, '.core as core\nimport json\ndef main(f):\n    e = m()\n    e.run()\n    core.Engine()\n    json.dumps(f())\n    (lambda: 1)()\n    Engine.run(e)\n', CASE WHEN k % 10 = 0 THEN 'def broken(' ELSE '' END) AS text),
    struct(concat('src/pkg', k, '/__init__.py') AS path, 'from . import core\n__all__ = ["core"]\n' AS text))"""


#: Rows of ``part`` in a task. Their table is small, and what is made of each row is not: files of a few MB would be one task's.
_TOGETHER = 2_000


def _analysed(spark, sf_dir, *wanted):
    keys = table(spark, sf_dir, "part").selectExpr("p_partkey AS k")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // _TOGETHER))
    return code.analysed(keys.repartition(parts).selectExpr(f"inline({_SOURCES})"), wanted)


def _parsed(spark, sf_dir, *wanted):
    """Parsed once and written, as imports and calls read it several times."""
    return Stage(spark, "python").save(_analysed(spark, sf_dir, *wanted), "parsed")


QUERIES = {
    "python_symbols": lambda spark, sf_dir: code.symbols(_analysed(spark, sf_dir, "symbols")),
    "python_imports": lambda spark, sf_dir: code.imports(_parsed(spark, sf_dir, "imports")).selectExpr("file", "ordinal", "module", "resolved", "line", "to_json(bindings) AS bindings"),
    "python_calls": lambda spark, sf_dir: code.calls(_parsed(spark, sf_dir, "symbols", "calls")),
}

ORACLE: dict[str, str] = {}
