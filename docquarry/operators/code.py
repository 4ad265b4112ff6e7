"""Symbols, imports and calls of Python files; files are parsed in batches, names across files meet in joins."""

from __future__ import annotations

import ast
import builtins
import functools
import itertools
import symtable
from collections import Counter, deque
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.graph import unique_suffixes

_SYMBOL = "struct<ordinal:int,id:string,name:string,qualified_name:string,kind:string,start_line:int,end_line:int,exported:boolean,is_async:boolean,parent_id:string,signature:string,doc_summary:string>"
_IMPORT = "struct<ordinal:int,module:string,bindings:array<struct<imported:string,local:string,kind:string>>,line:int>"
_CALL = "struct<id:string,caller:string,callee:string,reason:string,target:string,kind:string,module:string,imported:string,attribute:string>"


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """As ``inspect.Signature`` shows it."""
    a = node.args

    def shown(x: ast.arg, default: ast.expr | None = None, mark: str = "") -> str:
        text = mark + x.arg if x.annotation is None else f"{mark}{x.arg}: {_dotted(x.annotation)}"
        return text if default is None else f"{text}{'=' if x.annotation is None else ' = '}{_dotted(default)}"

    placed = [*a.posonlyargs, *a.args]
    out = [shown(x, d) for x, d in zip(placed, [None] * (len(placed) - len(a.defaults)) + a.defaults)]
    if a.posonlyargs:
        out.insert(len(a.posonlyargs), "/")
    if a.vararg or a.kwonlyargs:
        out.append(shown(a.vararg, mark="*") if a.vararg else "*")
    out += [shown(x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    out += [shown(a.kwarg, mark="**")] if a.kwarg else []
    return f"({', '.join(out)})" + (f" -> {_dotted(node.returns)}" if node.returns else "")


@functools.lru_cache(maxsize=16)
def _read(text: str) -> tuple[ast.Module, symtable.SymbolTable]:
    """Tree and names of a text; many files of a repository, as empty packages, have the same one."""
    return ast.parse(text), symtable.symtable(text, "", "exec")


#: Where statements hold statements, in the order of ``ast.walk``.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")
#: Fields and nodes without a call, a symbol or an import below them.
_PLAIN = {"arg", "attr", "ctx", "id", "kind", "level", "module", "name", "names", "op", "ops", "type_comment"}
_LEAVES = {ast.Name, ast.Constant, ast.Pass, ast.Import, ast.ImportFrom}
_WALKED = {t: [f for f in t._fields if f not in _PLAIN] for t in vars(ast).values() if isinstance(t, type) and issubclass(t, ast.AST)}
_DEFINITIONS = {ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef}


def _dotted(e: ast.expr) -> str:
    """``e`` as source; names with attributes need no visitor."""
    names = []
    inner = e
    while isinstance(inner, ast.Attribute):
        names.append(inner.attr)
        inner = inner.value
    return ".".join([inner.id, *reversed(names)]) if isinstance(inner, ast.Name) else ast.unparse(e)


def _package(path: str) -> tuple[list[str], list[str]]:
    """Dotted parts of a file's module and of the package that its relative imports start from."""
    parts = [s for s in path.removesuffix(".py").split("/") if s]
    if parts[-1:] == ["__init__"]:
        return parts[:-1], parts[:-1]
    return parts, parts[:-1]


def _children(node: ast.AST) -> list[ast.AST]:
    """As ``ast.iter_child_nodes``, without leaves."""
    out = []
    for name in _WALKED[type(node)]:
        value = getattr(node, name, None)
        if type(value) is list:
            out += [v for v in value if isinstance(v, ast.AST) and type(v) not in _LEAVES]
        elif isinstance(value, ast.AST) and type(value) not in _LEAVES:
            out.append(value)
    return out


class _File:
    """One pass over a parsed file; scopes are (symbol table, kind, qualified name, first parameter)."""

    def __init__(self, path: str, text: str):
        self.path = path
        try:
            tree, table = _read(text)
        except SyntaxError:  # once more, as the error names the file
            tree, table = ast.parse(text), symtable.symtable(text, path, "exec")
        self.symbols: list[dict] = []
        self.taken: dict[str, dict] = {}
        self.times: Counter[str] = Counter()
        self.calls: list[tuple[ast.Call, list]] = []
        self.imports = list(self._imports(tree))
        self.locals = {b["local"]: (r["module"], None if b["kind"] == "namespace" else b["imported"]) for r in self.imports for b in r["bindings"]}
        named = [n.value for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name) and t.id == "__all__"]
        self.exports = {e.value for e in getattr(named[0], "elts", []) if isinstance(e, ast.Constant)} if named else None
        self._walk(tree, [(table, "module", "", None)])

    def _imports(self, tree: ast.Module) -> Iterator[dict]:
        base = _package(self.path)[1]
        n, nodes = 0, deque([tree])
        while nodes:
            node = nodes.popleft()
            for block in _BLOCKS:
                nodes.extend(getattr(node, block, ()))
            if isinstance(node, ast.Import):
                for a in node.names:
                    yield {"ordinal": n, "module": a.name, "bindings": [{"imported": "*", "local": a.asname or a.name.split(".")[0], "kind": "namespace"}], "line": node.lineno}
                    n += 1
            elif isinstance(node, ast.ImportFrom):
                above = base[: max(len(base) - node.level + 1, 0)] if node.level else []
                module = ".".join([*above, *([node.module] if node.module else [])])
                yield {"ordinal": n, "module": module, "bindings": [{"imported": a.name, "local": a.asname or a.name, "kind": "named"} for a in node.names], "line": node.lineno}
                n += 1

    def _add(self, node: ast.AST, name: str, kind: str, scopes: list) -> str:
        prefix = scopes[-1][2] + (".<locals>" if scopes[-1][1] == "function" else "")
        qualified = f"{prefix}.{name}" if prefix else name
        earlier = self.times[qualified]
        self.times[qualified] += 1
        is_def = isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef)
        doc = ast.get_docstring(node) if is_def or isinstance(node, ast.ClassDef) else None
        public = name in self.exports if self.exports is not None and not prefix else not name.startswith("_")
        row = {
            "ordinal": len(self.symbols), "id": f"{self.path}#{qualified}" + (f"~{earlier + 1}" if earlier else ""), "name": name, "qualified_name": qualified, "kind": kind,
            "start_line": node.lineno, "end_line": node.end_lineno, "exported": public, "is_async": isinstance(node, ast.AsyncFunctionDef),
            "parent_id": f"{self.path}#{scopes[-1][2]}" if prefix else None, "signature": _signature(node) if is_def else None, "doc_summary": doc.strip().splitlines()[0] if doc and doc.strip() else None,
        }
        self.symbols.append(row)
        self.taken.setdefault(qualified, row)
        return qualified

    def _walk(self, node: ast.AST, scopes: list) -> None:
        for child in _children(node):
            inner, kind = scopes, type(child)
            if kind in _DEFINITIONS:
                is_class = kind is ast.ClassDef
                kind = "class" if is_class else "method" if scopes[-1][1] == "class" else "function"
                qualified = self._add(child, child.name, kind, scopes)
                tables = [t for t in scopes[-1][0].get_children() if t.get_name() == child.name and t.get_lineno() in (child.lineno, *(d.lineno for d in child.decorator_list))]
                first = None if is_class or kind != "method" else next((a.arg for a in [*child.args.posonlyargs, *child.args.args]), None)
                inner = [*scopes, (tables[0] if tables else scopes[-1][0], "class" if is_class else "function", qualified, first)]
            elif kind is ast.Call:
                self.calls.append((child, scopes))
            elif kind is ast.Assign or kind is ast.AnnAssign:
                for t in child.targets if kind is ast.Assign else [child.target]:
                    if isinstance(t, ast.Name) and t.id != "__all__":
                        self._add(child, t.id, "variable", scopes)
            elif kind is ast.TypeAlias:
                self._add(child, child.name.id, "type_alias", scopes)
            self._walk(child, inner)

    def _binding(self, name: str, scopes: list) -> str:
        """What a name is where it is used, from the inside out; bodies don't see the names of the classes around them."""
        for table, kind, _, _ in reversed(scopes):
            if kind == "class" or name not in table.get_identifiers():
                continue
            found = table.lookup(name)
            for holds, what in ((found.is_imported(), "imported"), (found.is_parameter(), "parameter"), (found.is_local(), "module" if kind == "module" else "local")):
                if holds:
                    return what
        return "builtin" if hasattr(builtins, name) else "unknown"

    def _judge(self, call: ast.Call, scopes: list) -> tuple:
        """(reason, target, kind, module, imported, attribute); calls through an import are left to the joins."""
        f = call.func
        if isinstance(f, ast.Name):
            what = self._binding(f.id, scopes)
            if what == "imported" and f.id in self.locals:
                return "import", None, "function", *self.locals[f.id], None
            if what == "module" and f.id in self.taken:
                own = self.taken[f.id]
                return "module-level-definition", own["id"], "constructor" if own["kind"] == "class" else "function", None, None, None
            plain = {"parameter": "parameter-invocation", "local": "local-binding", "builtin": "builtin"}
            return plain.get(what, "no-binding-for-callee"), None, "function", None, None, None
        if isinstance(f, ast.Attribute):
            name = f.value.id if isinstance(f.value, ast.Name) else None
            if name is not None and name == scopes[-1][3]:
                own = self.taken.get(f"{scopes[-2][2]}.{f.attr}")
                return "self-method" if own else "self-attribute-not-defined-in-class", own and own["id"], "method", None, None, None
            if name is not None and name in self.locals and self._binding(name, scopes) == "imported":
                return "import", None, "method", *self.locals[name], f.attr
            return "attribute-on-unknown-receiver", None, "method", None, None, None
        return "dynamic-call-result" if isinstance(f, ast.Call) else "computed-callee", None, "unknown", None, None, None

    def call_rows(self) -> list[dict]:
        names = ("reason", "target", "kind", "module", "imported", "attribute")
        out = []
        for call, scopes in self.calls:
            caller = next((q for _, kind, q, _ in reversed(scopes) if kind == "function"), None)
            head = {"id": f"{self.path}:{call.lineno}:{call.col_offset}", "caller": caller and f"{self.path}#{caller}", "callee": _dotted(call.func)}
            out.append(head | dict(zip(names, self._judge(call, scopes))))
        return out


#: The lists that ``analysed`` makes.
_LISTS = {"symbols": _SYMBOL, "imports": _IMPORT, "calls": _CALL}


def _listed(lists: list[list[dict]], kind: pa.DataType) -> pa.Array:
    """Lists of structs, a field at a time."""
    flat, fields = [r for rows in lists for r in rows], list(kind.value_type)
    values = pa.StructArray.from_arrays([pa.array([r[f.name] for r in flat], f.type) for f in fields], fields=fields)
    offsets = pa.array([0, *itertools.accumulate(map(len, lists))], pa.int32())
    return pa.ListArray.from_arrays(offsets, values, type=kind)


def analysed(files: DataFrame, wanted: Collection[str] = tuple(_LISTS)) -> DataFrame:
    """(path, module, error, and those of symbols, imports and calls that are ``wanted``) of files (path, text); one that doesn't parse has its error and empty lists."""
    lists = [name for name in _LISTS if name in wanted]
    schema = f"path string, module string, error string{''.join(f', {name} array<{_LISTS[name]}>' for name in lists)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kind)
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            paths, modules, errors, made = batch.column(0).to_pylist(), [], [], {name: [] for name in lists}
            for path, text in zip(paths, batch.column(1).to_pylist()):
                row, error = dict.fromkeys(lists, ()), None
                try:
                    found = _File(path or "", text or "")
                    every = {"symbols": lambda: found.symbols, "imports": lambda: found.imports, "calls": found.call_rows}
                    row = {name: every[name]() for name in lists}
                except (SyntaxError, ValueError, RecursionError) as e:
                    error = f"{type(e).__name__}: {e}"
                modules.append(".".join(_package(path or "")[0]))
                errors.append(error)
                for name in lists:
                    made[name].append(row[name])
            columns = [pa.array(x, pa.string()) for x in (paths, modules, errors)] + [_listed(made[name], target.field(name).type) for name in lists]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    kind = files.sparkSession.createDataFrame([], schema).schema
    return files.select("path", "text").mapInArrow(run, kind)


def symbols(parsed: DataFrame) -> DataFrame:
    """(file, and the fields of a symbol), a row each."""
    return parsed.select(F.col("path").alias("file"), F.explode("symbols").alias("s")).select("file", "s.*")


def _homes(each: DataFrame, parsed: DataFrame) -> DataFrame:
    """``each`` (module, ...) with ``resolved``: the only file that has the module as a dotted suffix."""
    return each.join(unique_suffixes(parsed.where("module <> ''").select("path", "module")), F.col("module") == F.col("suffix"), "left").drop("suffix")


def imports(parsed: DataFrame) -> DataFrame:
    """(file, ordinal, module, resolved, line, bindings): a module resolves to the only file that has it as a dotted suffix."""
    each = parsed.select(F.col("path").alias("file"), F.explode("imports").alias("i")).select("file", "i.*")
    return _homes(each, parsed).select("file", "ordinal", "module", "resolved", "line", "bindings")


def calls(parsed: DataFrame) -> DataFrame:
    """(id, file, caller, callee, target, reason, confidence, kind, external): imported names are looked up in the file they come from.

    Only calls through an import meet other files.
    """
    each = parsed.select(F.col("path").alias("file"), F.explode("calls").alias("c")).select("file", "c.*")
    through = F.col("reason") == "import"
    own = symbols(parsed).where(~F.col("id").rlike(r"~\d+$")).select(F.col("file").alias("_f"), F.col("qualified_name").alias("_q"), F.col("id").alias("_id"), F.col("kind").alias("_kind"))
    wanted = F.when(F.col("imported").isNull(), F.col("attribute")).otherwise(F.concat_ws(".", "imported", "attribute"))
    homed = _homes(each.where(through), parsed).withColumnRenamed("resolved", "_home")
    joined = homed.join(own, (F.col("_home") == F.col("_f")) & (wanted == F.col("_q")), "left")
    joined = joined.unionByName(each.where(~through), allowMissingColumns=True)
    found = F.when(F.col("imported").isNull(), "imported-module-attribute").when(F.col("attribute").isNotNull(), "imported-class-member").otherwise("import-of-analysed-definition")
    reason = F.when(~through, F.col("reason")).when(F.col("_home").isNull(), "external-module").when(F.col("_id").isNull(), "imported-name-not-defined-in-target").otherwise(found)
    out = joined.withColumn("_reason", reason).withColumn("_target", F.coalesce("target", "_id"))
    confidence = F.when(F.col("_reason").isin("builtin", "external-module", "self-method", "imported-class-member"), "medium").when(F.col("_target").isNotNull(), "high").otherwise("low")
    kind = F.when(F.col("_kind") == "class", "constructor").when(F.col("_id").isNotNull(), "function").otherwise(F.col("kind"))
    external = F.when(F.col("_reason") == "external-module", F.substring_index("module", ".", 1)).when(F.col("_reason") == "builtin", "builtins")
    return out.select("id", "file", "caller", "callee", F.col("_target").alias("target"), F.col("_reason").alias("reason"), confidence.alias("confidence"), kind.alias("kind"), external.alias("external"))
