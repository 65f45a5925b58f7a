"""Python source to symbols, chunks, edges, call sites and references, by the standard parser.

Languages with braces go through ``languages``, what is left through the generic text source.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FILE_BYTES = 2 << 20
_SYMBOL = "path string, name string, scope_path string, symbol_type string, language string, start_line int, end_line int, signature string, docstring string"


class _Walk(ast.NodeVisitor):
    """Keeps the scope while it walks, and the types that names are known to have."""

    def __init__(self, path: str, text: str):
        self.path, self.lines = path, text.splitlines()
        self.scope: list[str] = []
        self.types: list[dict[str, str]] = [{}]
        self.symbols: list[tuple] = []
        self.edges: list[tuple] = []
        self.calls: list[tuple] = []

    def _define(self, node: ast.AST, kind: str) -> None:
        scope = " > ".join([*self.scope, node.name])
        head = self.lines[node.lineno - 1].strip()
        self.symbols.append((self.path, node.name, scope, kind, "python", node.lineno, node.end_lineno, head, ast.get_docstring(node)))
        self.edges.append((" > ".join(self.scope) or self.path, scope, "defines", 1.0))
        for d in node.decorator_list:
            self.edges.append((ast.unparse(d).split("(")[0], scope, "decorates", 0.85))

    def _inside(self, node: ast.AST, names: dict[str, str]) -> None:
        self.scope.append(node.name)
        self.types.append(names)
        self.generic_visit(node)
        self.types.pop()
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node, "class")
        for base in node.bases:
            self.edges.append((" > ".join([*self.scope, node.name]), ast.unparse(base), "inherits", 0.9))
        self._inside(node, {"self": node.name, "cls": node.name})

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._define(node, "method" if self.types[-1].get("self") else "function")
        names = {a.arg: ast.unparse(a.annotation) for a in node.args.args if a.annotation}
        self._inside(node, {k: v for k, v in self.types[-1].items() if k in ("self", "cls")} | names)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node: ast.Assign) -> None:
        if isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name) and node.value.func.id[:1].isupper():
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self.types[-1][t.id] = node.value.func.id
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        self.edges += [(self.path, a.name, "imports", 0.6) for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.edges += [(self.path, f"{module}.{a.name}", "imports", 0.6) for a in node.names]

    def visit_Call(self, node: ast.Call) -> None:
        receiver, callee = None, ast.unparse(node.func)
        if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name):
            name = node.func.value.id
            receiver = next((t[name] for t in reversed(self.types) if name in t), name)
        self.calls.append((" > ".join(self.scope) or self.path, self.path, receiver, callee, node.lineno))
        self.generic_visit(node)


def _walked(path: str, text: str | None) -> _Walk | None:
    if not text or len(text.encode()) > MAX_FILE_BYTES:
        return None
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return None
    walk = _Walk(path, text)
    walk.visit(tree)
    return walk


SCHEMA = f"kind string, {_SYMBOL}, src string, dst string, edge_type string, weight double, caller string, receiver string, callee string, line int"


def rows_of(path: str, symbols: list[tuple], edges: list[tuple], calls: list[tuple]) -> list[dict]:
    """Rows of SCHEMA of one file."""
    names = [c.split()[0] for c in _SYMBOL.split(", ")]
    rows = [{"kind": "symbol", **dict(zip(names, s, strict=True))} for s in symbols]
    rows += [{"kind": "edge", "path": path, "src": a, "dst": b, "edge_type": t, "weight": w} for a, b, t, w in edges]
    return rows + [{"kind": "call", "path": p, "caller": c, "receiver": r, "callee": e, "line": n} for c, p, r, e, n in calls]


def parse(files: DataFrame) -> DataFrame:
    """kind (symbol, edge, call) and the columns of each, of Python files (path, text). What doesn't parse, and
    files beyond MAX_FILE_BYTES, give nothing."""
    schema = SCHEMA
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                walk = _walked(path, text)
                if walk:
                    rows += rows_of(path, walk.symbols, walk.edges, walk.calls)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return files.select("path", "text").mapInArrow(run, schema)


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'symbol'").select(*[c.split()[0] for c in _SYMBOL.split(", ")])


def edges(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'edge'").select("src", "dst", "edge_type", F.lit("structural").alias("class"), "weight").distinct()


def calls(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'call'").select("caller", F.col("path").alias("caller_path"), "receiver", "callee", "line")


def code_chunks(files: DataFrame, found: DataFrame, most: int = 4096) -> DataFrame:
    """path, chunk_index, text: a chunk for each symbol that holds no other, headed by scope, language and file,
    in parts of ``most`` characters if it is longer."""
    inner = found.alias("i")
    outer = found.alias("o")
    holds = outer.join(inner, (F.col("o.path") == F.col("i.path")) & F.col("i.scope_path").startswith(F.concat("o.scope_path", F.lit(" > "))), "left_anti")
    body = holds.select("o.*").join(files.select("path", "text"), "path")
    text = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("code") - 1) / most).cast("int")), lambda k: F.substring("code", k * most + 1, F.lit(most)))
    head = F.concat(F.lit("Scope: "), "scope_path", F.lit("\nLanguage: "), "language", F.lit("\nFile: "), "path", F.lit("\n"))
    each = body.withColumn("code", text).select("path", "scope_path", "start_line", head.alias("head"), F.posexplode(parts).alias("part", "code"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("path").orderBy("start_line", "scope_path", "part")) - 1
    return each.select("path", place.alias("chunk_index"), F.concat("head", "code").alias("text"))
