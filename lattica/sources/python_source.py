"""Python source to symbols, relations, statements and control flow, file by file in Arrow batches.

``EXTRACTORS`` names an extractor for each language; more can be registered."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import PropertyGraph, as_edges, as_nodes
from lattica.plans.packed import BATCH_ROWS, arrow, record_batch

_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def _callee(call: ast.Call) -> str:
    f = call.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""


def symbols(path: str, source: str) -> Iterator[tuple]:
    """Rows (kind, a, b, name, type, start, end): nodes with id and owner, and relations
    between an id and a name. A file that does not parse gives its module alone."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        tree = ast.Module([], [])
    yield "node", path, None, path.rsplit("/", 1)[-1], "module", 1, source.count("\n") + 1

    out: list[tuple] = []

    def walk(node: ast.AST, owner: str) -> None:
        for child in _children(node):
            if isinstance(child, (*_FUNCTION, ast.ClassDef)):
                own = f"{owner}::{child.name}"
                out.append(("node", own, owner, child.name, "class" if isinstance(child, ast.ClassDef) else "function", child.lineno, child.end_lineno))
                out.append(("contains", owner, own, None, None, child.lineno, None))
                for base in getattr(child, "bases", ()):
                    out.append(("extends", own, None, ast.unparse(base).split(".")[-1], None, child.lineno, None))
                for mark in child.decorator_list:
                    out.append(("annotatedwith", own, None, ast.unparse(mark).split("(")[0], None, child.lineno, None))
                walk(child, own)
                continue
            if isinstance(child, ast.Call) and _callee(child):
                out.append(("calls", owner, None, _callee(child), None, child.lineno, None))
            if isinstance(child, ast.Import | ast.ImportFrom):
                for name in child.names:
                    whole = ".".join(x for x in (getattr(child, "module", None), name.name) if x)
                    out.append(("imports", owner, None, whole, None, child.lineno, None))
            walk(child, owner)

    walk(tree, path)
    yield from out


def _children(node: ast.AST) -> list[ast.AST]:
    """Child nodes in the order of their fields, without marks that hold nothing."""
    found = []
    for field in node._fields:
        value = getattr(node, field, None)
        if isinstance(value, list):
            found += [x for x in value if isinstance(x, ast.AST)]
        elif isinstance(value, ast.AST) and value._fields:
            found.append(value)
    return found


def _names(nodes: list[ast.AST]) -> tuple[list[str], list[str]]:
    """Names that are stored to, and names that are read."""
    stored, read, stack = set(), set(), list(nodes)
    while stack:
        node = stack.pop()
        if isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Store):
                stored.add(node.id)
            elif isinstance(node.ctx, ast.Load):
                read.add(node.id)
        elif node is not None:
            stack += _children(node)
    return sorted(stored), sorted(read)


def _functions(tree: ast.AST) -> Iterator[ast.AST]:
    """Functions at any depth; only statements, handlers and cases can hold them."""
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, _FUNCTION):
            yield node
        for field in ("body", "orelse", "finalbody", "handlers", "cases"):
            held = getattr(node, field, None)
            if isinstance(held, list):
                stack += held


def _head(s: ast.stmt) -> list[ast.AST]:
    """What a statement itself reads and writes, without the statements inside it."""
    parts = {ast.If: ("test",), ast.While: ("test",), ast.For: ("target", "iter"), ast.AsyncFor: ("target", "iter"), ast.With: ("items",), ast.AsyncWith: ("items",), ast.Try: ()}
    if isinstance(s, (*_FUNCTION, ast.ClassDef)):
        return []
    for kind, names in parts.items():
        if isinstance(s, kind):
            own = [getattr(s, n) for n in names]
            return [x for v in own for x in (v if isinstance(v, list) else [v])]
    return [s]


def flow(path: str, source: str) -> Iterator[tuple]:
    """Rows (fn, line, next, defs, uses) of each function's statements: a row for each way on;
    0 is the entry and -1 the exit. Exceptions are taken to leave from the start of a try."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    for node in _functions(tree):
        ways: set[tuple[int, int]] = set()
        known: dict[int, tuple[list[str], list[str]]] = {0: (sorted(a.arg for a in node.args.args), [])}

        def block(body: list[ast.stmt], come: set[int], top: int, out: set[int], ways=ways, known=known) -> set[int]:
            for s in body:
                ways |= {(x, s.lineno) for x in come}
                defs, uses = _names(_head(s))
                if isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
                    uses = sorted({*uses, s.target.id})
                known[s.lineno] = (defs, uses)
                come = {s.lineno}
                if isinstance(s, ast.Return | ast.Raise):
                    ways.add((s.lineno, -1))
                    return set()
                if isinstance(s, ast.Break):
                    out.add(s.lineno)
                    return set()
                if isinstance(s, ast.Continue):
                    ways.add((s.lineno, top))
                    return set()
                if isinstance(s, ast.If):
                    come = block(s.body, {s.lineno}, top, out) | block(s.orelse, {s.lineno}, top, out)
                elif isinstance(s, ast.For | ast.AsyncFor | ast.While):
                    left: set[int] = set()
                    ways |= {(x, s.lineno) for x in block(s.body, {s.lineno}, s.lineno, left)}
                    come = block(s.orelse, {s.lineno}, top, out) | left
                elif isinstance(s, ast.With | ast.AsyncWith):
                    come = block(s.body, come, top, out)
                elif isinstance(s, ast.Try):
                    caught = [block(h.body, {s.lineno}, top, out) for h in s.handlers]
                    come = block(s.finalbody, block(s.orelse, block(s.body, {s.lineno}, top, out), top, out).union(*caught), top, out)
            return come

        ways |= {(x, -1) for x in block(node.body, {0}, 0, set())}
        for a, b in sorted(ways):
            yield f"{path}::{node.name}", a, b, *known[a]


_SYMBOLS = "kind string, a string, b string, name string, type string, start int, end int"
_FLOW = "fn string, line bigint, next bigint, defs array<string>, uses array<string>"

#: By language: from path and text to the rows of symbols().
EXTRACTORS: dict[str, Callable[[str, str], Iterator[tuple]]] = {"python": symbols}


def register(language: str, extractor: Callable[[str, str], Iterator[tuple]]) -> None:
    EXTRACTORS[language] = extractor


def _mapped(files: DataFrame, run: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    kind = arrow(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += run(path, text or "")
                if len(rows) >= BATCH_ROWS:
                    yield record_batch(rows, kind)
                    rows = []
            yield record_batch(rows, kind)

    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(each, schema)


def extract(files: DataFrame, language: str = "python") -> PropertyGraph:
    """The graph of files (path, content). Calls and bases go to the one symbol of their name
    in the file, else to the only one anywhere; others are left out."""
    rows = _mapped(files, EXTRACTORS[language], _SYMBOLS).persist()
    nodes = rows.filter("kind = 'node'")
    file = lambda c: F.element_at(F.split(c, "::"), 1)
    by_name = nodes.filter("type <> 'module'").select(F.col("a").alias("id"), "name", "type", file("a").alias("file"))
    near = by_name.groupBy("name", "file").agg(F.min("id").alias("near"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    sole = by_name.groupBy("name").agg(F.min("id").alias("sole"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    asked = rows.filter("kind IN ('calls', 'extends')").withColumn("file", file("a")).join(near, ["name", "file"], "left").join(sole, "name", "left")
    ends = asked.select(F.col("a").alias("src"), F.coalesce("near", "sole").alias("dst"), F.col("kind").alias("edge_type")).filter("dst IS NOT NULL")
    inside = rows.filter("kind = 'contains'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("kind").alias("edge_type"))
    shaped = nodes.select(F.col("a").alias("id"), F.col("type").alias("node_type"), "name", F.col("a").alias("qualified_name"), file("a").alias("file_path"), F.col("start").alias("start_line"), F.col("end").alias("end_line"))
    return PropertyGraph(as_nodes(shaped), as_edges(ends.union(inside)))


def control_flow(files: DataFrame) -> DataFrame:
    """(fn, line, next, defs, uses); see flow()."""
    return _mapped(files, flow, _FLOW)
