"""A small pattern-matching language, compiled to DataFrames.

    MATCH pattern+ [WHERE v.key = 'x' [AND ...]] RETURN v, w [LIMIT n]
    pattern = (v[:Type][{key: 'x', ...}]) (-[:EDGE[*|*a..b]]-> (...))*

Predicates are ``=`` and ``LIKE``, joined by AND. LIKE knows one star, leading or trailing; a
leading one is looked at first. ``*`` alone on an edge means 1 to 10 hops. A hop follows
distinct edges; a variable-length hop gives each end once for every depth at which it can be
reached. A variable that stands twice is the same node. Patterns that share no variable are
combined freely. Results have the node columns of each returned variable as ``<v>_<column>``;
unknown variables are left out. With LIMIT, rows come in the order of the ids.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.graph import PropertyGraph

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<word>[A-Za-z_]\w*)|(?P<num>\d+)|(?P<op>\.\.|->|[-(){}\[\]:,.=*]))")
MAX_STAR = 10
COLUMNS = ("id", "node_type", "name", "qualified_name", "file_path")
DIRECT = {"name", "qualified_name", "signature", "return_type", "file_path", "id"}


class GqlError(ValueError):
    """A query that is not in the language, or asks what it does not offer."""


@dataclass
class Node:
    var: str
    kind: str | None = None
    props: dict[str, str] = field(default_factory=dict)


@dataclass
class Hop:
    edge: str
    least: int
    most: int
    variable: bool


@dataclass
class Query:
    patterns: list[list[Node | Hop]]
    where: list[tuple[str, str, str, str]]
    returns: list[str]
    limit: int | None


class _Parser:
    def __init__(self, text: str):
        self.items, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise GqlError(f"unexpected character at {at}: {text[at : at + 10]!r}")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, value: str) -> bool:
        if self.at >= len(self.items):
            return False
        kind, got = self.items[self.at]
        return kind != "str" and (got.upper() if kind == "word" else got) == value

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        if self.at >= len(self.items):
            raise GqlError(f"the query ends where {value or kind} should follow")
        got_kind, got = self.items[self.at]
        if (value and not self.peek(value)) or (kind and got_kind != kind):
            raise GqlError(f"{value or kind} expected, not {got!r}")
        self.at += 1
        return got

    def maybe(self, value: str) -> bool:
        if self.peek(value):
            self.at += 1
            return True
        return False

    def text(self) -> str:
        return re.sub(r"\\(.)", r"\1", self.take(kind="str")[1:-1])

    def node(self) -> Node:
        self.take("(")
        out = Node(self.take(kind="word"))
        if self.maybe(":"):
            out.kind = self.take(kind="word")
        if self.maybe("{"):
            while not self.maybe("}"):
                key = self.take(kind="word")
                self.take(":")
                out.props[key] = self.text()
                if not self.peek("}"):
                    self.take(",")
        self.take(")")
        return out

    def hop(self) -> Hop:
        for x in ("-", "[", ":"):
            self.take(x)
        edge, least, most, variable = self.take(kind="word"), 1, 1, False
        if self.maybe("*"):
            least, most, variable = 1, MAX_STAR, True
            if not self.peek("]"):
                least = int(self.take(kind="num"))
                self.take("..")
                most = int(self.take(kind="num"))
        self.take("]")
        self.take("->")
        return Hop(edge, least, most, variable)

    def query(self) -> Query:
        self.take("MATCH")
        patterns, where, returns, limit = [], [], [], None
        while self.peek("("):
            pattern: list[Node | Hop] = [self.node()]
            while self.peek("-"):
                pattern += [self.hop(), self.node()]
            patterns.append(pattern)
        if not patterns:
            raise GqlError("MATCH without a pattern")
        if self.maybe("WHERE"):
            while True:
                var = self.take(kind="word")
                self.take(".")
                key = self.take(kind="word")
                op = "=" if self.maybe("=") else self.take("LIKE")
                where.append((var, key, op.upper(), self.text()))
                if not self.maybe("AND"):
                    break
        self.take("RETURN")
        returns.append(self.take(kind="word"))
        while self.maybe(","):
            returns.append(self.take(kind="word"))
        if self.maybe("LIMIT"):
            limit = int(self.take(kind="num"))
        if self.at < len(self.items):
            raise GqlError(f"{self.items[self.at][1]!r} after the end of the query")
        return Query(patterns, where, returns, limit)


def parse(text: str) -> Query:
    return _Parser(text).query()


#: Queries by name; register more by adding to it.
MACROS = {
    "all_functions": "MATCH (f:Function) RETURN f",
    "direct_calls": "MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a, b",
    "call_chain": "MATCH (a:Function)-[:CALLS*1..3]->(b:Function) RETURN a, b",
    "all_communities": "MATCH (c:Community) RETURN c",
}


def like(col: Column, pattern: str) -> Column:
    if pattern.startswith("*"):
        return col.endswith(pattern[1:])
    if pattern.endswith("*"):
        return col.startswith(pattern[:-1])
    return col == pattern


def _prop(var: str, key: str) -> Column:
    if key == "type":
        return F.col(f"{var}.node_type")
    if key == "label":
        return F.array_join(F.col(f"{var}.labels"), ",")
    return F.col(f"{var}.{key}") if key in DIRECT else F.col(f"{var}.properties")[key]


class _Compiler:
    def __init__(self, graph: PropertyGraph, communities: DataFrame | None):
        self.graph, self.communities = graph, communities

    def scan(self, node: Node) -> DataFrame:
        """The nodes of a pattern, as one struct column named by its variable."""
        kind = node.kind.lower() if node.kind else None
        if kind == "community":
            if self.communities is None:
                raise GqlError("there are no communities to match")
            df = self.communities
        else:
            df = self.graph.nodes if kind is None else self.graph.nodes.filter(F.col("node_type") == kind)
        df = df.select(F.struct(*[F.col(c) for c in df.columns]).alias(node.var))
        for key, value in node.props.items():
            held = F.array_contains(f"{node.var}.labels", value) if key == "label" else _prop(node.var, key) == value
            df = df.filter(held)
        return df

    def pairs(self, hop: Hop, starts: DataFrame | None) -> DataFrame:
        """(__a, __b): ends of the hop's walks, distinct at each depth."""
        edges = self.graph.edges.filter(F.col("edge_type") == hop.edge.lower()).select("src", "dst").distinct()
        if not hop.variable:
            return edges.toDF("__a", "__b")
        front = edges.toDF("__a", "__b")
        if starts is not None:
            front = front.join(starts, "__a", "left_semi")
        out = None
        for depth in range(1, hop.most + 1):
            if depth > 1:
                front = front.join(edges.toDF("__b", "__c"), "__b").select("__a", F.col("__c").alias("__b")).distinct()
            if depth >= max(hop.least, 1):
                out = front if out is None else out.unionAll(front)
        return out if out is not None else front.limit(0)

    def pattern(self, items: list[Node | Hop], bound: DataFrame | None) -> DataFrame:
        df, first = bound, items[0]
        known = set(df.columns) if df is not None else set()
        df = self._bind(df, known, first)
        for last, hop, node in zip(items[:-2:2], items[1::2], items[2::2], strict=True):
            if "community" in ((last.kind or "").lower(), (node.kind or "").lower()):
                raise GqlError("a community has no edges")
            starts = df.select(F.col(f"{last.var}.id").alias("__a")).distinct() if hop.variable else None
            pairs = self.pairs(hop, starts)
            df = df.join(pairs, F.col(f"{last.var}.id") == F.col("__a"))
            scan = self.scan(Node("__n", node.kind, node.props))
            if node.var in known:
                df = df.join(scan.select(F.col("__n.id").alias("__id")), F.col("__b") == F.col("__id")).filter(F.col("__b") == F.col(f"{node.var}.id")).drop("__id")
            else:
                df = df.join(scan.withColumnRenamed("__n", node.var), F.col("__b") == F.col(f"{node.var}.id"))
                known.add(node.var)
            df = df.drop("__a", "__b")
        return df

    def _bind(self, df: DataFrame | None, known: set[str], node: Node) -> DataFrame:
        if node.var in known:
            ids = self.scan(Node("__n", node.kind, node.props)).select(F.col("__n.id").alias("__id"))
            return df.join(ids, F.col(f"{node.var}.id") == F.col("__id")).drop("__id")
        known.add(node.var)
        scan = self.scan(node)
        return scan if df is None else df.crossJoin(scan)


def run(graph: PropertyGraph, text: str, communities: DataFrame | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The result of a query, or of a macro's name."""
    query = parse(MACROS.get(text, text))
    compiler, df = _Compiler(graph, communities), None
    for pattern in query.patterns:
        df = compiler.pattern(pattern, df)
    known = set(df.columns)
    for var, key, op, value in query.where:
        if var not in known:
            df = df.filter(F.lit(False))
        elif key == "label" and op == "=":
            df = df.filter(F.array_contains(f"{var}.labels", value))
        else:
            df = df.filter(_prop(var, key) == value if op == "=" else like(_prop(var, key), value))
    named = [v for v in query.returns if v in known]
    out = df.select(*[F.col(f"{v}.{c}").alias(f"{v}_{c}") for v in named for c in columns])
    if query.limit is not None:
        out = out.orderBy(*[f"{v}_id" for v in named]).limit(query.limit)
    return out


def explain(graph: PropertyGraph, text: str) -> list[dict]:
    """Steps with rows in and out; counts them, so this runs the query."""
    query = parse(MACROS.get(text, text))
    compiler, df, steps = _Compiler(graph, None), None, []
    for pattern in query.patterns:
        before = 0 if df is None else df.count()
        df = compiler.pattern(pattern, df)
        steps.append({"step": "match", "rows_in": before, "rows_out": df.count()})
    out = run(graph, text)
    steps.append({"step": "project", "rows_in": steps[-1]["rows_out"], "rows_out": out.count()})
    return steps
