"""Structured verbs: find, relations, callers, callees, inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.graph import NODE_TYPES, PropertyGraph
from lattica.plans.iterate import reach

#: Edge types by which a type holds its members.
CONTAINS = "contains"


class AmbiguousSymbol(LookupError):
    """A name that stands for several nodes; ``candidates`` has up to 50 ids."""

    def __init__(self, name: str, candidates: list[str]):
        super().__init__(f"{name} stands for {len(candidates)} or more nodes")
        self.candidates = candidates


def name_matches(pattern: str) -> Column:
    """By id, or by name, exactly or as a glob; never by qualified name."""
    return (F.col("id") == pattern) | T.glob(F.col("name"), pattern)


def node_filter(*, node_type=None, file=None, lang=None, scope=None, klass=None, line=None) -> Column:
    """All given conditions on a node."""
    tests = [F.lit(True)]
    if node_type:
        tests.append(F.col("node_type") == node_type.lower())
    if file:
        tests.append(F.coalesce(T.file_glob(F.col("file_path"), file), F.lit(False)))
    if lang:
        tests.append(F.coalesce(T.language(F.col("file_path"), F.col("properties")) == lang.lower(), F.lit(False)))
    if scope:
        tests.append(T.in_scope(F.col("qualified_name"), F.col("file_path"), scope))
    if klass:
        held = F.col("qualified_name").contains(klass) | (F.col("properties")["class"] == klass) | (F.col("properties")["enclosing_type"] == klass)
        tests.append(F.coalesce(held, F.lit(False)))
    if line is not None:
        tests.append((F.col("start_line") <= line) & (F.col("end_line") >= line))
    return reduce(Column.__and__, tests)


def find(graph: PropertyGraph, pattern: str | None = None, limit: int | None = None, **filters) -> DataFrame:
    """Nodes by name and filters, in the order of ids when limited."""
    df = graph.nodes.filter(node_filter(**filters))
    if pattern:
        df = df.filter(name_matches(pattern))
    df = df.select("id", "node_type", "name", "qualified_name", "file_path", "start_line", "end_line")
    return df.orderBy("id").limit(limit) if limit is not None else df


def resolve(graph: PropertyGraph, name: str, scope: str | None = None, **filters) -> str:
    """The one node of a name; of several, the one inside the scope."""
    rows = find(graph, name, 51, **filters).collect()
    if len(rows) > 1 and scope:
        inside = graph.nodes.filter(F.col("id").isin([r["id"] for r in rows])).filter(T.in_scope(F.col("qualified_name"), F.col("file_path"), scope)).collect()
        rows = inside if len(inside) == 1 else rows
    if not rows:
        raise LookupError(f"no node is called {name}")
    if len(rows) > 1:
        raise AmbiguousSymbol(name, [r["id"] for r in rows[:50]])
    return rows[0]["id"]


def suggestions(graph: PropertyGraph, name: str, top: int = 5) -> DataFrame:
    """Names that hold the given one or are held by it, nearest in length first."""
    n = F.lower("name")
    near = graph.nodes.filter(n.contains(name.lower()) | F.lit(name.lower()).contains(n)).select("name").distinct()
    return near.withColumn("gap", F.abs(F.length("name") - len(name)).cast("bigint")).orderBy("gap", "name").limit(top)


def compound(text: str) -> Column:
    """``key:value`` clauses joined by ``|`` (all must hold); a bare word is a name."""
    columns = {"type": "node_type", "name": "name", "return_type": "return_type"}

    def clause(c: str) -> Column:
        key, sep, value = c.strip().partition(":")
        if not sep:
            return F.lit(True) if key == "all" else F.col("node_type") == key[:-1] if key[:-1] in NODE_TYPES and key.endswith("s") else F.col("name") == key
        if key in columns:
            return F.col(columns[key]) == (value.lower() if key == "type" else value)
        if key == "label":
            return F.array_contains("labels", value)
        if key == "name_suffix":
            return F.col("name").endswith(value)
        if key == "signature":
            return T.glob(F.col("signature"), value) if "*" in value else F.col("signature").contains(value)
        if key in ("module", "resource", "repo"):
            return F.col("properties")[key] == value
        return F.col("name") == c.strip()

    return reduce(Column.__and__, [F.coalesce(clause(c), F.lit(False)) for c in text.split("|")])


def relations(graph: PropertyGraph, edge_type: str, direction: str = "out") -> DataFrame:
    """Distinct (source, target) with how often each edge is stored; ``in`` swaps them."""
    e = graph.edges_of(edge_type).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("occurrences"))
    a, b = ("dst", "src") if direction == "in" else ("src", "dst")
    e = e.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), "occurrences")
    n = graph.nodes.select("id", "name")
    out = e.join(n.toDF("source_id", "source_name"), "source_id").join(n.toDF("target_id", "target_name"), "target_id")
    return out.select("source_id", "source_name", "target_id", "target_name", "occurrences")


def seeded_relations(graph: PropertyGraph, seeds: DataFrame, edge_type: str, depth: int, keep: Column | None = None) -> DataFrame:
    """Walk from ``seeds`` (id): (source_id, target_id, hops, occurrences). ``keep``, a
    condition on nodes, prunes the walk itself: what fails it is not passed through."""
    e = graph.edges_of(edge_type)
    if keep is not None:
        e = e.join(graph.nodes.filter(keep).select(F.col("id").alias("dst")), "dst", "left_semi")
    e = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("occurrences"))
    at = reach(e, seeds, depth - 1)
    return e.join(at, e["src"] == at["id"]).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), (F.col("hops") + 1).alias("hops"), "occurrences")


def callers(graph: PropertyGraph, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(id, name, hops) of what calls the seeds within ``depth`` hops. A type stands for
    its members; what injects a seed counts as calling it."""
    e = graph.edges_of("calls", "injects").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _neighbours(graph, e, seeds, depth)


def callees(graph: PropertyGraph, seeds: DataFrame, depth: int = 1) -> DataFrame:
    return _neighbours(graph, graph.edges_of("calls").select("src", "dst"), seeds, depth)


def _neighbours(graph: PropertyGraph, edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    members = graph.edges_of(CONTAINS).join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    at = reach(edges, seeds.select("id").union(members), depth).filter("hops > 0")
    return at.join(graph.nodes.select("id", "name"), "id").select("id", "name", "hops")


def inventory(graph: PropertyGraph, by: str) -> DataFrame:
    """Counts by ``type`` (all types, also those without nodes), ``lang``, ``file``,
    ``community`` or ``import_prefix``; (bucket, n)."""
    nodes = graph.nodes
    if by == "type":
        every = graph.spark.createDataFrame([(t,) for t in NODE_TYPES], "bucket string")
        some = nodes.groupBy(F.col("node_type").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        return every.join(some, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    if by == "import_prefix":
        nodes = nodes.filter("node_type = 'import'").filter(F.coalesce(T.language(F.col("file_path"), F.col("properties")), F.lit("")) != "markdown")
    key = {
        "lang": T.language(F.col("file_path"), F.col("properties")),
        "file": F.coalesce("file_path", F.lit("<unknown>")),
        "community": F.coalesce(F.col("properties")["community_id"], F.lit("<none>")),
        "import_prefix": T.import_prefix(F.col("name")),
    }[by]
    return nodes.select(key.alias("bucket")).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def edge_inventory(graph: PropertyGraph) -> DataFrame:
    """By edge type: distinct ends, and stored edges."""
    pairs = graph.edges.groupBy("edge_type", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("edge_type").agg(F.count(F.lit(1)).alias("distinct_edges"), F.sum("n").alias("occurrences"))


def annotated(graph: PropertyGraph, names: list[str]) -> DataFrame:
    """Nodes that carry any of the annotations, with the names that matched."""
    want = [n.strip("@#[] ").split("(")[0].split(".")[-1] for n in names]
    plain = F.regexp_replace(F.regexp_replace("name", r"^[@#\[\s]+|[\]\s]+$", ""), r"\(.*", "")
    notes = graph.nodes.filter("node_type = 'annotation'").select(F.col("id").alias("dst"), F.element_at(F.split(plain, r"[.]|::"), -1).alias("note")).filter(F.col("note").isin(want))
    return graph.edges_of("annotatedwith").join(notes, "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("note")), ",").alias("notes"))


def export_subgraph(graph: PropertyGraph, seeds: DataFrame, depth: int, types: tuple[str, ...] = ("calls", "contains", "uses")) -> PropertyGraph:
    """What is within ``depth`` undirected hops of the seeds, with the edges among it."""
    e = graph.edges_of(*types).select("src", "dst")
    ids = reach(e.union(e.select("dst", "src")), seeds, depth).select("id")
    nodes = graph.nodes.join(ids, "id", "left_semi")
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return PropertyGraph(nodes, edges)


def scoped_edges(graph: PropertyGraph, scope: str, mode: str = "inside") -> DataFrame:
    """Edges by where their ends are: ``inside`` and ``outside`` go by the source, ``crossing``
    takes those with one end inside."""
    own = graph.nodes.select("id", T.in_scope(F.col("qualified_name"), F.col("file_path"), scope).alias("within"))
    met = graph.edges.join(own.toDF("src", "s"), "src").join(own.toDF("dst", "d"), "dst")
    keep = {"inside": F.col("s"), "outside": ~F.col("s"), "crossing": F.col("s") != F.col("d")}[mode]
    return met.filter(keep).select("src", "dst", "edge_type")


def members(graph: PropertyGraph) -> DataFrame:
    """(type, id): functions of container types, by the owner part of their qualified names."""
    types = graph.nodes.filter(F.col("node_type").isin("class", "interface", "struct", "enum", "module")).filter("qualified_name IS NOT NULL")
    own = graph.nodes.filter("node_type = 'function'").select("id", T.owner(F.col("qualified_name")).alias("qualified_name"))
    return own.join(types.select(F.col("id").alias("type"), "qualified_name"), "qualified_name").select("type", "id")


def multi_callers(graph: PropertyGraph, seeds: DataFrame, each: int = 50) -> DataFrame:
    """(id, seed): direct callers of several seeds (id, place), ``each`` a seed at most and every
    caller once, for the seed that comes first."""
    calls = graph.edges_of("calls", "injects").select(F.col("src").alias("caller"), F.col("dst").alias("id")).distinct()
    met = calls.join(seeds, "id").select("caller", F.col("id").alias("seed"), "place")
    some = met.withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy("caller"))).filter(F.col("k") <= each)
    return some.groupBy(F.col("caller").alias("id")).agg(F.min_by("seed", F.struct("place", "seed")).alias("seed"))


def bucket_prefix(counts: DataFrame, prefix: str, limit: int) -> DataFrame:
    """The first ``limit`` inventory rows (bucket, n) with a prefix, largest first."""
    return counts.filter(F.col("bucket").startswith(prefix)).orderBy(F.desc("n"), "bucket").limit(limit)


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    """One JSON object a row, of the columns that may be shown."""
    return rows.select(F.to_json(F.struct(*columns)).alias("cell"))


def field_writes(writes: DataFrame, receiver: str, member: str | None = None, constructors: bool = False) -> DataFrame:
    """``writes`` (site, receiver_type, member, in_constructor) to fields of a type, whose name
    may be qualified; those in constructors only if asked for."""
    own = F.element_at(F.split("receiver_type", r"[.:\\]+"), -1) == receiver
    keep = own if member is None else own & (F.col("member") == member)
    return writes.filter(keep if constructors else keep & ~F.col("in_constructor"))


def semantic_scope(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of ranked hits (id, rank), functions and the headings and code blocks of modules."""
    ok = (F.col("node_type") == "function") | ((F.col("node_type") == "module") & F.col("properties")["kind"].isin("heading", "code_block"))
    return hits.join(nodes.filter(F.coalesce(ok, F.lit(False))).select("id"), "id", "left_semi")
