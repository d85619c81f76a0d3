"""Changes to a graph, each a new graph: insert, delete, update, and updates from a delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.graph import PropertyGraph


def inserted(graph: PropertyGraph, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> PropertyGraph:
    """With more nodes and edges; a new node takes the place of an old one of its id."""
    old = graph.nodes if nodes is None else preferred(nodes, graph.nodes)
    return PropertyGraph(old, graph.edges if edges is None else graph.edges.unionByName(edges))


def deleted(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Without the nodes (id) and the edges at them."""
    gone = ids.select("id").distinct()
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti").select(*graph.edges.columns)
    return PropertyGraph(graph.nodes.join(gone, "id", "left_anti"), edges)


def without_files(graph: PropertyGraph, files: DataFrame) -> PropertyGraph:
    """Without the nodes of the files (file_path)."""
    return deleted(graph, graph.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id"))


def with_properties(graph: PropertyGraph, updates: DataFrame) -> PropertyGraph:
    """Properties of ``updates`` (id, properties) laid over those of the nodes; null values
    take a property away."""
    new = updates.select("id", F.col("properties").alias("__new"))
    old = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key("__new", k), F.lit(False)))
    merged = F.map_filter(F.map_concat(kept, "__new"), lambda k, v: v.isNotNull())
    nodes = graph.nodes.join(new, "id", "left").withColumn("properties", F.when(F.col("__new").isNull(), F.col("properties")).otherwise(merged))
    return PropertyGraph(nodes.select(*graph.nodes.columns), graph.edges)


def without_edges(graph: PropertyGraph, which: Column) -> PropertyGraph:
    return PropertyGraph(graph.nodes, graph.edges.filter(~F.coalesce(which, F.lit(False))))


def without_orphans(graph: PropertyGraph, node_type: str | None = None) -> PropertyGraph:
    """Without nodes (of a type, if given) that no edge touches."""
    ends = graph.edges.select(F.col("src").alias("id")).union(graph.edges.select("dst")).distinct()
    alone = graph.nodes.join(ends, "id", "left_anti")
    alone = alone if node_type is None else alone.filter(F.col("node_type") == node_type)
    return PropertyGraph(graph.nodes.join(alone.select("id"), "id", "left_anti"), graph.edges)


def preferred(delta: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both, by key; where both have one, the delta's. One row a key."""
    both = delta.withColumn("__rank", F.lit(0)).unionByName(base.withColumn("__rank", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(key).orderBy("__rank"))
    return both.withColumn("__k", first).filter("__k = 1").drop("__k", "__rank")


def merged_changes(*sets: DataFrame) -> DataFrame:
    """(path, kind): change sets in order; of a path that several name, the first one's."""
    rows = None
    for k, one in enumerate(sets):
        one = one.select("path", "kind", F.lit(k).alias("__k"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("path").agg(F.min_by("kind", F.struct("__k", "kind")).alias("kind"))


def head(base: PropertyGraph, delta: PropertyGraph, files: DataFrame) -> PropertyGraph:
    """The graph after an update: of the ``files`` (file_path) that were read again, only what
    the delta has; edges from the base into nodes that are still there stay."""
    old = base.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")
    nodes = preferred(delta.nodes, base.nodes.join(old, "id", "left_anti").select(*base.nodes.columns))
    kept = base.edges.join(old.select(F.col("id").alias("src")), "src", "left_anti").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return PropertyGraph(nodes, kept.select(*base.edges.columns).unionByName(delta.edges))


def updated(base: PropertyGraph, hashes: DataFrame, current: DataFrame, extract) -> PropertyGraph:
    """Read again what changed between two lists (path, hash) and take it into the graph.
    ``extract`` makes a graph of paths (path, hash)."""
    old, new = hashes.select("path", F.col("hash").alias("__old")), current.select("path", F.col("hash").alias("__new"))
    moved = old.join(new, "path", "full").filter(~F.col("__old").eqNullSafe(F.col("__new")))
    fresh = current.join(moved.filter("__new IS NOT NULL").select("path"), "path", "left_semi")
    return head(base, extract(fresh), moved.select(F.col("path").alias("file_path")))


def digest(nodes: DataFrame, spans: tuple[str, ...] = ("start_line", "end_line")) -> DataFrame:
    """(id, digest) of all columns but those of places in a file."""
    rest = [c for c in nodes.columns if c not in spans]
    return nodes.select("id", F.md5(F.to_json(F.struct(*[F.col(c) for c in rest])).cast("binary")).alias("digest"))


def stale(sidecar: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id) of rows of a table kept beside the graph (id, digest) that no longer stand."""
    now = digest(nodes).withColumnRenamed("digest", "__now")
    return sidecar.join(now, "id", "left").filter(~F.col("digest").eqNullSafe(F.col("__now"))).select("id")
