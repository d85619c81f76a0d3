"""Graphs over the supplied tables. Ids are ``<kind>:<key>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.graph import PropertyGraph, as_edges, as_nodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions, with names, paths and complexity derived from their columns."""
    p = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".rs", ".py", ".java", ".go", ".ts")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    path = F.concat(F.lower("p_type"), F.lit("/"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), ext)
    return as_nodes(
        p.select(
            _id("part", "p_partkey").alias("id"),
            F.lit("function").alias("node_type"),
            F.col("p_name").alias("name"),
            F.concat_ws(".", "p_type", "p_brand", F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string"))).alias("qualified_name"),
            F.concat_ws("|", "p_name", "p_type").alias("code_hash"),
            path.alias("file_path"),
            F.lit(1).alias("start_line"),
            F.col("p_size").alias("end_line"),
            F.create_map(F.lit("cyclomatic"), F.col("p_size").cast("string")).alias("properties"),
        )
    )


def entity_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts and orders; contains and references."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "orders", "lineitem")}
    kinds = [
        ("region", "region", "r_regionkey", "module", "r_name"),
        ("nation", "nation", "n_nationkey", "module", "n_name"),
        ("customer", "customer", "c_custkey", "class", "c_name"),
        ("supplier", "supplier", "s_suppkey", "interface", "s_name"),
    ]
    nodes = part_nodes(spark, sf_dir)
    for kind, source, key, node_type, name in kinds:
        nodes = nodes.unionByName(as_nodes(t[source].select(_id(kind, key).alias("id"), F.lit(node_type).alias("node_type"), F.col(name).alias("name"))))
    orders = t["orders"].select(_id("order", "o_orderkey").alias("id"), F.lit("file").alias("node_type"), F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("name"))
    nodes = nodes.unionByName(as_nodes(orders))

    def edge(df: DataFrame, src: tuple[str, str], dst: tuple[str, str], kind: str) -> DataFrame:
        return as_edges(df.select(_id(*src).alias("src"), _id(*dst).alias("dst"), F.lit(kind).alias("edge_type")))

    edges = edge(t["nation"], ("region", "n_regionkey"), ("nation", "n_nationkey"), "contains")
    for df, src, dst, kind in (
        (t["customer"], ("nation", "c_nationkey"), ("customer", "c_custkey"), "contains"),
        (t["supplier"], ("nation", "s_nationkey"), ("supplier", "s_suppkey"), "contains"),
        (t["orders"], ("order", "o_orderkey"), ("customer", "o_custkey"), "references"),
        (t["lineitem"], ("order", "l_orderkey"), ("part", "l_partkey"), "uses"),
        (t["lineitem"].select("l_partkey", "l_suppkey").distinct(), ("part", "l_partkey"), ("supplier", "l_suppkey"), "dependson"),
    ):
        edges = edges.unionByName(edge(df, src, dst, kind))
    return PropertyGraph(nodes, edges)


def part_sequence(lineitem: DataFrame) -> DataFrame:
    """(s, t, f, q): each part of an order and the next one in the order's total order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lineitem.select(F.col("l_partkey").alias("s"), F.lead("l_partkey").over(w).alias("t"), F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q"), "l_orderkey")


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense call multigraph between parts, (s, t)."""
    return part_sequence(table(spark, sf_dir, "lineitem")).filter("t IS NOT NULL").select("s", "t")


def sparse_calls(lineitem: DataFrame) -> DataFrame:
    return part_sequence(lineitem).filter("t IS NOT NULL AND f = 'R' AND q >= 40").select("s", "t").distinct()


def part_calls_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse call graph between parts, (s, t), without parallel edges."""
    return sparse_calls(table(spark, sf_dir, "lineitem"))


def call_graph(spark: SparkSession, sf_dir: str, sparse: bool = True) -> PropertyGraph:
    calls = (part_calls_sparse if sparse else part_calls)(spark, sf_dir)
    edges = calls.select(_id("part", "s").alias("src"), _id("part", "t").alias("dst"), F.lit("calls").alias("edge_type"))
    return PropertyGraph(part_nodes(spark, sf_dir), as_edges(edges))


def event_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Users and event types, an edge for each event."""
    e = table(spark, sf_dir, "events")
    users = e.select(_id("user", "user_id").alias("id"), F.lit("class").alias("node_type"), F.col("user_id").cast("string").alias("name")).distinct()
    kinds = e.select(_id("event", "event_type").alias("id"), F.lit("module").alias("node_type"), F.col("event_type").alias("name")).distinct()
    edges = e.select(_id("user", "user_id").alias("src"), _id("event", "event_type").alias("dst"), F.lit("uses").alias("edge_type"))
    return PropertyGraph(as_nodes(users.unionByName(kinds)), as_edges(edges))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, target) for every link of every page."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, ts, file, added, deleted): orders as commits, parts as files."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"), F.col("l_partkey").alias("file")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("added"), F.sum("l_linenumber").alias("deleted")
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sparse call graph of most orders, before and after some of them change."""
    li = table(spark, sf_dir, "lineitem")
    return sparse_calls(li.filter("l_orderkey % 10 <> 0")), sparse_calls(li.filter("l_orderkey % 10 <> 1"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text): lines of documents as statements."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("bigint"))
