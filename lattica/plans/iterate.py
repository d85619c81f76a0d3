"""Loops over DataFrames, with lineage cut in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> None:
    """A checkpoint folder: the session's spark.checkpoint.dir; one for local use only where that
    is unset and the master is local."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattica-"))


def cut(df: DataFrame) -> DataFrame:
    """``df``, materialised in the checkpoint folder, without the size it was estimated at.

    A checkpoint keeps that estimate. A join multiplies those of its sides, so in a loop
    its digits double with every round until planning takes longer than running.
    """
    spark = df.sparkSession
    prepare(spark)
    made = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(made.javaRDD(), made.schema()), spark)


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, hops): least number of ``edges`` (src, dst) from ``seeds`` (id), which have 0.

    Each round joins only the newest nodes; without ``depth`` it goes on until none is new.
    """
    edges = cut(edges.select("src", "dst").distinct())
    front = cut(seeds.select("id").distinct().withColumn("hops", F.lit(0).cast("bigint")))
    found, hops = front, 0
    while depth is None or hops < depth:
        hops += 1
        step = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        front = cut(step.join(found, "id", "left_anti").withColumn("hops", F.lit(hops).cast("bigint")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def closure(edges: DataFrame, seeds: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(root, id, hops) for every seed and what it reaches, hops from 1; a root is in its
    own row only through a cycle. Meant for seeds or graphs that are few or sparse."""
    edges = cut(edges.select("src", "dst").distinct())
    roots = edges.select(F.col("src").alias("root")).distinct() if seeds is None else seeds.select(F.col("id").alias("root")).distinct()
    front = roots.join(edges, roots["root"] == edges["src"]).select("root", F.col("dst").alias("id")).distinct()
    front = cut(front.withColumn("hops", F.lit(1).cast("bigint")))
    found, hops = front, 1
    while depth is None or hops < depth:
        hops += 1
        step = front.join(edges, front["id"] == edges["src"]).select("root", F.col("dst").alias("id")).distinct()
        front = cut(step.join(found, ["root", "id"], "left_anti").withColumn("hops", F.lit(hops).cast("bigint")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def components(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): least id of the undirected component, with ``pairs`` (src, dst).

    Every round a node joins the least of its neighbours, if that is less, and then what that one
    joined; edges are kept between what has joined, so each round has a part of the last one's
    nodes, and long chains halve. Nodes without an edge are their own.
    """
    live = cut(pairs.select("src", "dst").union(pairs.select("dst", "src")).toDF("src", "dst").distinct())
    joined = []
    while joined == [] or not live.isEmpty():
        near = cut(live.groupBy(F.col("src").alias("id")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
        far = near.select(F.col("id").alias("component"), F.col("component").alias("top"))
        joined.append(cut(near.join(far, "component").select("id", F.col("top").alias("component"))))
        a, b = joined[-1].toDF("src", "a"), joined[-1].toDF("dst", "b")
        live = cut(live.join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    label = joined.pop()
    while joined:
        later = label.toDF("component", "top")
        label = cut(joined.pop().join(later, "component", "left").select("id", F.coalesce("top", "component").alias("component")))
    if nodes is not None:
        label = nodes.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return label


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): least id of each strongly connected component of ``edges``.

    Nodes without a way in or out are peeled off first. Then each round takes, per
    remaining weak region, the least label that reaches a node forwards and backwards;
    nodes where both agree are settled and leave the graph.
    """
    edges = cut(edges.select("src", "dst").distinct())
    ids = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    live = cut(edges.filter("src <> dst"))
    settled = None
    while True:
        # Peel until every node has an edge in and an edge out.
        while True:
            core = live.select(F.col("src").alias("id")).intersect(live.select("dst"))
            small = cut(live.join(core.withColumnRenamed("id", "src"), "src", "left_semi").join(core.withColumnRenamed("id", "dst"), "dst", "left_semi"))
            if small.count() == live.count():
                break
            live = small
        if live.isEmpty():
            break
        nodes = live.select(F.col("src").alias("id")).distinct()
        down, up = _least_label(live, nodes, "src", "dst"), _least_label(live, nodes, "dst", "src")
        same = cut(down.join(up.withColumnRenamed("label", "back"), "id").filter("label = back").select("id", F.col("label").alias("component")))
        settled = same if settled is None else settled.unionByName(same)
        # Only edges inside one forward and backward label can lie on a further cycle.
        pair = cut(down.join(up.withColumnRenamed("label", "back"), "id"))
        left, right = pair.toDF("src", "l1", "b1"), pair.toDF("dst", "l2", "b2")
        live = cut(live.join(left, "src").join(right, "dst").filter("l1 = l2 AND b1 = b2 AND l1 <> b1").select("src", "dst"))
    if settled is None:
        return ids.withColumn("component", F.col("id"))
    return ids.join(settled, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _least_label(edges: DataFrame, nodes: DataFrame, src: str, dst: str) -> DataFrame:
    label = cut(nodes.withColumn("label", F.col("id")))
    while True:
        sent = edges.join(label, edges[src] == label["id"]).groupBy(F.col(dst).alias("id")).agg(F.min("label").alias("heard"))
        step = cut(label.join(sent, "id", "left").select("id", F.least("label", "heard").alias("label"), (F.col("heard") < F.col("label")).alias("moved")))
        label = step.select("id", "label")
        if step.filter("moved").isEmpty():
            return label
