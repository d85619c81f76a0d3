"""Graph algorithms over edges (src, dst)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.centrality import LOCAL_EDGES, centrality, harmonic, hyperball  # noqa: F401
from lattica.plans.iterate import closure, components, cut, reach, strong_components


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(id, score) of all nodes: parallel edges count, the mass of nodes without a way out
    is spread over all, and nodes without any edge absorb it but are reported as 0."""
    n = nodes.count()
    e = cut(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    out = e.groupBy("src").agg(F.sum("w").alias("out"))
    links = cut(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    sources = cut(out.select(F.col("src").alias("id")))
    rank = cut(nodes.select("id").withColumn("score", F.lit(1.0 / max(n, 1))))
    for _ in range(rounds):
        kept = rank.join(sources, "id", "left_semi").agg(F.sum("score")).first()[0] or 0.0
        total = rank.agg(F.sum("score")).first()[0] or 0.0
        spread = (1 - damping) / n + damping * (total - kept) / n
        got = links.join(rank, links["src"] == rank["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        step = rank.join(got, "id", "left").select("id", (F.lit(spread) + damping * F.coalesce("got", F.lit(0.0))).alias("score"), F.col("score").alias("old"))
        step = cut(step)
        moved = step.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        rank = step.select("id", "score")
        if moved < tolerance:
            break
    touched = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("touched", F.lit(True))
    return rank.join(touched, "id", "left").select("id", F.when(F.col("touched"), F.col("score")).otherwise(F.lit(0.0)).alias("score"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree); parallel edges count."""
    a = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    b = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = a.join(b, "id", "full_outer").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def risk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, risk): degree times cyclomatic complexity, 1 where there is none."""
    cyclomatic = F.coalesce(F.expr("try_cast(properties['cyclomatic'] AS bigint)"), F.lit(1))
    return degree(edges).join(nodes.select("id", cyclomatic.alias("c")), "id").select("id", "degree", (F.col("degree") * F.col("c")).alias("risk"))


def hubs(edges: DataFrame, sigma: float = 4.0, share: float = 0.05) -> DataFrame:
    """(id, degree) over mean + sigma population deviations, 5 % of the nodes at most."""
    d = degree(edges).select("id", "degree")
    s = d.agg(F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("dev"), F.count(F.lit(1)).alias("n"))
    over = d.crossJoin(F.broadcast(s)).filter((F.col("n") >= 20) & (F.col("degree") > F.col("mean") + sigma * F.col("dev")))
    w = Window.orderBy(F.desc("degree"), "id")
    return over.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.floor(F.col("n") * share)).select("id", "degree")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row ``q``: over communities (id, community), inner edges over m less squared
    degree over 4 m squared; directed edges count once."""
    e = edges.join(communities.toDF("src", "a"), "src").join(communities.toDF("dst", "b"), "dst")
    inner = e.groupBy(F.col("a").alias("c")).agg(F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("inner"), F.count(F.lit(1)).alias("d"))
    into = e.groupBy(F.col("b").alias("c")).agg(F.count(F.lit(1)).alias("d2"))
    per = inner.join(into, "c", "full_outer").select(F.coalesce("inner", F.lit(0)).alias("inner"), (F.coalesce("d", F.lit(0)) + F.coalesce("d2", F.lit(0))).alias("deg"), F.coalesce("d", F.lit(0)).alias("d"))
    return per.agg((F.sum("inner") / F.sum("d") - F.sum(F.col("deg").cast("double") * F.col("deg")) / (4.0 * F.sum("d") * F.sum("d"))).alias("q"))


def condensation(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strong components (id, component), and the distinct edges between them."""
    label = cut(strong_components(edges))
    a, b = label.toDF("src", "cs"), label.toDF("dst", "cd")
    between = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").filter("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()
    return label, cut(between)


def cycles(edges: DataFrame) -> DataFrame:
    """(component, size, members) of strong components of two nodes or more."""
    label = strong_components(edges)
    return label.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members")).filter("size >= 2")


def recursive_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle, loops included."""
    label = strong_components(edges)
    big = label.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    return label.join(big, "component", "left_semi").select("id").union(edges.filter("src = dst").select("src")).distinct()


def _weights_above(between: DataFrame, members: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, n, up) for components that others reach: how many, and their nodes together.
    ``members``: component, size; ``between``: the acyclic graph of components.

    Most pairs of a call graph lead through one large component of each weak region. What is
    below that hub has all above the hub above it, which is counted once; the rest of what is
    above it, and all that is above others, is closed pair by pair without the hub.
    """
    up = between.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    sized = members.select(F.col("component").alias("id"), "size")
    region = cut(components(between).withColumnRenamed("component", "region").join(sized, "id"))
    hubs = cut(region.groupBy("region").agg(F.min(F.struct((-F.col("size")).alias("s"), "id")).getField("id").alias("id")).select("id"))
    over = cut(reach(up, hubs).select("id").join(region, "id"))
    under = cut(reach(between, hubs).select("id"))
    shared = over.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("up"))
    asked = between.select(F.col("dst").alias("id")).distinct() if roots is None else roots.select("id")
    low, high = asked.join(under, "id", "left_semi"), asked.join(under, "id", "left_anti")
    # Above what is not under a hub nothing is under it; above the others, what is over a hub is counted.
    past = closure(up.join(over.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), low)
    apart = closure(up.join(under.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst"), high)
    pairs = past.union(apart).join(sized, "id").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("up"))
    # A hub is over itself; it is not among those above it.
    own = low.join(region, "id").join(shared, "region").join(hubs.withColumn("hub", F.lit(True)), "id", "left")
    own = own.select(F.col("id").alias("root"), (F.col("n") - F.when(F.col("hub"), 1).otherwise(0)).alias("n"), (F.col("up") - F.when(F.col("hub"), F.col("size")).otherwise(0)).alias("up"))
    return pairs.union(own).groupBy("root").agg(F.sum("n").alias("n"), F.sum("up").alias("up")).filter("n > 0")


def blast(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(id, direct, impact, score): all that can reach a node, and of those the members of
    the components that call its own; computed on the condensed graph."""
    label, between = condensation(edges)
    members = cut(label.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    wanted = label if seeds is None else label.join(seeds.select("id"), "id", "left_semi")
    up = between.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    roots = wanted.select(F.col("component").alias("id")).distinct()
    impact = _weights_above(between, members, roots).select("root", "up")
    near = up.join(members.withColumnRenamed("component", "dst"), "dst").groupBy(F.col("src").alias("root")).agg(F.sum("size").alias("direct"))
    out = wanted.join(members, "component").join(impact.withColumnRenamed("root", "component"), "component", "left").join(near.withColumnRenamed("root", "component"), "component", "left")
    out = out.select("id", F.coalesce("direct", F.lit(0)).alias("direct"), (F.col("size") - 1 + F.coalesce("up", F.lit(0))).alias("impact"))
    return out.withColumn("score", F.least(F.lit(25.0) * F.col("direct"), F.lit(40.0)) + F.least(F.lit(0.05) * F.col("impact"), F.lit(60.0)))


def reach_centrality(edges: DataFrame) -> DataFrame:
    """(id, reach): how many components reach a node's own, itself included."""
    label, between = condensation(edges)
    above = _weights_above(between, label.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    return label.join(above.withColumnRenamed("root", "component"), "component", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("reach"))


def impact_radius(edges: DataFrame, seeds: DataFrame, depth: int = 10) -> DataFrame:
    """(id, hops) of what reaches the seeds over any edge within ``depth``."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, depth).filter("hops > 0")


def dead_code(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that the roots do not reach and nothing refers to."""
    live = reach(edges, roots).select("id")
    used = edges.select(F.col("dst").alias("id")).distinct()
    return nodes.select("id").join(live, "id", "left_anti").join(used, "id", "left_anti")


def topological_order(edges: DataFrame) -> DataFrame:
    """(id, level): the longest way from a node that nothing calls. Raises on a cycle."""
    left = cut(edges.select("src", "dst").distinct())
    ids = cut(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct())
    out, level = None, 0
    while not ids.isEmpty():
        free = cut(ids.join(left.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level).cast("bigint")))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        out = free if out is None else out.unionByName(free)
        ids = cut(ids.join(free, "id", "left_anti"))
        left = cut(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return out


def _adjacency(edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node ids, and the graph as compressed sparse rows over their places."""
    ids, code = np.unique(np.concatenate([edges["src"], edges["dst"]]), return_inverse=True)
    s, d = code[: len(edges)], code[len(edges) :]
    order = np.lexsort((d, s))
    return ids, np.searchsorted(s[order], np.arange(len(ids) + 1)), d[order]


def label_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community) by label propagation over undirected distinct edges: every round a
    node takes the label that most neighbours have, the least of equals, or keeps its own."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst").filter("src <> dst").distinct())
    label = cut(both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = both.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("community"))).alias("b"))
        label = cut(best.select("id", F.col("b.community").alias("community")))
    return label


def communities(edges: DataFrame, resolution: float = 1.0, passes: int = 8) -> DataFrame:
    """(id, community) by greedy modularity moves over the undirected distinct graph, in
    the order of ids, then split into connected parts; label propagation past LOCAL_EDGES."""
    spark = edges.sparkSession
    both = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct())
    if both.count() > LOCAL_EDGES:
        return label_communities(both)
    half = both.toPandas()
    if half.empty:
        return spark.createDataFrame([], "id string, community string")
    ids, at, to = _adjacency(pd.concat([half, half.rename(columns={"src": "dst", "dst": "src"})])[["src", "dst"]])
    size = np.diff(at).astype(float)
    m2 = size.sum()
    own, weight = np.arange(len(ids)), size.copy()
    for _ in range(passes):
        moved = 0
        for v in range(len(ids)):
            near, n = np.unique(own[to[at[v] : at[v + 1]]], return_counts=True)
            weight[own[v]] -= size[v]
            gain = n - resolution * size[v] * weight[near] / m2
            stay = float(n[near == own[v]].sum()) - resolution * size[v] * weight[own[v]] / m2
            best = near[np.lexsort((near, -gain))[0]] if len(near) and gain.max() > stay + 1e-12 else own[v]
            moved += best != own[v]
            own[v] = best
            weight[own[v]] += size[v]
        if not moved:
            break
    table = spark.createDataFrame(pd.DataFrame({"id": ids, "group": own}))
    inner = both.join(table.toDF("src", "a"), "src").join(table.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst")
    return components(inner, table).select("id", F.col("component").alias("community"))


def migration_scores(metrics: DataFrame, alpha: float = 0.33, beta: float = 0.33, gamma: float = 0.34) -> DataFrame:
    """(id, score, priority): min-max of PageRank and harmonic less that of blast; 0.5 where
    all are equal. ``metrics``: id, pagerank, harmonic, blast."""
    bounds = metrics.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("pagerank", "harmonic", "blast") for f in (F.min, F.max)])
    df = metrics.crossJoin(F.broadcast(bounds))

    def scaled(c: str):
        low, high = F.col(f"min_{c}"), F.col(f"max_{c}")
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.5)

    df = df.select("id", (alpha * scaled("pagerank") + beta * scaled("harmonic") - gamma * scaled("blast")).alias("score"))
    return df.withColumn("priority", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def region_hashes(nodes: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(id, hash): Weisfeiler-Lehman refinement of ``nodes`` (id, kind) over typed edges
    (src, dst, edge_type), in and out; equal surroundings have equal hashes."""
    h = nodes.select("id", F.xxhash64("kind").alias("hash"))
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("peer"), F.concat(F.lit(">"), F.col("edge_type")).alias("tag"))
    both = out.union(edges.select("dst", "src", F.concat(F.lit("<"), F.col("edge_type"))))
    for _ in range(rounds):
        # A sum of mixed hashes does not depend on order and is combined before the shuffle.
        near = both.join(h.toDF("peer", "ph"), "peer").groupBy("id").agg(F.sum(F.xxhash64("tag", "ph").cast("decimal(20,0)")).alias("around"))
        h = h.join(near, "id", "left").select("id", F.xxhash64("hash", F.coalesce(F.col("around"), F.lit(0)).cast("decimal(38,0)")).alias("hash"))
    return h


def dispatched(edges: DataFrame, exact: int = 100_000, pivots: int = 256) -> tuple[DataFrame, str]:
    """Centrality and the way it was computed: ``exact`` up to so many nodes, else ``sampled``
    from ``pivots`` of the least hash."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    if ids.count() <= exact:
        return centrality(edges), "exact"
    return centrality(edges, ids.orderBy(F.xxhash64("id")).limit(pivots)), "sampled"
