"""Reports over nodes, edges and metrics: packages, communities, ranks, risks and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.plans.iterate import reach


def call_weights(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, n): edges (src, dst) between nodes of different labels (id, label)."""
    met = edges.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst")
    return met.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def plurality(items: DataFrame, share: float = 1 / 3) -> DataFrame:
    """(group, label): the commonest label of each group of (group, label), the least of
    equals, if ``share`` of the group's rows has it. Null labels count as rows only."""
    counted = items.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("label").isNotNull(), F.struct((-F.col("n")).alias("less"), F.col("label").alias("label"))))
    top = counted.groupBy("group").agg(best.alias("best"), F.sum("n").alias("every"))
    return top.filter(-F.col("best.less") >= share * F.col("every") - 1e-9).select("group", F.col("best.label").alias("label"))


def community_summary(members: DataFrame) -> DataFrame:
    """(community, size, primary_type, complexity) of (community, node_type, complexity):
    the commonest type, the least of equals, and the mean complexity."""
    part = members.groupBy("community", "node_type").agg(F.count(F.lit(1)).alias("n"), F.sum("complexity").alias("s"), F.count("complexity").alias("k"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("node_type").alias("node_type")))
    whole = part.groupBy("community").agg(F.sum("n").alias("size"), best.alias("best"), (F.sum("s") / F.sum("k")).alias("complexity"))
    return whole.select("community", "size", F.col("best.node_type").alias("primary_type"), "complexity")


def package_summary(metrics: DataFrame, most: int = 256) -> DataFrame:
    """(package, members, pagerank, harmonic, betweenness, blast, community) of metrics (id,
    package and these): means, the largest blast, the commonest community. Beyond the
    ``most`` largest packages all others are one, (other)."""
    sizes = metrics.groupBy("package").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.orderBy(F.desc("n"), "package").limit(most).select("package", F.lit(True).alias("large"))
    named = metrics.join(F.broadcast(large), "package", "left").withColumn("package", F.when(F.col("large"), F.col("package")).otherwise("(other)"))
    means = [F.avg(c).alias(c) for c in ("pagerank", "harmonic", "betweenness")]
    whole = named.groupBy("package").agg(F.count(F.lit(1)).alias("members"), *means, F.max("blast").alias("blast"))
    common = plurality(named.select(F.col("package").alias("group"), F.col("community").alias("label")), 0.0)
    return whole.join(common.toDF("package", "community"), "package", "left")


def metagraph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages (package, functions, classes, complexity, community) of nodes (id, package,
    node_type, complexity, community), and edges (a, b, edge_type, n) between them."""
    of = lambda kind: F.count(F.when(F.col("node_type") == kind, 1))
    whole = nodes.groupBy("package").agg(of("function").alias("functions"), of("class").alias("classes"), F.avg("complexity").alias("complexity"))
    common = plurality(nodes.select(F.col("package").alias("group"), F.col("community").alias("label")), 0.0)
    label = nodes.select("id", "package")
    met = edges.join(label.toDF("src", "a"), "src").join(label.toDF("dst", "b"), "dst").filter("a <> b")
    return whole.join(common.toDF("package", "community"), "package", "left"), met.groupBy("a", "b", "edge_type").agg(F.count(F.lit(1)).alias("n"))


def function_metrics(nodes: DataFrame, *overlays: DataFrame) -> DataFrame:
    """``nodes`` with the columns of every overlay (id, ...), null where it has no row."""
    for overlay in overlays:
        nodes = nodes.join(overlay, "id", "left")
    return nodes


def blast_summary(edges: DataFrame, places: DataFrame, seeds: DataFrame, top: int = 10) -> DataFrame:
    """(kind, name, n): how many nodes call the seeds (id) directly and at all, and the
    ``top`` files (places: id, file) by the number of nodes that are hit."""
    hit = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds).filter("hops > 0")
    counts = hit.agg(F.count(F.when(F.col("hops") == 1, 1)).alias("direct"), F.count(F.lit(1)).alias("transitive"))
    totals = counts.select(F.explode(F.create_map(F.lit("direct"), F.col("direct"), F.lit("transitive"), F.col("transitive"))).alias("kind", "n"))
    files = hit.join(places, "id").groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").limit(top)
    return totals.select("kind", F.lit(None).cast("string").alias("name"), "n").union(files.select(F.lit("file"), F.col("file").cast("string"), "n"))


def type_blast(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(type, id): all that reaches a member of a type (members: type, id), without the members."""
    seen, frontier = members.select("type", "id"), members.select("type", "id")
    from lattica.plans.iterate import cut

    back = cut(edges.select(F.col("dst").alias("id"), F.col("src").alias("next")).distinct())
    found = cut(seen)
    while not frontier.isEmpty():
        step = frontier.join(back, "id").select("type", F.col("next").alias("id")).distinct()
        frontier = cut(step.join(found, ["type", "id"], "left_anti"))
        found = cut(found.union(frontier))
    return found.join(members.select("type", "id"), ["type", "id"], "left_anti")


def ranked(scores: DataFrame, top: int) -> DataFrame:
    """The ``top`` of (id, score) with their rank from 1, ties by id."""
    best = scores.orderBy(F.desc("score"), "id").limit(top)
    return best.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("bigint").alias("rank"))


def min_max(rows: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with a column laid over 0 to 1; 0.5 where all are equal."""
    ends = rows.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    x = (F.col(column) - F.col("__low")) / (F.col("__high") - F.col("__low"))
    # One row, whatever the input holds.
    return rows.crossJoin(F.broadcast(ends)).withColumn(out, F.when(F.col("__low") == F.col("__high"), 0.5).otherwise(x)).drop("__low", "__high")


def numbered(labels: DataFrame) -> DataFrame:
    """(id, label) with ``(2)``, ``(3)`` after labels that are equal but for their case."""
    k = F.row_number().over(Window.partitionBy(F.lower("label")).orderBy("id"))
    again = F.concat("label", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))
    return labels.withColumn("k", k).select("id", F.when(F.col("k") == 1, F.col("label")).otherwise(again).alias("label"))


def community_labels(members: DataFrame) -> DataFrame:
    """(id, label) of communities, of members (community, package, name, score): the package
    of a third of the members or more, else the name of the best scored; equal ones numbered."""
    named = plurality(members.select(F.col("community").alias("group"), F.col("package").alias("label")))
    best = members.groupBy("community").agg(F.max(F.struct("score", "name")).alias("best"))
    met = best.join(named.toDF("community", "package"), "community", "left")
    return numbered(met.select(F.col("community").alias("id"), F.coalesce("package", "best.name").alias("label")))


def filled_down(rows: DataFrame, value: Column, by: str, order: str, out: str) -> DataFrame:
    """``rows`` with the last value that is not null, in order, within each ``by``."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def hotspots(scores: DataFrame, nodes: DataFrame, include_tests: bool = False) -> DataFrame:
    """(id, score) above 0 of production nodes (id, name, file_path), and tests if asked for;
    never of externals."""
    kind = T.role(F.col("file_path"), F.col("name"))
    keep = ["production", "test"] if include_tests else ["production"]
    return scores.filter("score > 0").join(nodes.filter(kind.isin(keep)).select("id"), "id", "left_semi").select("id", "score")


def risk_level(score: Column, impact: Column, threshold: int) -> Column:
    """critical, high, medium or low by the largest score and the largest impact."""
    return F.when((score >= 80) | (impact >= threshold), "critical").when(score >= 60, "high").when(score >= 40, "medium").otherwise("low")


def change_risk(changed: DataFrame, places: DataFrame, blast: DataFrame, threshold: int = 50) -> DataFrame:
    """(file, symbols, score, impact, risk) of changed files (file): places has id and file,
    blast has id, score and impact."""
    met = changed.select("file").distinct().join(places, "file").join(blast, "id")
    by_file = met.groupBy("file").agg(F.count(F.lit(1)).alias("symbols"), F.max("score").alias("score"), F.max("impact").alias("impact"))
    return by_file.withColumn("risk", risk_level(F.col("score"), F.col("impact"), threshold))


def verdict_counts(findings: DataFrame) -> DataFrame:
    """(verdict, n)."""
    return findings.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def ranked_seeds(seeds: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` of (id, touched), touched ones first, and whether any were left out."""
    some = seeds.orderBy(F.desc("touched"), "id").limit(most + 1)
    place = F.row_number().over(Window.orderBy(F.desc("touched"), "id"))
    cut = F.count(F.lit(1)).over(Window.partitionBy()) > most
    return some.select("id", "touched", place.alias("k"), cut.alias("truncated")).filter(F.col("k") <= most).drop("k")


def heading_projection(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): calls, imports and uses, and contains only between headings of documents."""
    headings = nodes.filter("node_type = 'module'").filter(F.col("properties")["kind"] == "heading").select("id")
    inside = edges.filter("edge_type = 'contains'").join(headings.toDF("src"), "src", "left_semi").join(headings.toDF("dst"), "dst", "left_semi")
    other = edges.filter(F.col("edge_type").isin("calls", "imports", "uses"))
    return other.select("src", "dst").union(inside.select("src", "dst")).distinct()


def call_spine(edges: DataFrame, seeds: DataFrame, up: int = 2, down: int = 1, budget: int = 200) -> DataFrame:
    """(id, side, hops): callers within ``up`` and callees within ``down`` hops of the seeds
    (id), nearest first, ``budget`` rows at most."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    above = reach(back, seeds, up).withColumn("side", F.when(F.col("hops") == 0, "seed").otherwise("caller"))
    below = reach(edges, seeds, down).filter("hops > 0").withColumn("side", F.lit("callee"))
    return above.select("id", "side", "hops").union(below.select("id", "side", "hops")).orderBy("hops", "side", "id").limit(budget)


def spine_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """(id, side, kind) of two spines: added, removed or kept."""
    both = base.select("id", "side", F.lit(1).alias("b")).join(head.select("id", "side", F.lit(1).alias("h")), ["id", "side"], "full")
    return both.select("id", "side", F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").otherwise("kept").alias("kind"))


def symbol_filter(nodes: DataFrame, symbol: str) -> DataFrame:
    """(id) of the nodes that a key, a qualified name or a name stands for: the first of these
    that any node has."""
    tier = F.when(F.col("id") == symbol, 0).when(F.col("qualified_name") == symbol, 1).when(F.col("name") == symbol, 2)
    found = nodes.select("id", tier.alias("tier")).filter("tier IS NOT NULL")
    return found.join(F.broadcast(found.agg(F.min("tier").alias("tier"))), "tier").select("id")


def introduced_by(states: DataFrame) -> DataFrame:
    """(key, seq): of states (seq, key, bad) the first of the last run of bad ones, for keys whose
    last state is bad: the commit that brought a violation in."""
    last_good = F.max(F.when(~F.col("bad"), F.col("seq"))).over(Window.partitionBy("key"))
    last_bad = F.max_by("bad", "seq").over(Window.partitionBy("key"))
    after = states.withColumn("good", last_good).withColumn("now", last_bad).filter("now AND bad AND (good IS NULL OR seq > good)")
    return after.groupBy("key").agg(F.min("seq").alias("seq"))


def scoped_scores(scores: DataFrame, scope: DataFrame, alert: float) -> DataFrame:
    """(id, score) of a scope (id) over ``alert``, from scores of the whole graph."""
    return scores.join(scope.select("id").distinct(), "id", "left_semi").filter(F.col("score") > alert)


# Weaknesses by what a finding reaches, and what to do about them.
WEAKNESSES = {
    "sql_query": ("CWE-89", "bind parameters instead of joining text"),
    "shell_command": ("CWE-78", "pass arguments as a list, without a shell"),
    "html_render": ("CWE-79", "escape what is rendered"),
    "code_eval": ("CWE-95", "do not evaluate input"),
    "file_path": ("CWE-22", "resolve paths and hold them to a root"),
}


def advised(findings: DataFrame) -> DataFrame:
    """``findings`` (sink, ...) with the weakness and a recommendation; null for others."""
    table = F.create_map(*[F.lit(x) for k, v in WEAKNESSES.items() for x in (k, F.struct(F.lit(v[0]).alias("cwe"), F.lit(v[1]).alias("advice")))])
    return findings.withColumn("__w", table[F.col("sink")]).select(*findings.columns, "__w.cwe", "__w.advice")


def gates(checks: DataFrame) -> DataFrame:
    """One row of checks (check, value, most): whether all passed, and the failed ones."""
    failed = F.array_sort(F.collect_list(F.when(F.col("value") > F.col("most"), F.col("check"))))
    return checks.agg(failed.alias("failed")).select((F.size("failed") == 0).alias("passed"), F.array_join("failed", ",").alias("failed"))


def shortest_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, depth: int = 8) -> DataFrame:
    """(source, sink, hops, path): for each source (id) and sink (id) that it leads to within
    ``depth`` hops, the least text of a shortest way. A way ends at the first sink on it and
    passes a node once for each source, so the rows a round adds are sources times nodes at most."""
    from lattica.plans.iterate import cut

    ways = cut(edges.select("src", "dst").distinct())
    front = cut(sources.select(F.col("id").alias("source"), F.col("id").alias("at"), F.col("id").cast("string").alias("path")))
    seen, ends = front.select("source", "at"), None
    for hops in range(1, depth + 1):
        step = front.join(ways, F.col("at") == F.col("src")).groupBy("source", F.col("dst").alias("at")).agg(F.min(F.concat_ws(">", "path", "dst")).alias("path"))
        step = cut(step.join(seen, ["source", "at"], "left_anti"))
        hit = step.join(sinks.select(F.col("id").alias("at")), "at", "left_semi").select("source", F.col("at").alias("sink"), F.lit(hops).alias("hops"), "path")
        ends = hit if ends is None else ends.union(hit)
        front = cut(step.join(sinks.select(F.col("id").alias("at")), "at", "left_anti"))
        seen = seen.union(step.select("source", "at"))
        if front.isEmpty():
            break
    return ends
