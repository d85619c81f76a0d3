"""Change history, snapshot differences, compaction and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE_DAYS, MEGA_COMMIT = 30.0, 50


def without_mega_commits(commits: DataFrame, most: int = MEGA_COMMIT) -> DataFrame:
    """Commits (commit, ts, file, ...) that touch ``most`` files at most."""
    n = commits.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("commit")
    return commits.join(n, "commit", "left_semi")


def churn(commits: DataFrame) -> DataFrame:
    """(file, commits, added, deleted, last_ts, churn): changed lines, logged and halved for
    every 30 days of age against the newest commit."""
    c = without_mega_commits(commits)
    newest = F.broadcast(c.agg(F.max("ts").alias("newest")))
    age = F.greatest((F.unix_timestamp("newest") - F.unix_timestamp("ts")) / 86400.0, F.lit(0.0))
    weight = F.log1p(F.col("added") + F.col("deleted")) * F.exp(-(F.log(F.lit(2.0)) / HALF_LIFE_DAYS) * age)
    return c.crossJoin(newest).groupBy("file").agg(
        F.countDistinct("commit").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.max("ts").alias("last_ts"), F.sum(weight).alias("churn")
    )


def hotspots(churned: DataFrame, complexity: DataFrame) -> DataFrame:
    """(file, hotspot): churn times ln(1 + largest complexity); ``complexity``: file, cyclomatic."""
    c = complexity.groupBy("file").agg(F.max("cyclomatic").alias("c"))
    return churned.join(c, "file").select("file", (F.col("churn") * F.log1p("c")).alias("hotspot"))


def cochange(commits: DataFrame, least: int = 3, jaccard: float = 0.25, top: int = 15) -> DataFrame:
    """(a, b, pairs, jaccard), a < b: files that change together, if either file has the
    other among its ``top``. Commits are small (see without_mega_commits), so pairs within
    one are bounded."""
    c = without_mega_commits(commits).select("commit", "file").distinct()
    n = c.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    a, b = c.toDF("commit", "a"), c.toDF("commit", "b")
    both = a.join(b, "commit").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("pairs")).filter(F.col("pairs") >= least)
    both = both.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    both = both.withColumn("jaccard", F.col("pairs") / (F.col("na") + F.col("nb") - F.col("pairs"))).filter(F.col("jaccard") >= jaccard)
    sides = both.select("a", "b", "pairs", "jaccard", F.col("a").alias("file"), F.col("b").alias("peer")).union(both.select("a", "b", "pairs", "jaccard", F.col("b").alias("file"), F.col("a").alias("peer")))
    w = Window.partitionBy("file").orderBy(F.desc("jaccard"), F.desc("pairs"), F.desc("peer"))
    return sides.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select("a", "b", "pairs", "jaccard").distinct()


def diff_nodes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(key, kind): added, removed or changed; both have key and digest."""
    b, h = base.toDF("key", "old"), head.toDF("key", "new")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return b.join(h, "key", "full_outer").select("key", kind.alias("kind")).filter("kind IS NOT NULL")


def diff_edges(base: DataFrame, head: DataFrame) -> DataFrame:
    """The columns of the edges and ``kind``; parallel edges count as often as they stand."""
    return head.exceptAll(base).withColumn("kind", F.lit("added")).unionAll(base.exceptAll(head).withColumn("kind", F.lit("removed")))


def retargeted(changes: DataFrame) -> DataFrame:
    """(src, old_dst, new_dst, kind): of each caller, removed and added targets (src, dst,
    kind) paired in their order; what is over stays added or removed."""
    w = Window.partitionBy("src").orderBy("dst")
    gone = changes.filter("kind = 'removed'").select("src", F.row_number().over(w).alias("r"), F.col("dst").alias("old_dst"))
    come = changes.filter("kind = 'added'").select("src", F.row_number().over(w).alias("r"), F.col("dst").alias("new_dst"))
    kind = F.when(F.col("old_dst").isNull(), "added").when(F.col("new_dst").isNull(), "removed").otherwise("retargeted")
    return gone.join(come, ["src", "r"], "full_outer").select("src", "old_dst", "new_dst", kind.alias("kind"))


def compacted(base: DataFrame, delta: DataFrame, invalid: DataFrame, alive: DataFrame) -> DataFrame:
    """Edges (src, dst) after an update: base edges whose source is neither invalid (id) nor
    gone and whose target is alive (id), with those of the delta, once each."""
    kept = base.join(invalid.select(F.col("id").alias("src")), "src", "left_anti").join(alive.select(F.col("id").alias("src")), "src", "left_semi")
    kept = kept.join(alive.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    return kept.union(delta.select("src", "dst")).distinct()


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind) by file hash; both have path and hash."""
    return diff_nodes(old.select("path", "hash"), new.select("path", "hash")).withColumnRenamed("key", "path")


def hunk_overlap(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, path): spans (id, path, start_line, end_line) that a hunk (path, h_start, h_end)
    touches; a start of 0 on either side overlaps everything in the file."""
    j = spans.join(hunks, "path")
    touch = (F.col("h_start") == 0) | (F.col("start_line") == 0) | ((F.col("h_start") <= F.col("end_line")) & (F.col("start_line") <= F.col("h_end")))
    return j.filter(touch).select("id", "path").distinct()


def enclosing(sites: DataFrame, spans: DataFrame) -> DataFrame:
    """(site, id): the smallest span (id, path, start_line, end_line) around each site
    (site, path, line); ties to the smaller id.

    A span is cut into aligned blocks of 2^k lines, at most two for each k. Each block keeps its
    best span before anything is joined, and a line asks the one block of each size that it is in.
    """
    a, b = F.col("start_line").cast("bigint"), F.col("end_line").cast("bigint")
    best = F.struct((F.col("end_line") - F.col("start_line")).alias("w"), F.col("id").alias("id"))
    own = spans.filter("path IS NOT NULL AND start_line <= end_line").select("path", a.alias("a"), (b + 1).alias("b"), best.alias("best"))
    own = own.groupBy("path", "a", "b").agg(F.min("best").alias("best"))
    sizes = own.select("*", F.explode(F.expr("sequence(0, int(log2(b - a)) + 1)")).alias("k"))
    # Of the blocks of a size within the span, those that no block of twice that size takes in.
    sizes = sizes.withColumns({"low": F.expr("-shiftright(-a, k)"), "high": F.expr("shiftright(b, k)")}).filter("low < high")
    blocks = sizes.select("path", "k", "best", F.explode(F.expr("array_distinct(filter(array(if(low & 1 = 1, low, null), if(high & 1 = 1, high - 1, null)), x -> x IS NOT NULL))")).alias("slot"))
    blocks = blocks.groupBy("path", "k", "slot").agg(F.min("best").alias("best"))
    lines = sites.select("path", F.col("line").cast("bigint").alias("line")).filter("path IS NOT NULL AND line IS NOT NULL").distinct()
    asked = lines.crossJoin(F.broadcast(blocks.select("k").distinct())).withColumn("slot", F.expr("shiftright(line, k)"))
    met = asked.join(blocks, ["path", "k", "slot"]).groupBy("path", "line").agg(F.min("best").alias("best"))
    found = sites.withColumn("line", F.col("line").cast("bigint")).join(met, ["path", "line"])
    return found.groupBy("site").agg(F.min("best").alias("b")).select("site", F.col("b.id").alias("id"))


def policy(impact: DataFrame, crossings: DataFrame, central: DataFrame, most: int, alert: float) -> DataFrame:
    """(id, rule, detail): impact (id, impact) over ``most``; every forbidden crossing
    (src, dst, a, b); betweenness (id, betweenness) over ``alert``; ``first`` marks the one that
    a gate reports: size first, then crossings, then centrality, by id."""
    rows = (
        impact.filter(F.col("impact") > most).select("id", F.lit("max_impact").alias("rule"), F.col("impact").cast("string").alias("detail"), F.lit(0).alias("o"))
        .union(crossings.select("src", F.lit("forbidden_crossing"), F.concat_ws("->", "a", "b"), F.lit(1)))
        .union(central.filter(F.col("betweenness") > alert).select("id", F.lit("centrality_alert"), F.round("betweenness", 6).cast("string"), F.lit(2)))
    )
    first = F.broadcast(rows.agg(F.min(F.struct("o", "id", "detail")).alias("f")))
    return rows.crossJoin(first).select("id", "rule", "detail", (F.struct("o", "id", "detail") == F.col("f")).alias("first"))


def forbidden_crossings(edges: DataFrame, domains: DataFrame, forbidden: list[tuple[str, str]]) -> DataFrame:
    """(src, dst, a, b): edges between two domains (id, domain) that may not touch, either way."""
    e = edges.join(domains.toDF("src", "a"), "src").join(domains.toDF("dst", "b"), "dst")
    tests = [((F.col("a") == x) & (F.col("b") == y)) | ((F.col("a") == y) & (F.col("b") == x)) for x, y in forbidden]
    test = F.lit(False)
    for t in tests:
        test = test | t
    return e.filter(test).select("src", "dst", "a", "b")


def temporal(base: DataFrame, head: DataFrame, ledger: DataFrame) -> DataFrame:
    """(key, class) of violations: existing, new, resolved; regression if the ledger (key)
    has it as resolved before."""
    b, h = base.select("key").distinct().withColumn("b", F.lit(True)), head.select("key").distinct().withColumn("h", F.lit(True))
    old = ledger.select("key").distinct().withColumn("l", F.lit(True))
    kind = F.when(F.col("b") & F.col("h"), "existing").when(F.col("h") & F.col("l"), "regression").when(F.col("h"), "new").otherwise("resolved")
    return b.join(h, "key", "full_outer").join(old, "key", "left").select("key", kind.alias("class"))


def ledger_state(entries: DataFrame) -> DataFrame:
    """(key, first_ts, class): first sight and latest class; entries: key, seq, ts, class."""
    return entries.groupBy("key").agg(F.min("ts").alias("first_ts"), F.max_by("class", "seq").alias("class"))


def calendar(today: Column, effective: Column, grace_days: int, sunset: Column) -> Column:
    """What a dated policy does on a day: sunset, inactive, grace or enforced."""
    return F.when(sunset.isNotNull() & (today > sunset), "sunset").when(today < effective, "inactive").when(today <= F.date_add(effective, grace_days), "grace").otherwise("enforced")


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, kind) between two lists of (seq, key, value); a later duplicate wins."""
    last = lambda df: df.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return diff_nodes(last(old), last(new))


def label_rules(nodes: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """``nodes`` with the label of every rule whose condition holds, each once."""
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    for test, label in rules:
        labels = F.when(F.coalesce(test, F.lit(False)), F.array_union(labels, F.array(F.lit(label)))).otherwise(labels)
    return nodes.withColumn("labels", F.array_sort(labels))


def version_key(version: Column) -> Column:
    """Numeric dotted versions as arrays that compare; null where it is not one."""
    clean = F.regexp_replace(version, r"^v", "")
    ok = clean.rlike(r"^\d+(\.\d+)*$")
    return F.when(ok, F.transform(F.split(clean, r"\."), lambda x: x.cast("bigint")))


def affected(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """``deps`` (package, version) inside an interval of ``advisories`` (package, introduced,
    fixed): from the first on and before the second; unknown versions are outside."""
    j = deps.join(advisories, "package")
    v = version_key(F.col("version"))
    return j.filter((v >= version_key(F.col("introduced"))) & (F.col("fixed").isNull() | (v < version_key(F.col("fixed")))))
