"""From names to edges: ranked resolution, inheritance order, overrides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text as T


def resolve_relations(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(rel, id, tier): the symbol that a relation's target name stands for.

    ``relations``: rel, path, name, hint (a qualified name or null); ``symbols``: id, path, name,
    qualified_name. The first tier with exactly one candidate decides: 1 the same name in
    the same file, 2 the hint as a qualified name, 3 a qualified name that ends in the hint, 4
    the bare name anywhere. A tier with several candidates decides nothing, and a name that
    is ambiguous everywhere gets no edge.
    """
    r = relations.select("rel", "path", "name", "hint")
    s = symbols.select("id", "path", "name", F.col("qualified_name").alias("qn"), T.member(F.col("qualified_name")).alias("last")).filter("id IS NOT NULL")
    # What follows each dot of a qualified name, for names that end in a hint.
    cuts = F.expr("transform(filter(sequence(1, length(qn)), i -> substr(qn, i, 1) = '.'), i -> substr(qn, i + 1))")
    ends = s.filter("qn IS NOT NULL AND qn <> ''").select("id", "last", F.explode(F.array_distinct(cuts)).alias("hint"))
    hinted = r.filter("hint IS NOT NULL").withColumn("last", F.element_at(F.split("hint", r"::|\.|#"), -1))
    # One row for each key before the join: hot names would meet all symbols that bear them.
    keyed = lambda df, *key: df.groupBy(*key).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    tiers = [
        r.join(keyed(s, "name", "path"), ["name", "path"]),
        hinted.join(keyed(s.withColumnRenamed("qn", "hint"), "hint"), "hint"),
        hinted.join(keyed(ends, "hint", "last"), ["hint", "last"]),
        r.join(keyed(s, "name"), "name"),
    ]
    found = None
    for k, t in enumerate(tiers, 1):
        one = t.groupBy("rel").agg(F.min("low").alias("id"), F.max("high").alias("high")).filter("id = high").select("rel", "id", F.lit(k).alias("tier"))
        found = one if found is None else found.union(one)
    best = found.groupBy("rel").agg(F.min(F.struct("tier", "id")).alias("b"))
    return best.select("rel", F.col("b.id").alias("id"), F.col("b.tier").cast("bigint").alias("tier"))


def _merge(lists: list[list[str]]) -> list[str]:
    out, lists = [], [x for x in lists if x]
    while lists:
        head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
        if head is None:  # no consistent order: what is left keeps its own
            for x in lists:
                out += [y for y in x if y not in out]
            return out
        out.append(head)
        lists = [z for x in lists if (z := x[1:] if x[0] == head else x)]
    return out


def linearised(parents: DataFrame, groups: DataFrame, style: str = "c3") -> DataFrame:
    """(type, pos, ancestor): the order in which a type's ancestors are asked, itself at 0.

    ``parents``: type, pos, parent; ``groups``: type, group, where a group holds whole
    hierarchies (see components()). ``c3`` merges, ``depth`` goes leftmost first.
    """

    def one(df: pd.DataFrame) -> pd.DataFrame:
        up: dict[str, list[str]] = {}
        for t, p in df.sort_values(["type", "pos"])[["type", "parent"]].itertuples(index=False):
            up.setdefault(t, [])
            if p is not None and p == p:
                up[t].append(p)
        done: dict[str, list[str]] = {}

        def order(t: str, path: tuple[str, ...]) -> list[str]:
            if t not in done:
                own = [p for p in up.get(t, ()) if p not in path and p != t]
                above = [order(p, (*path, t)) for p in own]
                if style == "c3":
                    got = [t, *_merge([*[list(x) for x in above], own])]
                else:
                    got = [t]
                    for x in above:
                        got += [y for y in x if y not in got]
                if path and any(p in path for p in up.get(t, ())):
                    return got  # inside a cycle: right only from here
                done[t] = got
            return done[t]

        rows = [(t, k, a) for t in up for k, a in enumerate(order(t, ()))]
        return pd.DataFrame(rows, columns=["type", "pos", "ancestor"]).astype({"pos": "int64"})

    df = parents.join(groups, "type").select("group", "type", "pos", "parent")
    return df.groupBy("group").applyInPandas(one, "type string, pos bigint, ancestor string")


def overrides(methods: DataFrame, order: DataFrame) -> DataFrame:
    """(src, dst): each method and the one of its name in the nearest ancestor that has one;
    ``methods``: id, type, name."""
    mine = methods.select(F.col("id").alias("src"), "type", "name")
    above = methods.select(F.col("id").alias("dst"), F.col("type").alias("ancestor"), "name")
    j = mine.join(order.filter("pos > 0"), "type").join(above, ["ancestor", "name"])
    return j.groupBy("src").agg(F.min_by("dst", F.struct("pos", "dst")).alias("dst"))


def unused_keys(keys: DataFrame, uses: DataFrame) -> DataFrame:
    """(id, confidence) of config keys (id, name) that nothing uses (dst)."""
    free = keys.join(uses.select(F.col("dst").alias("id")), "id", "left_anti")
    return free.select("id", F.when(F.lower("name").rlike("legacy|old"), 0.9).otherwise(0.7).alias("confidence"))


def missing_keys(uses: DataFrame, defined: DataFrame) -> DataFrame:
    """(name, paths) of variables used (name, path) and nowhere defined (name)."""
    return uses.join(defined.select("name"), "name", "left_anti").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))


def parked(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(rel, id, tier): targets in other repositories. relations: rel, repo, hint (a qualified
    name or null), module, name; symbols: id, repo, qualified_name, path, name. Tiers: 1 the
    hint, 2 the most path segments that end like the module, 3 the name alone; a tier with two
    symbols or more gives none, and the next one is asked."""
    s = symbols.select("id", "repo", F.col("qualified_name").alias("hint"), T.module_segments(F.col("path")).alias("there"), "name").filter("id IS NOT NULL AND repo IS NOT NULL")
    r = relations.select("rel", "repo", "hint", "name", T.module_segments(F.col("module")).alias("here"))
    ends = lambda c: F.expr(f"transform(sequence(1, size({c})), n -> slice({c}, size({c}) - n + 1, n))")
    tails = lambda df, c: df.filter(F.size(c) > 0).select("*", F.explode(ends(c)).alias("tail"))

    def met(asked: DataFrame, df: DataFrame, *key: str) -> DataFrame:
        """The least and the greatest id of a key outside the asking repository. Each key keeps
        these of the best repository and of the next one, so hot names stay small."""
        per = df.groupBy(*key, "repo").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        two = per
        for c, order in (("low", F.col("low").asc()), ("high", F.col("high").desc())):
            two = two.withColumn(f"r_{c}", F.row_number().over(Window.partitionBy(*key).orderBy(order, "repo")))
        first = [F.max(F.when(F.col(f"r_{c}") == n, F.struct(c, "repo"))).alias(f"{c}{n}") for c in ("low", "high") for n in (1, 2)]
        two = two.filter("r_low <= 2 OR r_high <= 2").groupBy(*key).agg(*first)
        other = lambda c: F.expr(f"CASE WHEN {c}1.repo <> repo THEN {c}1.{c} WHEN {c}2.repo <> repo THEN {c}2.{c} END").alias(c)
        return asked.join(two, list(key)).select(*asked.columns, other("low"), other("high")).filter("low IS NOT NULL")

    by_hint = met(r, s, "hint").select("rel", F.lit(1).alias("tier"), F.lit(0).alias("score"), "low", "high")
    # All that share n segments share n - 1: those with the most are the ids of the longest tail met.
    by_path = met(tails(r, "here"), tails(s, "there"), "name", "tail").select("rel", F.lit(2).alias("tier"), F.size("tail").alias("score"), "low", "high")
    by_name = met(r, s, "name").select("rel", F.lit(3).alias("tier"), F.lit(0).alias("score"), "low", "high")
    every = by_hint.union(by_path).union(by_name).filter("rel IS NOT NULL").groupBy("rel", "tier")
    one = every.agg(F.min(F.struct(-F.col("score"), "low")).getField("low").alias("id"), F.max(F.struct("score", "high")).getField("high").alias("last")).filter("id = last")
    return one.groupBy("rel").agg(F.min_by("id", "tier").alias("id"), F.min("tier").alias("tier"))


def inheritance(extends: DataFrame, types: DataFrame) -> DataFrame:
    """(src, dst): types (id, name) and what they extend (id, base), by names that only one
    type has."""
    sole = types.groupBy("name").agg(F.min("id").alias("dst"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return extends.join(sole, F.col("base") == F.col("name")).filter(F.col("id") != F.col("dst")).select(F.col("id").alias("src"), "dst").distinct()


def inherited_calls(calls: DataFrame, methods: DataFrame, order: DataFrame) -> DataFrame:
    """(src, dst): calls (src, type, name) taken to the method of that name in the nearest
    ancestor that has one; methods: id, type, name; order: type, pos, ancestor."""
    met = calls.join(order, "type").join(methods.select(F.col("id").alias("dst"), F.col("type").alias("ancestor"), "name"), ["ancestor", "name"])
    return met.groupBy("src", "type", "name").agg(F.min_by("dst", F.struct("pos", "dst")).alias("dst")).select("src", "dst").distinct()


def config_links(uses: DataFrame, keys: DataFrame) -> DataFrame:
    """(site, id, exact): uses (site, name) of config keys (id, name), by the whole name, else
    by the last part in lower case without dashes and underscores, if one key has it."""
    tail = lambda c: F.lower(F.regexp_replace(F.element_at(F.split(c, r"\."), -1), "[-_]", ""))
    whole = uses.join(keys, "name").groupBy("site", "name").agg(F.min("id").alias("id"))
    sole = keys.groupBy(tail(F.col("name")).alias("tail")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    rest = uses.join(whole, ["site", "name"], "left_anti").withColumn("tail", tail(F.col("name"))).join(sole, "tail")
    return whole.select("site", "id", F.lit(True).alias("exact")).union(rest.select("site", "id", F.lit(False)))
