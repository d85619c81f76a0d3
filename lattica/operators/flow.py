"""Flow analysis on statements (fn, line, defs, uses): data dependencies, slices, taint; and
on control-flow graphs (fn, src, dst): dominators, per function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.iterate import components, reach
from lattica.plans.packed import per_key


def flow_dependencies(stmts: DataFrame) -> DataFrame:
    """(fn, src, dst, var): each use and the nearest earlier definition of its variable.
    ``stmts`` has fn, line, def (or null) and uses."""
    uses = stmts.select("fn", F.col("line").alias("at"), F.explode(F.array_distinct("uses")).alias("var")).withColumn("kind", F.lit(0))
    defs = stmts.filter("def IS NOT NULL").select("fn", F.col("line").alias("at"), F.col("def").alias("var")).withColumn("kind", F.lit(1))
    # A definition of a line comes after that line's uses.
    w = Window.partitionBy("fn", "var").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    source = F.last(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(w)
    return uses.unionByName(defs).withColumn("src", source).filter("kind = 0 AND src IS NOT NULL").select("fn", "src", F.col("at").alias("dst"), "var")


def output_dependencies(stmts: DataFrame) -> DataFrame:
    """(fn, src, dst, var): a definition and the next one of the same variable."""
    w = Window.partitionBy("fn", "def").orderBy("line")
    d = stmts.filter("def IS NOT NULL").select("fn", F.col("line").alias("src"), F.lead("line").over(w).alias("dst"), F.col("def").alias("var"))
    return d.filter("dst IS NOT NULL")


def _key(fn: str, line: str) -> Column:
    return F.concat_ws("#", F.col(fn).cast("string"), F.col(line).cast("string"))


def _reach_inside(deps: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """As reach(), for edges (fn, src, dst) between ids ``<fn>#<line>``: none leaves its
    function, so each function is walked by itself."""
    edges = deps.select(F.coalesce(F.col("fn").cast("string"), F.lit("")).alias("fn"), "src", "dst")
    roots = seeds.select(F.regexp_extract("id", "(?s)^(.*)#", 1).alias("fn"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"))

    def one(rows: list[tuple[str, str | None]]) -> list[tuple[str, int]]:
        after: dict[str, list[str]] = {}
        hops: dict[str, int] = {}
        for s, d in rows:
            if d is None:
                hops[s] = 0
            else:
                after.setdefault(s, []).append(d)
        front, n = list(hops), 0
        while front and (depth is None or n < depth):
            n, new = n + 1, []
            for s in front:
                for d in after.get(s, ()):
                    if d not in hops:
                        hops[d] = n
                        new.append(d)
            front = new
        return list(hops.items())

    return per_key(edges.union(roots), one, "fn string, id string, hops bigint").select("id", "hops")


def slice_of(deps: DataFrame, seeds: DataFrame, backward: bool = True, depth: int | None = None) -> DataFrame:
    """(id, hops): statements ``<fn>#<line>`` that the seeds depend on, or that depend on them."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    return _reach_inside(deps.select("fn", _key("fn", a).alias("src"), _key("fn", b).alias("dst")), seeds, depth)


def taint(deps: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """(id, hops): sinks that data from the sources reaches without passing a sanitizer;
    all three have id ``<fn>#<line>``."""
    e = deps.select("fn", _key("fn", "src").alias("src"), _key("fn", "dst").alias("dst")).join(sanitizers.select(F.col("id").alias("dst")), "dst", "left_anti").select("fn", "src", "dst")
    clean = sources.join(sanitizers, "id", "left_anti")
    return _reach_inside(e, clean).filter("hops > 0").join(sinks, "id", "left_semi")


def _tree(edges: list[tuple[int, int]], entry: int) -> dict[int, int]:
    """Immediate dominators of what ``entry`` reaches; its own is itself."""
    after: dict[int, list[int]] = {}
    for s, d in edges:
        after.setdefault(s, []).append(d)
    order, seen, stack = [], {entry}, [(entry, iter(after.get(entry, ())))]
    while stack:
        node, more = stack[-1]
        for d in more:
            if d not in seen:
                seen.add(d)
                stack.append((d, iter(after.get(d, ()))))
                break
        else:
            stack.pop()
            order.append(node)
    order.reverse()
    rank = {b: k for k, b in enumerate(order)}
    before: dict[int, list[int]] = {}
    for s in order:
        for d in after.get(s, ()):
            before.setdefault(d, []).append(s)
    idom, moved = {entry: entry}, True
    while moved:
        moved = False
        for b in order[1:]:
            new = None
            for p in before[b]:
                if p in idom:
                    x = p
                    while new is not None and x != new:
                        if rank[x] > rank[new]:
                            x = idom[x]
                        else:
                            new = idom[new]
                    new = x
            if idom.get(b) != new:
                idom[b], moved = new, True
    return idom


def _ways(cfg: DataFrame) -> DataFrame:
    return cfg.select("fn", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))


def dominators(cfg: DataFrame, entry: int = 0) -> DataFrame:
    """(fn, block, idom): immediate dominators of the blocks that ``entry`` reaches."""
    kind = cfg.schema["fn"].dataType.simpleString()
    return per_key(_ways(cfg), lambda edges: [x for x in _tree(edges, entry).items() if x[0] != entry], f"fn {kind}, block bigint, idom bigint")


def post_dominators(cfg: DataFrame, exit_: int) -> DataFrame:
    return dominators(cfg.select("fn", F.col("dst").alias("src"), F.col("src").alias("dst")), exit_)


def unreachable(cfg: DataFrame, entry: int = 0) -> DataFrame:
    """(fn, block) that no way leads to from ``entry``."""
    key = lambda c: _key("fn", c)
    every = cfg.select("fn", F.col("src").alias("block")).union(cfg.select("fn", "dst")).distinct()
    seeds = cfg.select(F.concat_ws("#", F.col("fn").cast("string"), F.lit(str(entry))).alias("id")).distinct()
    live = reach(cfg.select(key("src").alias("src"), key("dst").alias("dst")), seeds).select("id")
    return every.withColumn("id", key("block")).join(live, "id", "left_anti").select("fn", "block")


def simple_paths(cfg: DataFrame, entry: int, exit_: int, most: int = 1000) -> DataFrame:
    """(fn, path): up to ``most`` acyclic ways from entry to exit."""

    def one(edges: list[tuple[int, int]]) -> list[tuple[str]]:
        after: dict[int, set[int]] = {}
        for s, d in edges:
            after.setdefault(s, set()).add(d)
        ways = {s: sorted(ds, reverse=True) for s, ds in after.items()}
        found, stack = [], [(entry,)]
        while stack and len(found) < most:
            path = stack.pop()
            if path[-1] == exit_:
                found.append((",".join(map(str, path)),))
                continue
            stack += [(*path, d) for d in ways.get(path[-1], ()) if d not in path]
        return found

    return per_key(_ways(cfg), one, f"fn {cfg.schema['fn'].dataType.simpleString()}, path string")


def frontiers(cfg: DataFrame, entry: int = 0) -> DataFrame:
    """(fn, block, frontier): where a block's dominance ends. On the reversed graph, from the
    exit, these are the blocks that a block is control dependent on."""

    def one(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        up, found = _tree(edges, entry), set()
        for s, d in set(edges):
            x = s
            # A way into d from a block that d's dominator is above: all between end there.
            while x in up and d in up and x != (up[d] if d != entry else None):
                found.add((x, d))
                if x == entry:
                    break
                x = up[x]
        return sorted(found)

    return per_key(_ways(cfg), one, f"fn {cfg.schema['fn'].dataType.simpleString()}, block bigint, frontier bigint")


def control_dependencies(cfg: DataFrame, exit_: int = -1) -> DataFrame:
    """(fn, src, dst): whether dst runs is decided at src."""
    back = cfg.select("fn", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return frontiers(back, exit_).select("fn", F.col("frontier").alias("src"), F.col("block").alias("dst"))


def _reached(rows: list[tuple]) -> dict[tuple[str, int], set[int]]:
    """By variable and line of a definition, the blocks at whose start it holds. Rows: (kind,
    line, next, var, uses) of ways (kind 0) and statements (kind 1)."""
    after: dict[int, set[int]] = {}
    made: dict[str, set[int]] = {}
    for kind, line, to, var, _ in rows:
        if kind == 0:
            after.setdefault(line, set()).add(to)
        elif var is not None:
            made.setdefault(var, set()).add(line)
    found = {}
    for var, lines in made.items():
        for line in lines:
            seen = set(after.get(line, ()))
            stack = list(seen)
            while stack:
                at = stack.pop()
                if at not in lines:
                    new = after.get(at, set()) - seen
                    seen |= new
                    stack += new
            found[var, line] = seen
    return found


def _both(stmts: DataFrame, cfg: DataFrame) -> DataFrame:
    """Ways and statements in one table, for _reached()."""
    uses = "uses" if "uses" in stmts.columns else "CAST(array() AS array<string>) AS uses"
    ways = cfg.filter("src IS NOT NULL AND dst IS NOT NULL").selectExpr("fn", "0 AS kind", "CAST(src AS bigint) AS line", "CAST(dst AS bigint) AS next", "CAST(NULL AS string) AS def", "CAST(NULL AS array<string>) AS uses")
    own = stmts.filter("line IS NOT NULL").selectExpr("fn", "1 AS kind", "CAST(line AS bigint) AS line", "CAST(NULL AS bigint) AS next", "def", uses)
    return ways.unionByName(own).filter("fn IS NOT NULL")


def reaching_definitions(stmts: DataFrame, cfg: DataFrame) -> DataFrame:
    """(fn, var, src, at): definitions (fn, line, def) that hold at the start of a block of the
    graph (fn, src, dst). They move on past blocks that do not define the variable again."""
    run = lambda rows: [(var, line, at) for (var, line), ats in _reached(rows).items() for at in ats]
    return per_key(_both(stmts, cfg), run, f"fn {cfg.schema['fn'].dataType.simpleString()}, var string, src bigint, at bigint")


def data_dependencies(stmts: DataFrame, cfg: DataFrame) -> DataFrame:
    """(fn, src, dst, var, carried): uses and the definitions that reach them along the graph;
    carried: round a loop, from a line that is not before the use."""

    def one(rows: list[tuple]) -> list[tuple]:
        used: dict[int, list[set[str]]] = {}
        for kind, line, _, _, uses in rows:
            if kind == 1 and uses:
                used.setdefault(line, []).append(set(uses))
        return [(src, at, var, src >= at) for (var, src), ats in _reached(rows).items() for at in ats for uses in used.get(at, ()) if var in uses]

    return per_key(_both(stmts, cfg), one, f"fn {cfg.schema['fn'].dataType.simpleString()}, src bigint, dst bigint, var string, carried boolean")


def anti_dependencies(stmts: DataFrame) -> DataFrame:
    """(fn, src, dst, var): a use and the next definition of its variable, later or on its line."""
    uses = stmts.select("fn", F.col("line").alias("at"), F.explode(F.array_distinct("uses")).alias("var"), F.lit(0).alias("kind"))
    defs = stmts.filter("def IS NOT NULL").select("fn", F.col("line").alias("at"), F.col("def").alias("var"), F.lit(1).alias("kind"))
    w = Window.partitionBy("fn", "var").orderBy("at", "kind").rowsBetween(1, Window.unboundedFollowing)
    later = F.first(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(w)
    both = uses.unionByName(defs).withColumn("dst", later)
    return both.filter("kind = 0 AND dst IS NOT NULL").select("fn", F.col("at").alias("src"), "dst", "var")


def flow_depth(deps: DataFrame) -> DataFrame:
    """(id, depth): least number of dependencies from a statement that depends on nothing."""

    def one(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        after: dict[int, set[int]] = {}
        for s, d in edges:
            after.setdefault(s, set()).add(d)
        depth = dict.fromkeys(set(after).difference(*after.values()), 0)
        front, n = list(depth), 0
        while front:
            n += 1
            front = list({d for s in front for d in after.get(s, ()) if d not in depth})
            depth |= dict.fromkeys(front, n)
        return list(depth.items())

    kind = deps.schema["fn"].dataType.simpleString()
    met = per_key(_ways(deps.filter("src <> dst")), one, f"fn {kind}, line bigint, depth bigint")
    return met.select(_key("fn", "line").alias("id"), "depth")


def alias_names(stmts: DataFrame) -> DataFrame:
    """(id, component) of names ``<fn>#<name>`` that may stand for one thing: a field and its
    base, and both sides of a plain copy."""
    name = lambda c: F.concat_ws("#", F.col("fn").cast("string"), c)
    every = stmts.select("fn", F.explode(F.concat(F.array("def"), "uses")).alias("x")).filter("x LIKE '%.%'")
    fields = every.select(name(F.col("x")).alias("src"), name(F.substring_index("x", ".", 1)).alias("dst"))
    plain = stmts.filter("def IS NOT NULL AND size(uses) = 1").select("fn", "def", F.element_at("uses", 1).alias("use")).filter("def NOT LIKE '%.%' AND use NOT LIKE '%.%'")
    return components(fields.union(plain.select(name(F.col("def")), name(F.col("use")))))
