"""Work that must not grow with pairs, rounds or one call for each key."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.operators import algorithms as A
from lattica.operators import centrality as C
from lattica.operators import flow as N
from lattica.operators import history as H
from lattica.operators import resolution as RS
from lattica.queries import QUERIES
from lattica.sources import python_source as PY


def test_files_share_batches(spark):
    source = "def f(a):\n    b = a\n    while b:\n        b = g(b)\n    return b\n"
    files = spark.range(0, 6000, 1, 1).selectExpr("concat('m', id, '.py') AS path", f"{source!r} AS content")
    assert PY.control_flow(files.limit(1)).count() == 6  # the session's first Python worker takes seconds
    began = time.time()
    for k in range(6000):
        list(PY.flow(f"m{k}.py", source))
    plain, began = time.time() - began, time.time()
    assert PY.control_flow(files).count() == 6000 * 6
    assert time.time() - began < 3 * plain + 2, plain


def _cfg(spark):
    return spark.createDataFrame([(f, a, b) for f in (1, 2) for a, b in ((0, 1), (1, 2), (2, 1), (1, 3), (3, -1))], "fn int, src long, dst long")


def test_functions_share_batches(spark):
    cfg = _cfg(spark)
    for made in (N.dominators(cfg), N.post_dominators(cfg, -1), N.frontiers(cfg), N.control_dependencies(cfg), N.simple_paths(cfg, 0, -1)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and {r[0] for r in made.collect()} == {1, 2}


def test_functions_are_walked_without_rounds(spark):
    cfg = _cfg(spark)
    stmts = spark.createDataFrame([(f, *x) for f in (1, 2) for x in ((0, "a", []), (1, "b", ["a", "b"]), (2, "b", ["b"]), (3, None, ["b"]))], "fn int, line long, def string, uses array<string>")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    spark.sparkContext.setJobGroup("rounds", "")
    deps = N.data_dependencies(stmts, cfg)
    made = [N.reaching_definitions(stmts, cfg), deps, N.flow_depth(deps.filter("NOT carried")), N.slice_of(deps, ids("1#3", "x")), N.taint(deps, ids("1#0"), ids("1#3", "2#3"), ids("1#2"))]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")
    rows = [sorted(tuple(r) for r in m.collect()) for m in made]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows[0] == sorted((f, *x) for f in (1, 2) for x in [("a", 0, k) for k in (1, 2, 3, -1)] + [("b", 1, k) for k in (2, 3)] + [("b", 1, -1), ("b", 2, 1)])
    assert rows[1] == sorted((f, *x) for f in (1, 2) for x in [(0, 1, "a", False), (1, 2, "b", False), (1, 3, "b", False), (2, 1, "b", True)])
    assert rows[2] == sorted((f"{f}#{k}", n) for f in (1, 2) for k, n in ((0, 0), (1, 1), (2, 2), (3, 2)))
    assert rows[3] == [("1#0", 2), ("1#1", 1), ("1#2", 2), ("1#3", 0), ("x", 0)]
    assert rows[4] == [("1#3", 2)]


def test_hot_paths_and_names(spark):
    """40 thousand rows on either side that all share a path and a name."""
    many = spark.range(40_000)
    began = time.time()
    sites, spans = many.selectExpr("id AS site", "'p' AS path", "id AS line"), many.selectExpr("id", "'p' AS path", "id AS start_line", "id + 100 - id % 100 AS end_line")
    got = H.enclosing(sites, spans).agg(F.sum("id"), F.count("id")).first()
    # A line that is a hundred is also the end of the span of the line before, which is smaller.
    assert got == (sum(range(40_000)) - 399, 40_000)
    relations = many.selectExpr("id AS rel", "'p' AS path", "'n' AS name", "concat('b.q', id) AS hint", "0 AS repo", "'x/y' AS module")
    symbols = many.selectExpr("id", "if(id = 7, 'p', 'o') AS path", "'n' AS name", "concat('a.b.q', id) AS qualified_name", "int(id <> 9) AS repo")
    assert RS.resolve_relations(relations, symbols).groupBy("id", "tier").count().collect() == [(7, 1, 40_000)]
    hinted = RS.resolve_relations(relations.withColumn("path", F.lit("z")), symbols)
    assert hinted.filter("rel = id AND tier = 3").count() == 40_000
    assert RS.parked(relations.withColumn("repo", F.lit(1)), symbols).groupBy("id", "tier").count().collect() == [(9, 3, 40_000)]
    assert time.time() - began < 60


def test_enclosing_and_parked_against_brute_force(spark):
    r = random.Random(5)
    spans = [(i, r.choice("ab"), s := r.randrange(-60, 60), s + r.choice([-1, 0, 1, 2, 7, 8, 31, 64])) for i in range(150)]
    sites = [(i, r.choice("abc"), r.randrange(-70, 130)) for i in range(300)]
    want = {k: min((b - a, i) for i, p, a, b in spans if p == path and a <= x <= b)[1] for k, path, x in sites if any(p == path and a <= x <= b for _, p, a, b in spans)}
    got = H.enclosing(spark.createDataFrame(sites, "site long, path string, line long"), spark.createDataFrame(spans, "id long, path string, start_line long, end_line long"))
    assert {x["site"]: x["id"] for x in got.collect()} == want
    ways = ["a/b/c", "b/c", "c", "d", "x/c", ""]
    rel = [(i, r.randrange(4), r.choice([None, "q1", "q2"]), r.choice(ways), r.choice("mn")) for i in range(120)]
    sym = [(i, r.randrange(4), r.choice(["q1", "q2", "q3", "q4"]), r.choice(ways), r.choice("mnop")) for i in range(14)]
    want = {}
    for k, repo, hint, module, name in rel:
        there = [x for x in sym if x[1] != repo]
        named = [x for x in there if x[4] == name]
        shared = [next((n for n, (u, v) in enumerate(zip(a, b, strict=False)) if u != v), min(len(a), len(b))) for x in named for a, b in [([s for s in module.split("/")[::-1] if s], [s for s in x[3].split("/")[::-1] if s])]]
        top = max(shared, default=0)
        for tier, ids in enumerate([[x[0] for x in there if x[2] == hint], [x[0] for x, n in zip(named, shared, strict=True) if n == top > 0], [x[0] for x in named]], 1):
            if len(ids) == 1 and k not in want:
                want[k] = (ids[0], tier)
    got = RS.parked(spark.createDataFrame(rel, "rel long, repo int, hint string, module string, name string"), spark.createDataFrame(sym, "id long, repo int, qualified_name string, path string, name string"))
    assert want and {x["rel"]: (x["id"], x["tier"]) for x in got.collect()} == want


def test_pairs_through_a_hub_are_not_made(spark, monkeypatch):
    """120 callers of a cycle that calls 120 others: 14400 pairs lead through it."""
    made, plain = [], A.closure
    monkeypatch.setattr(A, "closure", lambda *x: made.append(plain(*x)) or made[-1])
    edges = [(i, 1000) for i in range(120)] + [(1000, 1001), (1001, 1000)] + [(1001, 2000 + i) for i in range(120)] + [(1, 3000), (3000, 2000), (4000, 2001)]
    got = {r["id"]: r["reach"] for r in A.reach_centrality(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == dict.fromkeys([*range(120), 4000], 1) | dict.fromkeys((1000, 1001), 121) | {2000 + i: 122 for i in range(120)} | {3000: 2, 2000: 123, 2001: 123}
    assert sum(m.count() for m in made) < 200


def test_sketches_stay_in_their_tasks(spark, monkeypatch):
    """Balls of a round are neither shuffled nor checkpointed, and sketches are near what they estimate."""
    made, plain = [], C.cut
    for module in (A, C):
        monkeypatch.setattr(module, "cut", lambda df: made.append(df.schema) or plain(df))
    r = random.Random(2)
    edges = spark.createDataFrame([(r.randrange(300), r.randrange(300)) for _ in range(500)] + [(1000 + i, 1001 + i) for i in range(9)], "src long, dst long")
    exact = {x["id"]: x["harmonic"] for x in A.hyperball(edges, rounds=60).collect()}
    assert all(f.dataType.simpleString() != "binary" for s in made for f in s.fields)
    assert exact == pytest.approx({x["id"]: x["harmonic"] for x in A.harmonic(edges).collect()})
    monkeypatch.setattr(C, "EXACT_NODES", 50)
    monkeypatch.setattr(C, "TASK_WORK", 30_000)  # several tasks have a share of each sketch
    near = {x["id"]: x["harmonic"] for x in A.hyperball(edges, rounds=60).collect()}
    assert near.keys() == exact.keys() and near == pytest.approx(exact, rel=0.05)


def test_sketches_of_one_large_component_fit_a_task():
    """Sketches of a million nodes in one component grow by few registers at once."""
    n, r = 1_000_000, np.random.default_rng(3)
    src, dst = r.integers(0, n, 3 * n // 2), r.integers(0, n, 3 * n // 2)
    cols = {"src": src, "dst": dst, "component": np.zeros(len(src), np.int64), "asked": np.ones(len(src), bool)}
    graph = C._Graph(pa.table({k: pa.chunked_array([v]) for k, v in cols.items()}))
    tracemalloc.start()
    C._sketched(graph, 0, 2, 6, 8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 450 << 20


def _one_graph(edges):
    edges = np.unique(np.array(edges), axis=0)
    cols = {"src": edges[:, 0], "dst": edges[:, 1], "component": np.zeros(len(edges), np.int64), "asked": np.ones(len(edges), bool)}
    return C._Graph(pa.table({k: pa.chunked_array([v]) for k, v in cols.items()}))


def test_closeness_against_brute_force(monkeypatch):
    """Hubs, ends, loops, chains and rings whose nodes have one predecessor, with few words and rows at once, in shares, and up to few edges away."""
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(450)] + [(0, x) for x in range(0, 300, 3)] + [(x, 1) for x in range(0, 300, 4)] + [(5, 5)]
    edges += [(300 + i, 301 + i) for i in range(40)] + [(340, 7), (400, 401), (401, 402), (402, 400), (402, 403), (403, 3), (500, 501), (501, 300)]
    graph = _one_graph(edges)
    after = {int(x): {t for s, t in edges if s == x} for x in graph.ids.to_pylist()}
    monkeypatch.setattr(C, "BALL_WORDS", 8, raising=False)
    monkeypatch.setattr(C, "PULLED", 50, raising=False)
    for rounds in (1, 4, 1000):
        want = []
        for x in after:
            seen, front, hops, total = {x}, {x}, 0, 0.0
            while front and hops < rounds:
                hops, front = hops + 1, {t for y in front for t in after[y]} - seen
                total, seen = total + len(front) / hops, seen | front
            want.append(total)
        for parts in (1, 3):
            assert sum(C._closeness(graph, k, parts, rounds) for k in range(parts)) == pytest.approx(want)


def test_closeness_of_one_large_component_is_fast():
    """A share of the targets of 500 thousand nodes in one component."""
    n, r = 500_000, np.random.default_rng(5)
    graph = _one_graph(np.stack([r.integers(0, n, 17 * n // 10), r.integers(0, n, 17 * n // 10)], axis=1))
    began = time.process_time()
    C._closeness(graph, 3, 50)
    assert time.process_time() - began < 25


def test_small_components_are_sketched(spark, monkeypatch):
    """Only a small graph is counted exactly, not small components of a larger one; the query always sketches."""
    edges = spark.createDataFrame([(100 * k + i, 100 * k + (i + 1) % 40) for k in range(3) for i in range(40)], "src long, dst long")
    want = sum(1 / k for k in range(1, 40)) / 119
    values = lambda **more: [x["harmonic"] for x in A.hyperball(edges, rounds=60, **more).collect()]
    assert values() == pytest.approx([want] * 120)
    monkeypatch.setattr(C, "EXACT_NODES", 50)
    for near in (values(), values(exact=0)):
        assert near == pytest.approx([want] * 120, rel=0.05) and all(abs(x - want) > 1e-6 for x in near)
    used = []
    monkeypatch.setattr(A, "hyperball", lambda e, **more: used.append(more) or e.selectExpr("src AS id", "0D AS harmonic"))
    QUERIES["G06_hyperball"](spark, "/root/testdata/sf0.001")
    assert used == [{"exact": 0}]


def test_sources_walk_their_own_component(spark):
    """Work must not grow with sources times the nodes of the whole graph: 300 thousand nodes in cycles of three."""
    n = 300_000
    cycles = spark.range(n).selectExpr("id AS src", "id - id % 3 + (id + 1) % 3 AS dst")
    began = time.time()
    assert A.harmonic(cycles).groupBy(F.round(F.col("harmonic") * (n - 1), 6).alias("h")).count().collect() == [(1.5, n)]
    got = A.centrality(cycles).select(F.round(F.col("betweenness") * (n - 1.0) * (n - 2.0), 6).alias("b"), F.round(F.col("harmonic") * (n - 1), 6).alias("h"))
    assert got.groupBy("b", "h").count().collect() == [(1.0, 1.5, n)]
    assert time.time() - began < 90


def test_betweenness_in_parts_against_brute_force(spark, monkeypatch):
    """Sources of a component dealt to several tasks, with few cells a batch."""
    monkeypatch.setattr(C, "TASK_WORK", 800)
    monkeypatch.setattr(C, "CELLS", 100)
    r = random.Random(4)
    edges = [(k + r.randrange(30), k + r.randrange(30)) for k in (0, 100) for _ in range(50)]
    after = {x: {t for s, t in edges if s == x} for e in edges for x in e}
    want = dict.fromkeys(after, 0.0)
    for s in after:
        ways, front = {s: [[s]]}, {s: [[s]]}
        while front:
            step = {}
            for x, paths in front.items():
                for t in after[x] - ways.keys():
                    step.setdefault(t, []).extend([*p, t] for p in paths)
            front = step
            ways |= step
        for paths in ways.values():
            for x in [x for p in paths for x in p[1:-1]]:
                want[x] += 1 / len(paths)
    n = len(after)
    got = {x["id"]: x["betweenness"] * (n - 1) * (n - 2) for x in A.centrality(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == pytest.approx(want)


def test_swept_paths_against_walks(spark, monkeypatch):
    """Few nodes cut all cycles of a sparse graph: only those are walked from, whatever the shares of
    targets, the blocks, and the pivots; of a dense graph all are."""
    r = random.Random(6)
    ring = [(i, (i * 7 + k) % 200) for i in range(200) for k in (1, 3)]
    sparse = [(x, r.randrange(900)) for x in range(900) for _ in range(r.choice([0, 1, 1, 2, 2]))] + [(5, 5)]
    walked, walks = [], C._walks
    monkeypatch.setattr(C, "_walks", lambda graph, sources: walked.append(len(sources)) or walks(graph, sources))
    for edges, few in ((sparse, True), (ring, False)):
        edges = sorted(set(edges))
        for share in (1, 0.7):
            asked = {x: r.random() < share for e in edges for x in e}
            cols = {"src": [e[0] for e in edges], "dst": [e[1] for e in edges], "component": [0] * len(edges), "asked": [asked[e[0]] for e in edges]}
            graph = C._Graph(pa.table({k: pa.chunked_array([v]) for k, v in cols.items()}))
            want = C._walked(graph, 0, 1)
            for cells, held, chunk in ((1 << 23, 1 << 25, 64), (1 << 14, 3000, 7)):
                monkeypatch.setattr(C, "SWEPT_CELLS", cells)
                monkeypatch.setattr(C, "SWEPT", held)
                monkeypatch.setattr(C, "CHUNK", chunk)
                for parts in (1, 2):
                    walked.clear()
                    got = [C._paths(graph, True, k, parts) for k in range(parts)]
                    if few and held > 3000:
                        assert sum(walked) < len(asked) / 2
                    for a, b in zip(zip(*got, strict=True), want, strict=True):
                        assert sum(a) == pytest.approx(b)
    monkeypatch.setattr(C, "TASK_WORK", 1000)  # many tasks share the component
    table = spark.createDataFrame(sorted(set(sparse)), "src long, dst long")
    many = {x["id"]: (x["betweenness"], x["harmonic"]) for x in A.centrality(table).collect()}
    monkeypatch.setattr(C, "TASK_WORK", 1 << 40)
    assert {k: pytest.approx(v) for k, v in many.items()} == {x["id"]: (x["betweenness"], x["harmonic"]) for x in A.centrality(table).collect()}
