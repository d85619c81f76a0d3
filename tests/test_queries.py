"""Each registered graph query against its SQL on the smallest tables."""

import duckdb
import pytest

from lattica.queries import ORACLE_SQL, QUERIES, _calls

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def normal(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


#: Without SQL, and held against brute force below.
WHOLE = {f"G{x}" for x in "05_harmonic 06_hyperball 08_strong_components 09_condensation 11_blast 13_reach 16_cycles 25_topological 26_recursive".split()}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WHOLE))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = normal(tuple(r[c] for c in columns) for r in df.collect())
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name])
        at = [want.columns.index(c) for c in columns]
        assert len(want.columns) == len(columns)
        assert rows == normal(tuple(r[i] for i in at) for r in want.fetchall())
    else:
        assert rows


@pytest.fixture(scope="module")
def sparse(spark, small):
    """The sparse call graph, what each node reaches, and each node's strong component."""
    edges = {(r["src"], r["dst"]) for r in _calls(spark, small).collect()}
    nodes = {x for e in edges for x in e}
    reach = {x: {t for s, t in edges if s == x} for x in nodes}
    for k in nodes:
        for x in nodes:
            if k in reach[x]:
                reach[x] |= reach[k]
    top = {x: min([x, *(y for y in reach[x] if x in reach[y])]) for x in nodes}
    return edges, nodes, reach, top


def test_whole_sparse_graph(spark, small, sparse):
    """Queries on all edges of the sparse call graph, which is too much for SQL, against brute force."""
    edges, nodes, reach, top = sparse
    got = lambda name: QUERIES[name](spark, small).collect()
    assert {r["id"] for r in got("G06_hyperball")} == nodes
    between = {(top[s], top[t]) for s, t in edges if top[s] != top[t]}
    level = {x: 0 for e in between for x in e}
    for _ in level:
        for s, t in between:
            level[t] = max(level[t], level[s] + 1)
    assert {r["id"]: r["level"] for r in got("G25_topological")} == level
    assert {r["id"]: r["component"] for r in got("G08_strong_components")} == top
    assert {(r["src"], r["dst"]) for r in got("G09_condensation")} == between
    size = {c: sum(t == c for t in top.values()) for c in top.values()}
    assert {r["component"]: r["size"] for r in got("G16_cycles")} == {c: n for c, n in size.items() if n > 1}
    assert {r["id"] for r in got("G26_recursive")} == {x for x in nodes if x in reach[x]}


def test_whole_sparse_closures(spark, small, sparse):
    edges, nodes, reach, top = sparse
    above = {x: {y for y in nodes if x in reach[y]} for x in nodes}
    for r in QUERIES["G11_blast"](spark, small).collect():
        near = {top[s] for s, t in edges if top[t] == top[r["id"]] and top[s] != top[t]}
        direct, impact = sum(c in near for c in top.values()), len(above[r["id"]] - {r["id"]})
        assert (r["direct"], r["impact"]) == (direct, impact)
        assert r["score"] == pytest.approx(min(25 * direct, 40) + min(0.05 * impact, 60))
    for r in QUERIES["G13_reach"](spark, small).collect():
        assert r["reach"] == len({top[y] for y in above[r["id"]]} | {top[r["id"]]})
    after = {x: {t for s, t in edges if s == x} for x in nodes}
    for r in QUERIES["G05_harmonic"](spark, small).collect():
        far, front, hops, total = {r["id"]}, {r["id"]}, 0, 0.0
        while front:
            hops, front = hops + 1, {t for x in front for t in after[x]} - far
            total, far = total + len(front) / hops, far | front
        assert r["harmonic"] == pytest.approx(total / (len(nodes) - 1), abs=1e-7)
