from pyspark.sql import functions as F
import pytest

from lattica.engine import Engine
from lattica.functions import rules
from lattica.graph import PropertyGraph, as_edges, as_nodes
from lattica.operators import resolution as R


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_linearised(spark):
    up = [("A", 0, "O"), ("B", 0, "A"), ("C", 0, "A"), ("D", 0, "B"), ("D", 1, "C"), ("X", 0, "Y"), ("Y", 0, "X")]
    parents = spark.createDataFrame(up, "type string, pos int, parent string")
    groups = spark.createDataFrame([(t, 1) for t in "ABCD"] + [("X", 2), ("Y", 2)], "type string, group int")
    got = {}
    for t, k, a in rows(R.linearised(parents, groups)):
        got.setdefault(t, []).append(a)
    assert got["D"] == ["D", "B", "C", "A", "O"] and got["X"] == ["X", "Y"]
    depth = [a for t, k, a in rows(R.linearised(parents, groups, "depth")) if t == "D"]
    assert depth == ["D", "B", "A", "O", "C"]


def test_resolution_is_unique(spark):
    symbols = spark.createDataFrame([("1", "a.py", "f", "a.f"), ("2", "b.py", "f", "b.f"), ("3", "b.py", "g", "b.C.g")], "id string, path string, name string, qualified_name string")
    rel = spark.createDataFrame([(1, "a.py", "f", None), (2, "c.py", "f", None), (3, "c.py", "f", "b.f"), (4, "c.py", "g", "C.g"), (5, "c.py", "h", None)], "rel int, path string, name string, hint string")
    assert rows(R.resolve_relations(rel, symbols)) == [(1, "1", 1), (3, "2", 2), (4, "3", 3)]


def test_rules(spark):
    with pytest.raises(rules.RuleError):
        rules.condition({"colour": "red"})
    with pytest.raises(rules.RuleError):
        rules.statement_rule({})


def test_engine(spark, tmp_path):
    nodes = as_nodes(spark.createDataFrame([("a", "function", "main"), ("b", "function", "x")], "id string, node_type string, name string"))
    engine = Engine(PropertyGraph(nodes, as_edges(spark.createDataFrame([("a", "b", "calls")], "src string, dst string, edge_type string"))))
    assert rows(engine.callers("x").select("id", "hops")) == [("a", 1)]
    assert rows(engine.blast_radius("x").select("id", "impact")) == [("b", 1)]
    changed = PropertyGraph(nodes.withColumn("name", F.when(F.col("id") == "b", "y").otherwise(F.col("name"))), engine.graph.edges)
    n, e = engine.diff(changed)
    assert rows(n) == [("b", "changed")] and e.count() == 0
    engine.export("json", str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == 3
    assert engine.merge(changed, ("one", "two")).graph.nodes.count() == 4
    assert {r["id"] for r in engine.metrics().collect()} == {"a", "b"}
