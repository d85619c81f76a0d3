"""One object for a graph and all that can be asked of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import rules
from lattica.graph import PropertyGraph
from lattica.operators import algorithms, history, similarity, verbs
from lattica.plans import gql, iterate
from lattica.sources import exports


@dataclass(frozen=True)
class Engine:
    """Verbs over a property graph; each returns a DataFrame unless it says otherwise."""

    graph: PropertyGraph

    @staticmethod
    def open(spark: SparkSession, path: str) -> Engine:
        return Engine(PropertyGraph.read(spark, path))

    def _seeds(self, *names: str) -> DataFrame:
        ids = [(verbs.resolve(self.graph, n),) for n in names]
        return self.graph.spark.createDataFrame(ids, "id string")

    @property
    def calls(self) -> DataFrame:
        return self.graph.edges_of("calls").select("src", "dst")

    def gql(self, text: str, communities: DataFrame | None = None) -> DataFrame:
        return gql.run(self.graph, text, communities)

    def explain(self, text: str) -> list[dict]:
        return gql.explain(self.graph, text)

    def find(self, pattern: str | None = None, **filters) -> DataFrame:
        return verbs.find(self.graph, pattern, **filters)

    def callers(self, *names: str, depth: int = 1) -> DataFrame:
        return verbs.callers(self.graph, self._seeds(*names), depth)

    def callees(self, *names: str, depth: int = 1) -> DataFrame:
        return verbs.callees(self.graph, self._seeds(*names), depth)

    def relations(self, edge_type: str, direction: str = "out") -> DataFrame:
        return verbs.relations(self.graph, edge_type, direction)

    def inventory(self, by: str) -> DataFrame:
        return verbs.edge_inventory(self.graph) if by == "edge" else verbs.inventory(self.graph, by)

    def blast_radius(self, *names: str) -> DataFrame:
        return algorithms.blast(self.calls, self._seeds(*names) if names else None)

    def dead_code(self, roots: DataFrame) -> DataFrame:
        return algorithms.dead_code(self.graph.nodes.filter("node_type = 'function'"), self.graph.edges, roots)

    def metrics(self) -> DataFrame:
        """id with PageRank, degrees and risk, null where a node has none."""
        d = algorithms.degree(self.calls)
        r = algorithms.risk(self.graph.nodes, self.calls).select("id", "risk")
        return algorithms.pagerank(self.graph.nodes, self.calls).join(d, "id", "left").join(r, "id", "left")

    def communities(self) -> DataFrame:
        return algorithms.communities(self.graph.edges_of("calls", "uses", "references").select("src", "dst"))

    def cycles(self) -> DataFrame:
        return algorithms.cycles(self.calls)

    def components(self) -> DataFrame:
        return iterate.components(self.graph.edges.select("src", "dst"), self.graph.nodes)

    def clones(self, min_lines: int = 5) -> DataFrame:
        return similarity.exact_clones(self.graph.nodes, min_lines)

    def diff(self, head: PropertyGraph) -> tuple[DataFrame, DataFrame]:
        """Changed nodes by id, spans left out, and changed edges."""
        digest = F.xxhash64(F.to_json(F.struct("node_type", "name", "qualified_name", "signature", "code_hash", "properties", "labels")))
        nodes = [g.nodes.select("id", digest) for g in (self.graph, head)]
        return history.diff_nodes(*nodes), history.diff_edges(*[g.edges.select("src", "dst", "edge_type") for g in (self.graph, head)])

    def merge(self, other: PropertyGraph, names: tuple[str, str]) -> Engine:
        return Engine(self.graph.union(other, names))

    def label(self, ruleset: str) -> Engine:
        return Engine(PropertyGraph(rules.apply(self.graph.nodes, ruleset), self.graph.edges))

    def export(self, form: str, path: str) -> None:
        """Write ``json``, ``graphml``, ``dot`` or ``mermaid``."""
        if form == "json":
            exports.json_lines(self.graph).write.text(path)
        else:
            exports.save({"graphml": exports.graphml, "dot": exports.dot, "mermaid": exports.mermaid}[form](self.graph), path)
