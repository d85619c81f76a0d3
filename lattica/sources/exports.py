"""Graphs as JSON, GraphML, Graphviz and Mermaid lines. Each is a DataFrame of lines in order
(``part``, ``n``, ``line``), which ``save`` writes as one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.graph import PropertyGraph


def json_lines(graph: PropertyGraph) -> DataFrame:
    nodes = graph.nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *graph.nodes.columns)).alias("line"))
    return nodes.union(graph.edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), *graph.edges.columns))))


def _lines(head: str, nodes: DataFrame, node: Column, edges: DataFrame, edge: Column, foot: str) -> DataFrame:
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "", head), (3, "", foot)], "part int, n string, line string")
    body = nodes.select(F.lit(1).alias("part"), F.col("id").alias("n"), node.alias("line")).union(edges.select(F.lit(2), F.concat_ws(">", "src", "dst", "edge_type"), edge))
    return ends.union(body)


def graphml(graph: PropertyGraph) -> DataFrame:
    e = T.escaped
    node = F.concat(F.lit('<node id="'), e(F.col("id")), F.lit('"><data key="name">'), e(F.coalesce("name", F.lit(""))), F.lit('</data><data key="type">'), e(F.col("node_type")), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), e(F.col("src")), F.lit('" target="'), e(F.col("dst")), F.lit('"><data key="type">'), e(F.col("edge_type")), F.lit("</data></edge>"))
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="name" for="node" attr.name="name" attr.type="string"/><key id="type" for="all" attr.name="type" attr.type="string"/><graph edgedefault="directed">'
    return _lines(head, graph.nodes, node, graph.edges, edge, "</graph></graphml>")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))


def dot(graph: PropertyGraph) -> DataFrame:
    node = F.concat(F.lit("  "), _quoted(F.col("id")), F.lit(" [label="), _quoted(F.coalesce("name", F.col("id"))), F.lit("];"))
    edge = F.concat(F.lit("  "), _quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), F.lit(" [label="), _quoted(F.col("edge_type")), F.lit("];"))
    return _lines("digraph g {", graph.nodes, node, graph.edges, edge, "}")


def mermaid(graph: PropertyGraph) -> DataFrame:
    short = lambda c: F.concat(F.lit("n"), F.substring(F.sha2(F.col(c), 256), 1, 12))
    label = F.regexp_replace(F.coalesce("name", F.col("id")), r'["\[\]]', "'")
    node = F.concat(F.lit("  "), short("id"), F.lit('["'), label, F.lit('"]'))
    edge = F.concat(F.lit("  "), short("src"), F.lit(" -->|"), F.col("edge_type"), F.lit("| "), short("dst"))
    return _lines("flowchart LR", graph.nodes, node, graph.edges, edge, "%% end")


def save(lines: DataFrame, path: str) -> None:
    """One text file in order; exports are meant for subgraphs that a reader can take in."""
    lines.repartitionByRange(1, "part", "n").sortWithinPartitions("part", "n").select("line").write.text(path)


def _document(items: DataFrame, head: str, name: str, item: Column, order: str) -> DataFrame:
    """Lines of a JSON document whose list ``name`` has an entry a row, each on its own line."""
    spark = items.sparkSession
    ends = spark.createDataFrame([(0, "", "{" + head + f'"{name}":['), (3, "", "null]}")], "part int, n string, line string")
    return ends.union(items.select(F.lit(1), F.col(order).cast("string"), F.concat(F.to_json(item), F.lit(","))))


def okf(graph: PropertyGraph) -> DataFrame:
    """One JSON object a node: what it is, where, and what it leads to, sorted."""
    links = graph.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.concat_ws(" ", "edge_type", "dst"))).alias("links"))
    return graph.nodes.join(links, "id", "left").select(F.to_json(F.struct("id", F.col("node_type").alias("type"), F.col("name").alias("title"), F.col("file_path").alias("path"), "links")).alias("line"))


def vault(graph: PropertyGraph) -> DataFrame:
    """(file, content): a Markdown note for each node, with links to what it leads to."""
    safe = lambda c: F.regexp_replace(c, r'[\\/:*?"<>|#^\[\]]', "_")
    links = graph.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), "edge_type", F.lit(" [["), safe(F.col("dst")), F.lit("]]")))).alias("links"))
    head = F.concat(F.lit("---\ntype: "), "node_type", F.lit("\n---\n# "), F.coalesce("name", "id"), F.lit("\n"))
    text = F.concat(head, F.coalesce(F.array_join("links", "\n"), F.lit("")))
    return graph.nodes.join(links, "id", "left").select(F.concat(safe(F.col("id")), F.lit(".md")).alias("file"), text.alias("content"))


def write_vault(notes: DataFrame, path: str) -> None:
    """Each note as a file of its own, from the executors; ``path`` is one they all can write."""
    import os

    def put(rows) -> None:
        os.makedirs(path, exist_ok=True)
        for r in rows:
            with open(os.path.join(path, r["file"]), "w", encoding="utf-8") as out:
                out.write(r["content"])

    notes.foreachPartition(put)


def sarif(findings: DataFrame, tool: str) -> DataFrame:
    """SARIF results of findings (id, rule, level, message, path, line), one a line."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    item = F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return _document(findings, f'"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}"}}}},', "results", item, "id").withColumn("line", F.replace("line", F.lit("null]}"), F.lit("null]}]}")))


def openvex(verdicts: DataFrame) -> DataFrame:
    """OpenVEX statements of verdicts (id, vulnerability, product, status), one a line."""
    item = F.struct(F.struct(F.col("vulnerability").alias("name")).alias("vulnerability"), F.array(F.struct(F.col("product").alias("@id"))).alias("products"), "status")
    return _document(verdicts, '"@context":"https://openvex.dev/ns/v0.2.0",', "statements", item, "id")
