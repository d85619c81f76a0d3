"""The data model: a typed, directed, attributed multigraph held as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "id string, node_type string, name string, qualified_name string, signature string, return_type string, "
    "parameters array<struct<name:string,param_type:string,default_value:string>>, code_hash string, token_bloom array<bigint>, "
    "file_path string, start_line int, end_line int, properties map<string,string>, labels array<string>"
)
EDGE_SCHEMA = "src string, dst string, edge_type string, call_type string, access_type string, properties map<string,string>, weight double"

# The closed set of node types, in the order in which inventories list them.
NODE_TYPES = (
    "function class struct enum interface annotation module variable file configkey typealias macro import table dependency job buildstep "
    "ansibleplaybook ansibleplay ansibletask ansiblerole ansiblehandler ansiblevariable ansibletemplate "
    "chefcookbook chefrecipe chefresource chefattribute cheftemplate chefdatabag "
    "puppetmodule puppetclass puppetdefine puppetresource puppetnode puppetfact puppettemplate"
).split()


def as_nodes(df: DataFrame) -> DataFrame:
    """``df`` with all node columns, missing ones null and in schema order."""
    return _shaped(df, NODE_SCHEMA)


def as_edges(df: DataFrame) -> DataFrame:
    """``df`` with all edge columns; weight is 1 unless given."""
    return _shaped(df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0)), EDGE_SCHEMA)


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


@dataclass(frozen=True)
class PropertyGraph:
    """Nodes and edges in the schemas above; operators take and return DataFrames."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def edges_of(self, *types: str) -> DataFrame:
        return self.edges.filter(F.col("edge_type").isin(*types)) if types else self.edges

    def union(self, other: PropertyGraph, prefix: tuple[str, str] | None = None) -> PropertyGraph:
        """Both graphs; with a prefix for each, their ids are kept apart."""
        mine, yours = (self.prefixed(prefix[0]), other.prefixed(prefix[1])) if prefix else (self, other)
        return PropertyGraph(mine.nodes.unionByName(yours.nodes), mine.edges.unionByName(yours.edges))

    def prefixed(self, name: str) -> PropertyGraph:
        own = lambda c: F.concat(F.lit(f"{name}/"), F.col(c))
        return PropertyGraph(self.nodes.withColumn("id", own("id")), self.edges.withColumns({"src": own("src"), "dst": own("dst")}))

    def write(self, path: str) -> None:
        """As Parquet, nodes by node_type and edges by edge_type."""
        self.nodes.write.partitionBy("node_type").parquet(f"{path}/nodes")
        self.edges.write.partitionBy("edge_type").parquet(f"{path}/edges")

    @staticmethod
    def read(spark: SparkSession, path: str) -> PropertyGraph:
        return PropertyGraph(as_nodes(spark.read.parquet(f"{path}/nodes")), as_edges(spark.read.parquet(f"{path}/edges")))
