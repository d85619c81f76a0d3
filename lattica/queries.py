"""The registered queries of the graph engine, each with SQL for the same rows if SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import rules as R
from lattica.functions import text as T
from lattica.graph import NODE_TYPES
from lattica.operators import algorithms as A
from lattica.operators import flow as N
from lattica.operators import history as H
from lattica.operators import reports as RP
from lattica.operators import resolution as RS
from lattica.operators import similarity as S
from lattica.operators import verbs as V
from lattica.plans import gql, iterate
from lattica.sources import projections as P
from lattica.streaming import windows as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# The projections of lattica.sources.projections, in SQL.
SEQ = """part_seq AS (SELECT l_orderkey, l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS t, l_returnflag AS f, l_quantity AS q FROM lineitem)"""
DENSE = f"{SEQ}, e AS (SELECT s, t FROM part_seq WHERE t IS NOT NULL)"
SPARSE = f"{SEQ}, e AS (SELECT DISTINCT s, t FROM part_seq WHERE t IS NOT NULL AND f = 'R' AND q >= 40)"
PARTS = """parts AS (SELECT p_partkey AS k, 'part:'||p_partkey AS id, p_name AS name, p_type||'.'||p_brand||'.'||p_name||'#'||p_partkey AS qn,
  lower(p_type)||'/'||lower(replace(p_brand, '#', ''))||'/'||replace(p_name, ' ', '_')||
  CASE p_partkey % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.java' WHEN 3 THEN '.go' ELSE '.ts' END AS path,
  p_name||'|'||p_type AS code_hash, p_size AS size, p_brand AS brand FROM part)"""
NODES = f"""{PARTS}, n AS (SELECT id, 'function' AS node_type, name, qn, path FROM parts
  UNION ALL SELECT 'region:'||r_regionkey, 'module', r_name, NULL, NULL FROM region
  UNION ALL SELECT 'nation:'||n_nationkey, 'module', n_name, NULL, NULL FROM nation
  UNION ALL SELECT 'customer:'||c_custkey, 'class', c_name, NULL, NULL FROM customer
  UNION ALL SELECT 'supplier:'||s_suppkey, 'interface', s_name, NULL, NULL FROM supplier
  UNION ALL SELECT 'order:'||o_orderkey, 'file', 'order'||o_orderkey, NULL, NULL FROM orders)"""
EDGES = """g AS (SELECT 'region:'||n_regionkey AS src, 'nation:'||n_nationkey AS dst, 'contains' AS edge_type FROM nation
  UNION ALL SELECT 'nation:'||c_nationkey, 'customer:'||c_custkey, 'contains' FROM customer
  UNION ALL SELECT 'nation:'||s_nationkey, 'supplier:'||s_suppkey, 'contains' FROM supplier
  UNION ALL SELECT 'order:'||o_orderkey, 'customer:'||o_custkey, 'references' FROM orders
  UNION ALL SELECT 'order:'||l_orderkey, 'part:'||l_partkey, 'uses' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:'||l_partkey, 'supplier:'||l_suppkey, 'dependson' FROM lineitem)"""
COMMITS = """c0 AS (SELECT o_orderkey AS c, o_orderdate AS ts, l_partkey AS file, sum(CAST(l_quantity AS BIGINT)) AS added, sum(l_linenumber) AS deleted
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
  c AS (SELECT * FROM c0 WHERE c IN (SELECT c FROM c0 GROUP BY c HAVING count(*) <= 50))"""


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return P.part_calls_sparse(spark, sf).toDF("src", "dst")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


def _every(spark: SparkSession, sf: str, step: int) -> DataFrame:
    """Seeds of a walk: parts whose key is a multiple of ``step``."""
    return _parts(spark, sf).filter(F.col("id") % step == 0)


# --- lookups, filters, predicates

@query("M02_scan_type", f"WITH {NODES} SELECT id, name FROM n WHERE node_type = 'interface'")
def _(spark, sf):
    return V.find(P.entity_graph(spark, sf), node_type="interface").select("id", "name")


@query("P01_find_name", f"WITH {NODES} SELECT id, node_type, name FROM n WHERE name = 'NATION_7' OR id = 'NATION_7'")
def _(spark, sf):
    return V.find(P.entity_graph(spark, sf), "NATION_7").select("id", "node_type", "name")


@query("P05_glob", f"WITH {NODES} SELECT id, name FROM n WHERE regexp_full_match(name, '.*a.?e.*')")
def _(spark, sf):
    return V.find(P.entity_graph(spark, sf), "*a?e*").select("id", "name").union(V.find(P.entity_graph(spark, sf), "*ae*").filter(~F.col("name").rlike("a.e")).select("id", "name"))


@query("P06_file_glob", f"WITH {NODES} SELECT id, path FROM n WHERE path LIKE '%.rs'")
def _(spark, sf):
    return V.find(P.entity_graph(spark, sf), file="*.rs").select("id", F.col("file_path").alias("path"))


@query("P07_lang", f"WITH {NODES} SELECT id FROM n WHERE path LIKE '%.py'")
def _(spark, sf):
    return V.find(P.entity_graph(spark, sf), lang="Python").select("id")


@query("P08_scope", f"WITH {NODES} SELECT id FROM n WHERE translate(qn, '\\.', '//') LIKE 'ECONOMY%' OR (qn IS NULL AND '/'||path||'/' LIKE '%/ECONOMY/%')")
def _(spark, sf):
    return V.find(P.entity_graph(spark, sf), scope="ECONOMY").select("id")


@query("P10_class", f"WITH {NODES} SELECT id FROM n WHERE contains(qn, 'Brand#11')")
def _(spark, sf):
    return V.find(P.entity_graph(spark, sf), klass="Brand#11").select("id")


@query("P03_line", f"WITH {PARTS} SELECT id FROM parts WHERE size >= 30")
def _(spark, sf):
    return V.find(P.entity_graph(spark, sf), line=30).select("id")


@query("P17_compound", f"WITH {NODES} SELECT id FROM n WHERE node_type = 'class' AND name LIKE '%7'")
def _(spark, sf):
    return P.entity_graph(spark, sf).nodes.filter(V.compound("type:Class|name_suffix:7")).select("id")


@query("U01_intersection", f"WITH {NODES} SELECT id FROM n WHERE node_type = 'class' INTERSECT SELECT id FROM n WHERE name LIKE '%5'")
def _(spark, sf):
    nodes = P.entity_graph(spark, sf).nodes
    return nodes.filter(V.compound("type:class")).select("id").intersect(nodes.filter(V.compound("name_suffix:5")).select("id"))


@query("P26_role", """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 IN (1, 2, 3) OR p_partkey % 7 = 2 THEN 'test' WHEN p_partkey % 7 IN (3, 4) OR p_partkey % 11 = 0 THEN 'external' ELSE 'production' END AS role FROM part""")
def _(spark, sf):
    k = F.col("p_partkey")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    path = F.concat(pick(6, "src/a", "Tests/a", "x\\test\\a", "src/a.spec", "contest/a", "src/latest"), F.lit(".rs"))
    name = pick(7, "save", "main", "app::tests::save", "std::println!", "fs.writeFileSync", "tests_of", "lengthy")
    return P.table(spark, sf, "part").select(k.alias("id"), T.role(F.when(k % 6 > 0, path), name, k % 11 == 0).alias("role"))


@query("P32_suggestions", f"""WITH {NODES} SELECT DISTINCT name, CAST(abs(length(name) - 8) AS BIGINT) AS gap FROM n
  WHERE contains(lower(name), 'nation_1') OR contains('nation_1', lower(name)) ORDER BY gap, name LIMIT 5""")
def _(spark, sf):
    return V.suggestions(P.entity_graph(spark, sf), "NATION_1")


@query("P24_projection", f"WITH {PARTS} SELECT id, name, qn, path, CAST(1 AS BIGINT) AS a, CAST(size AS BIGINT) AS b FROM parts")
def _(spark, sf):
    n = P.part_nodes(spark, sf)
    return n.select("id", "name", F.col("qualified_name").alias("qn"), F.col("file_path").alias("path"), F.col("start_line").cast("bigint").alias("a"), F.col("end_line").cast("bigint").alias("b"))


# --- pattern matching

def _gql(text: str, sparse: bool = True) -> Query:
    return lambda spark, sf: gql.run(P.call_graph(spark, sf, sparse), text, columns=("id",))


query("M03_one_hop", f"WITH {SPARSE} SELECT 'part:'||s AS a_id, 'part:'||t AS b_id FROM e")(_gql("MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a, b"))
query("M03_dense_hop", f"WITH {DENSE} SELECT DISTINCT 'part:'||s AS a_id, 'part:'||t AS b_id FROM e")(_gql("direct_calls", sparse=False))
query("M05_shared_var", f"WITH {SPARSE} SELECT 'part:'||x.s AS a_id, 'part:'||x.t AS b_id, 'part:'||y.t AS c_id FROM e x JOIN e y ON x.t = y.s")(
    _gql("MATCH (a)-[:CALLS]->(b) (b)-[:CALLS]->(c) RETURN a, b, c")
)
query("M06_cycle", f"WITH {SPARSE} SELECT 'part:'||x.s AS a_id, 'part:'||x.t AS b_id FROM e x JOIN e y ON x.t = y.s AND y.t = x.s")(
    _gql("MATCH (a)-[:CALLS]->(b)-[:CALLS]->(a) RETURN a, b")
)
query(
    "M04_varlen_1_3",
    f"""WITH {SPARSE}, d1 AS (SELECT s, t FROM e), d2 AS (SELECT DISTINCT d1.s, e.t FROM d1 JOIN e ON d1.t = e.s),
    d3 AS (SELECT DISTINCT d2.s, e.t FROM d2 JOIN e ON d2.t = e.s)
    SELECT 'part:'||s AS a_id, 'part:'||t AS b_id FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)""",
)(_gql("call_chain"))
query("M04_varlen_2_2", f"WITH {SPARSE} SELECT DISTINCT 'part:'||x.s AS a_id, 'part:'||y.t AS b_id FROM e x JOIN e y ON x.t = y.s")(
    _gql("MATCH (a)-[:CALLS*2..2]->(b) RETURN a, b")
)
query("M07_where_like", f"WITH {SPARSE}, {PARTS} SELECT a.id AS a_id, b.id AS b_id FROM e JOIN parts a ON a.k = s JOIN parts b ON b.k = t WHERE a.name LIKE 'r%' AND b.qn LIKE '%7'")(
    _gql("MATCH (a)-[:CALLS]->(b) WHERE a.name LIKE 'r*' AND b.qualified_name LIKE '*7' RETURN a, b")
)
query("M09_limit", f"WITH {PARTS} SELECT id AS f_id FROM parts ORDER BY id LIMIT 7")(_gql("MATCH (f:Function) RETURN f LIMIT 7"))
query("M05_cartesian", f"WITH {NODES} SELECT x.id AS a_id, y.id AS b_id FROM n x, n y WHERE x.node_type = 'module' AND x.name = 'ASIA' AND y.node_type = 'interface'")(
    lambda spark, sf: gql.run(P.entity_graph(spark, sf), "MATCH (a:Module {name: 'ASIA'}) (b:Interface) RETURN a, b", columns=("id",))
)
query("P22_property", f"WITH {PARTS} SELECT id AS f_id FROM parts WHERE size = 7")(_gql("MATCH (f:Function) WHERE f.cyclomatic = '7' RETURN f"))
query(
    "M10_communities",
    "SELECT 'brand:'||p_brand AS c_id, p_brand AS c_name FROM part GROUP BY p_brand",
)(
    lambda spark, sf: gql.run(
        P.entity_graph(spark, sf),
        "all_communities",
        P.part_nodes(spark, sf).groupBy(F.split("qualified_name", r"\.")[1].alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.concat(F.lit("brand:"), "name")),
        columns=("id", "name"),
    )
)


# --- relations, walks

@query("J02_relations_out", f"WITH {EDGES}, {NODES} SELECT src AS source_id, a.name AS source_name, dst AS target_id, b.name AS target_name, count(*) AS occurrences FROM g JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE edge_type = 'uses' GROUP BY ALL")
def _(spark, sf):
    return V.relations(P.entity_graph(spark, sf), "uses")


@query("J02_relations_in", f"WITH {EDGES}, {NODES} SELECT dst AS source_id, b.name AS source_name, src AS target_id, a.name AS target_name, count(*) AS occurrences FROM g JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE edge_type = 'contains' GROUP BY ALL")
def _(spark, sf):
    return V.relations(P.entity_graph(spark, sf), "contains", "in")


_WALK = """r(id, hops) AS (SELECT p_partkey, CAST(0 AS BIGINT) FROM part WHERE p_partkey % {step} = 0
  UNION SELECT {to}, hops + 1 FROM r JOIN e ON e.{at} = r.id WHERE hops < {depth}), m AS (SELECT id, min(hops) AS hops FROM r GROUP BY id)"""


def _walk(at: str, to: str, step: int, depth: int) -> str:
    return _WALK.format(at=at, to=to, step=step, depth=depth)


def _seeds(spark: SparkSession, sf: str, step: int) -> DataFrame:
    return P.table(spark, sf, "part").filter(F.col("p_partkey") % step == 0).select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))


@query("J04_callers_d3", f"WITH RECURSIVE {SPARSE}, {_walk('t', 's', 100, 3)} SELECT 'part:'||id AS id, p_name AS name, hops FROM m JOIN part ON p_partkey = id WHERE hops > 0")
def _(spark, sf):
    return V.callers(P.call_graph(spark, sf), _seeds(spark, sf, 100), 3)


@query("J04_callees_d3", f"WITH RECURSIVE {SPARSE}, {_walk('s', 't', 100, 3)} SELECT 'part:'||id AS id, p_name AS name, hops FROM m JOIN part ON p_partkey = id WHERE hops > 0")
def _(spark, sf):
    return V.callees(P.call_graph(spark, sf), _seeds(spark, sf, 100), 3)


@query("J03_seeded_relations", f"WITH RECURSIVE {SPARSE}, {_walk('s', 't', 100, 2)} SELECT 'part:'||s AS source_id, 'part:'||t AS target_id, hops + 1 AS hops, CAST(1 AS BIGINT) AS occurrences FROM e JOIN m ON m.id = s")
def _(spark, sf):
    return V.seeded_relations(P.call_graph(spark, sf), _seeds(spark, sf, 100), "calls", 3)


@query("J19_subgraph", f"WITH RECURSIVE {SPARSE.replace('e AS (', 'e0 AS (')}, e AS (SELECT s, t FROM e0 UNION SELECT t, s FROM e0), {_walk('s', 't', 200, 2)} SELECT 'part:'||s AS src, 'part:'||t AS dst FROM e0 WHERE s IN (SELECT id FROM m) AND t IN (SELECT id FROM m)")
def _(spark, sf):
    return V.export_subgraph(P.call_graph(spark, sf), _seeds(spark, sf, 200), 2).edges.select("src", "dst")


@query("J22_upstream_closure", f"WITH RECURSIVE {SPARSE}, {_walk('t', 's', 500, 12)} SELECT id, hops FROM m")
def _(spark, sf):
    return A.impact_radius(_calls(spark, sf), _every(spark, sf, 500), 12).union(_every(spark, sf, 500).withColumn("hops", F.lit(0).cast("bigint")))


@query("G12_blast_bfs", f"""WITH RECURSIVE {SPARSE}, r(root, id, hops) AS (SELECT t, s, CAST(1 AS BIGINT) FROM e WHERE t % 100 = 0
  UNION SELECT r.root, e.s, hops + 1 FROM r JOIN e ON e.t = r.id WHERE hops < 4), m AS (SELECT root, id, min(hops) AS hops FROM r WHERE id <> root GROUP BY ALL)
  SELECT root, count(*) FILTER (hops = 1) AS direct, count(*) AS impact, round(least(25.0 * count(*) FILTER (hops = 1), 40) + least(12.0 * count(*), 35), 6) AS score FROM m GROUP BY root""")
def _(spark, sf):
    up = _calls(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    m = iterate.closure(up, _every(spark, sf, 100), 4).filter("root <> id")
    direct = F.sum(F.when(F.col("hops") == 1, 1).otherwise(0))
    g = m.groupBy("root").agg(direct.alias("direct"), F.count(F.lit(1)).alias("impact"))
    return g.withColumn("score", F.round(F.least(25.0 * F.col("direct"), F.lit(40.0)) + F.least(12.0 * F.col("impact"), F.lit(35.0)), 6))


@query("G18_direct_callers", f"WITH {EDGES}, {NODES} SELECT DISTINCT g.src AS id FROM g JOIN n ON n.id = g.dst WHERE n.name = 'NATION_3'")
def _(spark, sf):
    g = P.entity_graph(spark, sf)
    return g.edges.join(g.nodes.filter("name = 'NATION_3'").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


@query("J23_neighbours", f"WITH {DENSE} SELECT s AS id, t AS peer, 'out' AS direction FROM e WHERE s = 7 UNION ALL SELECT t, s, 'in' FROM e WHERE t = 7")
def _(spark, sf):
    e = P.part_calls(spark, sf)
    return e.filter("s = 7").select(F.col("s").alias("id"), F.col("t").alias("peer"), F.lit("out").alias("direction")).unionAll(e.filter("t = 7").select("t", "s", F.lit("in")))


# --- aggregations

_TYPES = ", ".join(f"'{t}'" for t in NODE_TYPES)


@query("A01_inventory_type", f"WITH {NODES} SELECT bucket, count(n.id) AS n FROM (SELECT unnest([{_TYPES}]) AS bucket) b LEFT JOIN n ON n.node_type = bucket GROUP BY bucket")
def _(spark, sf):
    return V.inventory(P.entity_graph(spark, sf), "type")


@query("A02_inventory_edge", f"WITH {EDGES} SELECT edge_type, count(DISTINCT src||'>'||dst) AS distinct_edges, count(*) AS occurrences FROM g GROUP BY 1")
def _(spark, sf):
    return V.edge_inventory(P.entity_graph(spark, sf))


@query("A03_inventory_lang", f"WITH {NODES} SELECT CASE right(path, 3) WHEN '.rs' THEN 'rust' WHEN '.py' THEN 'python' WHEN 'ava' THEN 'java' WHEN '.go' THEN 'go' WHEN '.ts' THEN 'typescript' END AS bucket, count(*) AS n FROM n WHERE path IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return V.inventory(P.entity_graph(spark, sf), "lang")


@query("A04_inventory_file", f"WITH {NODES} SELECT coalesce(path, '<unknown>') AS bucket, count(*) AS n FROM n GROUP BY 1")
def _(spark, sf):
    return V.inventory(P.entity_graph(spark, sf), "file")


@query("A05_inventory_community", f"WITH {NODES} SELECT '<none>' AS bucket, count(*) AS n FROM n")
def _(spark, sf):
    return V.inventory(P.entity_graph(spark, sf), "community")


@query("A08_complexity", "SELECT CASE WHEN p_size <= 5 THEN 'low' WHEN p_size <= 10 THEN 'moderate' WHEN p_size <= 20 THEN 'high' ELSE 'very_high' END AS level, count(*) AS n, round(avg(p_size), 6) AS mean, CAST(max(p_size) AS BIGINT) AS most FROM part GROUP BY 1")
def _(spark, sf):
    c = F.col("properties")["cyclomatic"].cast("bigint")
    return P.part_nodes(spark, sf).groupBy(T.complexity_level(c).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.max(c).alias("most"))


@query("A09_degree", f"WITH {DENSE}, o AS (SELECT s AS id, count(*) AS d FROM e GROUP BY 1), i AS (SELECT t AS id, count(*) AS d FROM e GROUP BY 1) SELECT coalesce(o.id, i.id) AS id, coalesce(i.d, 0) AS in_degree, coalesce(o.d, 0) AS out_degree, coalesce(i.d, 0) + coalesce(o.d, 0) AS degree FROM o FULL JOIN i ON o.id = i.id")
def _(spark, sf):
    return A.degree(P.part_calls(spark, sf).toDF("src", "dst"))


@query("A10_risk", f"WITH {DENSE}, d AS (SELECT id, count(*) AS degree FROM (SELECT s AS id FROM e UNION ALL SELECT t FROM e) GROUP BY 1) SELECT 'part:'||id AS id, degree, degree * p_size AS risk FROM d JOIN part ON p_partkey = id")
def _(spark, sf):
    g = P.call_graph(spark, sf, sparse=False)
    return A.risk(g.nodes, g.edges)


@query("A20_modularity", f"""WITH {SPARSE}, x AS (SELECT a.p_brand AS a, b.p_brand AS b FROM e JOIN part a ON a.p_partkey = s JOIN part b ON b.p_partkey = t),
  d AS (SELECT c, count(*) AS deg FROM (SELECT a AS c FROM x UNION ALL SELECT b FROM x) GROUP BY 1)
  SELECT round((SELECT count(*) FROM x WHERE a = b) / (SELECT count(*) FROM x) - sum(deg::DOUBLE * deg) / (4.0 * (SELECT count(*) FROM x) * (SELECT count(*) FROM x)), 6) AS q FROM d""")
def _(spark, sf):
    brands = P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    return A.modularity(_calls(spark, sf), brands).select(F.round("q", 6).alias("q"))


@query("A11_churn", f"""WITH {COMMITS} SELECT file, count(DISTINCT c) AS commits, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted,
  round(sum(ln(1 + added + deleted) * exp(-(ln(2.0) / 30) * (epoch((SELECT max(ts) FROM c)) - epoch(ts)) / 86400.0)), 6) AS churn FROM c GROUP BY file""")
def _(spark, sf):
    return H.churn(P.commits(spark, sf)).select("file", "commits", "added", "deleted", F.round("churn", 6).alias("churn"))


@query("A12_hotspot", f"""WITH {COMMITS}, h AS (SELECT file, sum(ln(1 + added + deleted) * exp(-(ln(2.0) / 30) * (epoch((SELECT max(ts) FROM c)) - epoch(ts)) / 86400.0)) AS churn FROM c GROUP BY file)
  SELECT file, round(churn * ln(1 + p_size), 6) AS hotspot FROM h JOIN part ON p_partkey = file""")
def _(spark, sf):
    sizes = P.table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("cyclomatic"))
    return H.hotspots(H.churn(P.commits(spark, sf)), sizes).select("file", F.round("hotspot", 6).alias("hotspot"))


@query("A13_cochange", f"""WITH {COMMITS}, f AS (SELECT DISTINCT c, file FROM c), n AS (SELECT file, count(*) AS n FROM f GROUP BY 1),
  b AS (SELECT x.file AS a, y.file AS b, count(*) AS pairs FROM f x JOIN f y ON x.c = y.c AND x.file < y.file GROUP BY ALL HAVING count(*) >= 2),
  j AS (SELECT a, b, pairs, pairs / (na.n + nb.n - pairs) AS jac FROM b JOIN n na ON na.file = a JOIN n nb ON nb.file = b),
  k AS (SELECT * FROM j WHERE jac >= 0.02), s AS (SELECT *, a AS f, b AS p FROM k UNION ALL SELECT *, b, a FROM k),
  r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY jac DESC, pairs DESC, p DESC) AS r FROM s)
  SELECT DISTINCT a, b, pairs, round(jac, 6) AS jaccard FROM r WHERE r <= 15""")
def _(spark, sf):
    return H.cochange(P.commits(spark, sf), least=2, jaccard=0.02).withColumn("jaccard", F.round("jaccard", 6))


@query("A14_exact_clones", f"WITH {PARTS} SELECT code_hash, count(*) AS size, min(id) AS first_id FROM parts WHERE size >= 5 GROUP BY 1 HAVING count(*) >= 2")
def _(spark, sf):
    return S.exact_clones(P.part_nodes(spark, sf))


@query("A17_package_calls", f"WITH {DENSE} SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS n FROM e JOIN part a ON a.p_partkey = s JOIN part b ON b.p_partkey = t WHERE a.p_brand <> b.p_brand GROUP BY ALL")
def _(spark, sf):
    labels = P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))
    return RP.call_weights(P.part_calls(spark, sf).toDF("src", "dst"), labels)


@query("A19_community_summary", "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand AS community, CAST(sum(n) AS BIGINT) AS size, arg_min(p_type, (-n, p_type)) AS primary_type, (SELECT round(avg(p_size), 6) FROM part p WHERE p.p_brand = c.p_brand) AS complexity FROM c GROUP BY 1")
def _(spark, sf):
    p = P.table(spark, sf, "part").select(F.col("p_brand").alias("community"), F.col("p_type").alias("node_type"), F.col("p_size").alias("complexity"))
    return RP.community_summary(p).withColumn("complexity", F.round("complexity", 6))


@query("A23_plurality", """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS all_n,
  row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM c) SELECT p_brand AS community, p_type AS label FROM t WHERE r = 1 AND 6 * n >= all_n""")
def _(spark, sf):
    return RP.plurality(P.table(spark, sf, "part").select(F.col("p_brand").alias("group"), F.col("p_type").alias("label")), 1 / 6).toDF("community", "label")


# --- windows and ranks

@query("W02_ranks", "SELECT p_partkey AS id, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS priority FROM part QUALIFY priority <= 100")
def _(spark, sf):
    return RP.ranked(P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")), 100).select("id", F.col("rank").alias("priority"))


@query("W03_minmax", "SELECT p_partkey AS id, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS x FROM part")
def _(spark, sf):
    return RP.min_max(P.table(spark, sf, "part"), "p_retailprice", "x").select(F.col("p_partkey").alias("id"), F.round("x", 6).alias("x"))


@query("W06_labels", "SELECT p_partkey AS id, CASE WHEN r = 1 THEN p_name ELSE p_name||' ('||r||')' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS r FROM part)")
def _(spark, sf):
    return RP.numbered(P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")))


@query("W07_ledger", "SELECT o_custkey AS key, epoch_us(min(o_orderdate)) AS first_us, arg_max(o_orderstatus, o_orderkey) AS class FROM orders GROUP BY 1")
def _(spark, sf):
    o = P.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("class"))
    return H.ledger_state(o).select("key", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"), "class")


@query("W08_fill_down", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations")
def _(spark, sf):
    c = P.table(spark, sf, "conversations")
    return RP.filled_down(c, F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn", "asked").select("conv_id", "turn", "asked")


# --- algorithms

@query("G01_pagerank", f"""WITH {SPARSE}, n AS (SELECT count(*) AS n FROM part), o AS (SELECT s, count(*) AS d FROM e GROUP BY 1),
  r0 AS (SELECT p_partkey AS id, 1.0::DOUBLE / (SELECT n FROM n) AS x FROM part),
  """ + ", ".join(f"""k{i} AS (SELECT sum(x) AS dangling FROM r{i - 1} WHERE id NOT IN (SELECT s FROM o)),
  g{i} AS (SELECT e.t AS id, sum(r.x / o.d) AS x FROM e JOIN o USING (s) JOIN r{i - 1} r ON r.id = e.s GROUP BY 1),
  r{i} AS (SELECT r.id, 0.15 / (SELECT n FROM n) + 0.85 * (SELECT dangling FROM k{i}) / (SELECT n FROM n) + 0.85 * coalesce(g.x, 0) AS x FROM r{i - 1} r LEFT JOIN g{i} g ON g.id = r.id)""" for i in (1, 2, 3)) + """
  SELECT id, round(CASE WHEN id IN (SELECT s FROM e UNION SELECT t FROM e) THEN x ELSE 0 END, 8) AS score FROM r3""")
def _(spark, sf):
    return A.pagerank(_parts(spark, sf), _calls(spark, sf), rounds=3, tolerance=0).select("id", F.round("score", 8).alias("score"))


query("G20_hubs", f"""WITH {DENSE}, d AS (SELECT id, count(*) AS degree FROM (SELECT s AS id FROM e UNION ALL SELECT t FROM e) GROUP BY 1)
  SELECT id, degree FROM d WHERE degree > (SELECT avg(degree) + 2 * stddev_pop(degree) FROM d) ORDER BY degree DESC, id LIMIT (SELECT CAST(floor(count(*) * 0.05) AS BIGINT) FROM d)""")(
    lambda spark, sf: A.hubs(P.part_calls(spark, sf).toDF("src", "dst"), sigma=2.0)
)

@query("G22_components", f"""WITH RECURSIVE {SPARSE}, u AS (SELECT s, t FROM e UNION SELECT t, s FROM e), r(id, x) AS (SELECT s, s FROM u UNION SELECT u.t, r.x FROM r JOIN u ON u.s = r.id WHERE r.x < u.t)
  SELECT id, min(x) AS component FROM r GROUP BY id""")
def _(spark, sf):
    return iterate.components(_calls(spark, sf))


# Closures of the whole sparse graph are too large for SQL; tests hold these against brute force.
@query("G08_strong_components")
def _(spark, sf):
    return iterate.strong_components(_calls(spark, sf))


@query("G09_condensation")
def _(spark, sf):
    return A.condensation(_calls(spark, sf))[1]


@query("G16_cycles")
def _(spark, sf):
    return A.cycles(_calls(spark, sf)).select("component", "size")


@query("G26_recursive")
def _(spark, sf):
    return A.recursive_nodes(_calls(spark, sf))


@query("G11_blast")
def _(spark, sf):
    return A.blast(_calls(spark, sf)).withColumn("score", F.round("score", 6))


@query("G13_reach")
def _(spark, sf):
    return A.reach_centrality(_calls(spark, sf))


@query("G17_impact", f"WITH RECURSIVE {SPARSE}, {_walk('t', 's', 250, 4)} SELECT id, hops FROM m WHERE hops > 0")
def _(spark, sf):
    return A.impact_radius(_calls(spark, sf), _every(spark, sf, 250), 4)


@query("G33_dead_code", f"WITH RECURSIVE {SPARSE}, r(id) AS (SELECT p_partkey FROM part WHERE p_partkey % 50 = 0 UNION SELECT e.t FROM r JOIN e ON e.s = r.id) SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT id FROM r) AND p_partkey NOT IN (SELECT t FROM e)")
def _(spark, sf):
    return A.dead_code(_parts(spark, sf), _calls(spark, sf), _every(spark, sf, 50))


@query("G05_harmonic")
def _(spark, sf):
    return A.harmonic(_calls(spark, sf)).select("id", F.round("harmonic", 8).alias("harmonic"))


@query("G03_betweenness")
def _(spark, sf):
    return A.centrality(_calls(spark, sf)).select("id", F.round("betweenness", 8).alias("betweenness"))


@query("G06_hyperball")
def _(spark, sf):
    return A.hyperball(_calls(spark, sf), exact=0).select("id", F.round("harmonic", 6).alias("harmonic"))


@query("G19_communities")
def _(spark, sf):
    return A.communities(_calls(spark, sf))


@query("G25_topological")
def _(spark, sf):
    return A.topological_order(A.condensation(_calls(spark, sf))[1])


@query("G27_migration", f"""WITH {DENSE}, d AS (SELECT id, count(*)::DOUBLE AS x FROM (SELECT s AS id FROM e UNION ALL SELECT t FROM e) GROUP BY 1), m AS (SELECT d.id, x, p_retailprice AS h, p_size::DOUBLE AS b FROM d JOIN part ON p_partkey = d.id)
  SELECT id, round(0.33 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) + 0.33 * (h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()) - 0.34 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 6) AS score FROM m""")
def _(spark, sf):
    d = A.degree(P.part_calls(spark, sf).toDF("src", "dst")).select("id", F.col("degree").cast("double").alias("pagerank"))
    p = P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("harmonic"), F.col("p_size").cast("double").alias("blast"))
    return A.migration_scores(d.join(p, "id")).select("id", F.round("score", 6).alias("score"))


# --- similarity

@query("Q01_tokens", r"""SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(p_name, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[^\p{L}\p{N}]+'), lambda t: strlen(t) >= 3))), ',') AS tokens FROM part""")
def _(spark, sf):
    return P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(T.tokens(F.col("p_name"))), ",").alias("tokens"))


_BITS = lambda lo: "+".join(f"CASE WHEN embedding[{i + 1}] >= 0 THEN {1 << (i - lo)}::BIGINT ELSE 0 END" for i in range(lo, lo + 32))
BITS = f"b AS (SELECT vec_id, label, {_BITS(0)} AS lo, {_BITS(32)} AS hi FROM embeddings)"


def _bits(spark: SparkSession, sf: str) -> DataFrame:
    return P.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("community"), S.quantised(F.col("embedding")).alias("bits"))


@query("Q11_quantise", f"WITH {BITS} SELECT vec_id AS id, lo, hi FROM b")
def _(spark, sf):
    return _bits(spark, sf).select("id", F.col("bits")[0].alias("lo"), F.col("bits")[1].alias("hi"))


@query("Q12_hamming_topk", f"WITH {BITS}, q AS (SELECT lo, hi FROM b WHERE vec_id = 3) SELECT vec_id AS id, CAST(bit_count(xor(b.lo, q.lo)) + bit_count(xor(b.hi, q.hi)) AS BIGINT) AS distance FROM b, q ORDER BY distance, id LIMIT 20")
def _(spark, sf):
    rows = _bits(spark, sf)
    return S.hamming_topk(rows, rows.filter("id = 3").first()["bits"], 20)


_POOL = lambda w: "+".join(f"CASE WHEN sum(CASE WHEN ({w} >> {i}) & 1 = 1 THEN 1 ELSE -1 END) >= 0 THEN {1 << i}::BIGINT ELSE 0 END" for i in range(32))


@query("A15_pooling", f"WITH {BITS} SELECT label AS community, {_POOL('lo')} AS lo, {_POOL('hi')} AS hi FROM b GROUP BY label")
def _(spark, sf):
    return S.pooled(_bits(spark, sf)).select("community", F.col("bits")[0].alias("lo"), F.col("bits")[1].alias("hi"))


@query("Q20_community_search", f"WITH {BITS}, p AS (SELECT label, {_POOL('lo')} AS lo, {_POOL('hi')} AS hi FROM b GROUP BY label), q AS (SELECT lo, hi FROM b WHERE vec_id = 3) SELECT label AS id, CAST(bit_count(xor(p.lo, q.lo)) + bit_count(xor(p.hi, q.hi)) AS BIGINT) AS distance FROM p, q ORDER BY distance, id LIMIT 5")
def _(spark, sf):
    rows = _bits(spark, sf)
    return S.hamming_topk(S.pooled(rows).withColumnRenamed("community", "id"), rows.filter("id = 3").first()["bits"], 5)


@query("Q05_bloom_clones")
def _(spark, sf):
    p = P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.token_bloom(T.tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand"))).alias("bloom"))
    return S.bloom_clones(p)


@query("Q04_bloom_jaccard")
def _(spark, sf):
    p = P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.token_bloom(T.tokens(F.col("p_name"))).alias("bloom"))
    one = F.broadcast(p.filter("id = 0").select(F.col("bloom").alias("q")))
    return p.crossJoin(one).select("id", F.round(S.bloom_jaccard(F.col("bloom"), F.col("q")), 6).alias("jaccard"))


@query("W11_fusion", f"""WITH {BITS}, q AS (SELECT lo, hi FROM b WHERE vec_id = 3), p AS (SELECT vec_id, label, 1 - (bit_count(xor(b.lo, q.lo)) + bit_count(xor(b.hi, q.hi))) / 64.0 AS sim FROM b, q ORDER BY sim DESC, vec_id LIMIT 256)
  SELECT vec_id AS id, round(0.35::DOUBLE * sim::DOUBLE + 0.08::DOUBLE * CASE WHEN label = (SELECT label FROM b WHERE vec_id = 3) THEN 1 ELSE 0 END, 8) AS score FROM p ORDER BY score DESC, id LIMIT 20""")
def _(spark, sf):
    rows = _bits(spark, sf)
    q = rows.filter("id = 3").first()
    pool = S.hamming_topk(rows, q["bits"], 256).join(rows.select("id", "community"), "id")
    pool = pool.select("id", (1 - F.col("distance") / 64.0).alias("similarity"), F.when(F.col("community") == q["community"], 1.0).otherwise(0.0).alias("community"))
    return pool.select("id", F.round(S.fused(pool), 8).alias("score")).orderBy(F.desc("score"), "id").limit(20)


# --- differences, compaction, policies

BASE = f"{SEQ}, b AS (SELECT DISTINCT s AS src, t AS dst FROM (SELECT lead(l_partkey) OVER w AS t, l_partkey AS s, l_returnflag AS f, l_quantity AS q FROM lineitem WHERE l_orderkey % 10 <> 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) WHERE t IS NOT NULL AND f = 'R' AND q >= 40)"
BOTH = BASE + ", h AS (SELECT DISTINCT s AS src, t AS dst FROM (SELECT lead(l_partkey) OVER w AS t, l_partkey AS s, l_returnflag AS f, l_quantity AS q FROM lineitem WHERE l_orderkey % 10 <> 1 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) WHERE t IS NOT NULL AND f = 'R' AND q >= 40)"
CHANGES = f"{BOTH}, x AS ((SELECT *, 'added' AS kind FROM (SELECT * FROM h EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM h)))"


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b, h = P.snapshots(spark, sf)
    return b.toDF("src", "dst"), h.toDF("src", "dst")


@query("D01_diff_edges", f"WITH {CHANGES} SELECT * FROM x")
def _(spark, sf):
    return H.diff_edges(*_snapshots(spark, sf))


@query("A21_diff_stats", f"WITH {CHANGES} SELECT kind, count(*) AS n FROM x GROUP BY 1")
def _(spark, sf):
    return H.diff_edges(*_snapshots(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("D01_diff_nodes", f"WITH {BOTH}, nb AS (SELECT src AS k, count(*) AS d FROM b GROUP BY 1), nh AS (SELECT src AS k, count(*) AS d FROM h GROUP BY 1) SELECT coalesce(nb.k, nh.k) AS key, CASE WHEN nb.k IS NULL THEN 'added' WHEN nh.k IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM nb FULL JOIN nh ON nb.k = nh.k WHERE nb.d IS DISTINCT FROM nh.d")
def _(spark, sf):
    count = lambda df: df.groupBy(F.col("src").alias("key")).agg(F.count(F.lit(1)).alias("digest"))
    b, h = _snapshots(spark, sf)
    return H.diff_nodes(count(b), count(h))


@query("D04_retarget", f"WITH {CHANGES}, o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM x WHERE kind = 'removed'), n AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM x WHERE kind = 'added') SELECT coalesce(o.src, n.src) AS src, o.dst AS old_dst, n.dst AS new_dst, CASE WHEN o.dst IS NULL THEN 'added' WHEN n.dst IS NULL THEN 'removed' ELSE 'retargeted' END AS kind FROM o FULL JOIN n ON o.src = n.src AND o.r = n.r")
def _(spark, sf):
    return H.retargeted(H.diff_edges(*_snapshots(spark, sf)))


@query("T06_compact", f"WITH {BOTH} SELECT src, dst FROM b WHERE src % 7 <> 0 AND dst % 11 <> 0 AND src % 11 <> 0 UNION SELECT src, dst FROM h WHERE src % 7 = 0")
def _(spark, sf):
    b, h = _snapshots(spark, sf)
    parts = _parts(spark, sf)
    return H.compacted(b, h.filter("src % 7 = 0"), parts.filter("id % 7 = 0"), parts.filter("id % 11 <> 0"))


@query("U07_changed_files", "SELECT o_orderkey AS path, CASE WHEN o_orderkey % 10 = 1 THEN 'removed' WHEN o_orderkey % 10 = 0 THEN 'added' ELSE 'changed' END AS kind FROM orders WHERE o_orderkey % 10 < 2 OR o_orderkey % 10 = 5")
def _(spark, sf):
    o = P.table(spark, sf, "orders")
    old = o.filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("path"), F.lit("x").alias("hash"))
    new = o.filter("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 10 == 5, "y").otherwise("x").alias("hash"))
    return H.changed_files(old, new)


@query("J11_hunk_overlap", """WITH h AS (SELECT l_partkey AS k, CAST(l_linenumber * 5 AS INT) AS a, CAST(l_linenumber * 5 + l_quantity / 10 AS INT) AS b FROM lineitem WHERE l_orderkey % 10 = 0)
  SELECT DISTINCT p_partkey AS id FROM part JOIN h ON k = p_partkey WHERE a <= p_size AND 1 <= b""")
def _(spark, sf):
    li = P.table(spark, sf, "lineitem").filter("l_orderkey % 10 = 0")
    hunks = li.select(F.col("l_partkey").alias("path"), (F.col("l_linenumber") * 5).alias("h_start"), F.round(F.col("l_linenumber") * 5 + F.col("l_quantity") / 10).cast("int").alias("h_end"))
    spans = P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("path"), F.lit(1).alias("start_line"), F.col("p_size").alias("end_line"))
    return H.hunk_overlap(hunks, spans).select("id")


@query("J12_enclosing", """WITH s AS (SELECT p_partkey AS id, p_brand AS path, p_size AS a, p_size + p_partkey % 17 AS b FROM part), x AS (SELECT p_partkey AS site, p_brand AS path, p_size AS line FROM part)
  SELECT site, id FROM (SELECT site, s.id, row_number() OVER (PARTITION BY site ORDER BY b - a, s.id) AS r FROM x JOIN s USING (path) WHERE line BETWEEN a AND b) WHERE r = 1""")
def _(spark, sf):
    p = P.table(spark, sf, "part")
    spans = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 17).alias("end_line"))
    return H.enclosing(p.select(F.col("p_partkey").alias("site"), F.col("p_brand").alias("path"), F.col("p_size").alias("line")), spans)


@query("D07_crossings", "SELECT l_partkey AS src, l_suppkey AS dst, p_brand AS a, n_name AS b FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE p_brand = 'Brand#11' AND n_name = 'NATION_19'")
def _(spark, sf):
    e = P.table(spark, sf, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst")).distinct()
    s = P.table(spark, sf, "supplier").join(P.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    domains = P.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.col("p_brand").alias("domain")).union(s.select(F.concat(F.lit("s"), F.col("s_suppkey")), "n_name"))
    out = H.forbidden_crossings(e, domains, [("NATION_19", "Brand#11")])
    return out.select(F.substring("src", 2, 20).cast("bigint").alias("src"), F.substring("dst", 2, 20).cast("bigint").alias("dst"), "a", "b")


@query("D07_policy", "WITH v AS (SELECT p_partkey AS id, 'max_impact' AS rule, CAST(p_size AS VARCHAR) AS detail, 0 AS o FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey, 'centrality_alert', CAST(round(p_size / 64.0, 6) AS VARCHAR), 2 FROM part WHERE p_size / 64.0 > 0.75) SELECT id, rule, row_number() OVER (ORDER BY o, id) = 1 AS first FROM v")
def _(spark, sf):
    p = P.table(spark, sf, "part")
    none = spark.createDataFrame([], "src bigint, dst bigint, a string, b string")
    return H.policy(p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("impact")), none, p.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 64.0).alias("betweenness")), 45, 0.75).select("id", "rule", "first")


@query("D08_temporal", "SELECT coalesce(b.k, h.k) AS key, CASE WHEN b.k IS NOT NULL AND h.k IS NOT NULL THEN 'existing' WHEN h.k IS NOT NULL AND h.k % 30 = 0 THEN 'regression' WHEN h.k IS NOT NULL THEN 'new' ELSE 'resolved' END AS class FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 0) b FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 1) h ON b.k = h.k")
def _(spark, sf):
    o = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    return H.temporal(o.filter("key % 10 <> 0"), o.filter("key % 10 <> 1"), o.filter("key % 30 = 0"))


@query("D09_calendar", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 AND DATE '1996-01-01' > CAST(o_orderdate AS DATE) + 365 THEN 'sunset' WHEN DATE '1996-01-01' < CAST(o_orderdate AS DATE) THEN 'inactive' WHEN DATE '1996-01-01' <= CAST(o_orderdate AS DATE) + 30 THEN 'grace' ELSE 'enforced' END AS state FROM orders")
def _(spark, sf):
    d = F.to_date("o_orderdate")
    sunset = F.when(F.col("o_orderkey") % 7 == 0, F.date_add(d, 365))
    return P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), H.calendar(F.lit("1996-01-01").cast("date"), d, 30, sunset).alias("state"))


@query("D14_rules", "SELECT 'part:'||p_partkey AS id, array_to_string(list_sort(list_filter([CASE WHEN p_size > 20 THEN 'complex' END, CASE WHEN p_name LIKE 'g%' THEN 'g-name' END], lambda x: x IS NOT NULL)), ',') AS labels FROM part")
def _(spark, sf):
    c = F.col("properties")["cyclomatic"].cast("int")
    out = H.label_rules(P.part_nodes(spark, sf), [(c > 20, "complex"), (F.col("name").startswith("g"), "g-name")])
    return out.select("id", F.array_join("labels", ",").alias("labels"))


@query("D16_deps", "SELECT p_partkey AS id, p_brand AS package, (p_size // 10)||'.'||(p_size % 10)||'.0' AS version FROM part WHERE p_size >= 10 AND p_size < 30")
def _(spark, sf):
    p = P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("package"), F.concat(F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"), F.lit(".0")).alias("version"))
    adv = p.select("package").distinct().withColumns({"introduced": F.lit("1.0.0"), "fixed": F.lit("3.0.0")})
    return H.affected(p, adv).select("id", "package", "version")


@query("D20_drift", "WITH a AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def _(spark, sf):
    o = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"))
    return H.drift(o.filter("seq % 2 = 0"), o.filter("seq % 2 = 1"))


# --- sources, flow, events

@query("G5_page_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages")
def _(spark, sf):
    return P.page_links(spark, sf).select("page_id", "target")


@query("S24_secrets", r"SELECT doc_id, len(regexp_extract_all(text, '((?:api[_-]?key|secret|token|passw(?:or)?d)\s*[=:]\s*[\"''][^\"''\s]{8,}[\"''])', 1)) + len(regexp_extract_all(text, '(AKIA[0-9A-Z]{16})', 1)) + len(regexp_extract_all(text, '(gh[pousr]_[A-Za-z0-9]{36})', 1)) + len(regexp_extract_all(text, '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1)) AS n FROM documents")
def _(spark, sf):
    return P.table(spark, sf, "documents").select("doc_id", F.size(T.secrets(F.col("text"))).cast("bigint").alias("n"))


def _statements(spark: SparkSession, sf: str) -> DataFrame:
    s = P.statements(spark, sf).withColumn("w", F.split("text", " "))
    return s.select(F.col("doc_id").alias("fn"), F.col("line_no").alias("line"), F.col("w")[0].alias("def"), F.slice("w", 2, 1000000).alias("uses"))


STMTS = """l AS (SELECT doc_id AS fn, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
  st AS (SELECT fn, line, string_split(x, ' ')[1] AS def, list_distinct(string_split(x, ' ')[2:]) AS uses FROM l)"""


@query("N07_output_deps", f"WITH {STMTS}, d AS (SELECT fn, line AS src, lead(line) OVER (PARTITION BY fn, def ORDER BY line) AS dst FROM st) SELECT fn, src, dst FROM d WHERE dst IS NOT NULL")
def _(spark, sf):
    return N.output_dependencies(_statements(spark, sf)).select("fn", "src", "dst")


@query("N07_flow_deps", f"WITH {STMTS}, u AS (SELECT fn, line, unnest(uses) AS var FROM st) SELECT u.fn, max(d.line) AS src, u.line AS dst, u.var FROM u JOIN st d ON d.fn = u.fn AND d.def = u.var AND d.line < u.line GROUP BY u.fn, u.line, u.var")
def _(spark, sf):
    return N.flow_dependencies(_statements(spark, sf))


@query("T_window_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    e = W.tumbling(P.table(spark, sf, "events"), "1 hour", "event_type")
    return e.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n")


@query("T_session", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, k""")
def _(spark, sf):
    e = W.sessions(P.table(spark, sf, "events"), "30 minutes", "user_id")
    return e.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")


@query("T04_latest_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(spark, sf):
    return W.latest(P.table(spark, sf, "events"), "user_id", "event_id", "event_type")


# --- rules, resolution, fused and pooled signals

_RULES = """{"rules": [{"name": "big", "match": {"and": [{"node_type": "Function"}, {"complexity_above": 40}]}, "actions": [{"add_label": "big"}]},
  {"name": "named", "match": {"or": [{"name_regex": "^g"}, {"not": {"complexity_above": 3}}]}, "actions": [{"add_label": "named"}, {"set_property": {"name": "k", "value": "v"}}]}]}"""


@query("P28_rules", "SELECT 'part:'||p_partkey AS id, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'big' END, CASE WHEN p_name LIKE 'g%' OR NOT p_size > 3 THEN 'named' END], lambda x: x IS NOT NULL), ',') AS labels, CASE WHEN p_name LIKE 'g%' OR NOT p_size > 3 THEN 'v' END AS k FROM part")
def _(spark, sf):
    out = R.apply(P.part_nodes(spark, sf), _RULES)
    return out.select("id", F.array_join("labels", ",").alias("labels"), F.col("properties")["k"].alias("k"))


@query("P28_rule_counts", "SELECT 'big' AS rule, count(*) FILTER (p_size > 40) AS n FROM part UNION ALL SELECT 'named', count(*) FILTER (p_name LIKE 'g%' OR NOT p_size > 3) FROM part")
def _(spark, sf):
    return R.matched(P.part_nodes(spark, sf), _RULES)


@query("P30_statement_roles", "SELECT conv_id, turn, CASE WHEN contains(text, 'a') AND NOT contains(text, 'zz') THEN 'src' END AS source, CASE WHEN regexp_matches(text, '[0-9]') THEN 'num' WHEN contains(text, 'e') AND contains(text, 'o') THEN 'eo' END AS sink FROM conversations")
def _(spark, sf):
    rules = [{"role": "source", "name": "src", "any": ["a"], "unless_any": ["zz"]}, {"role": "sink", "name": "num", "regex": "[0-9]"}, {"role": "sink", "name": "eo", "all": ["e", "o"]}]
    return R.statement_roles(P.table(spark, sf, "conversations"), rules).select("conv_id", "turn", "source", "sink")


@query("D15_verdict", "SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 'not_affected' WHEN p_partkey % 2 = 0 THEN 'exploitable' WHEN p_partkey % 3 = 0 THEN 'affected' ELSE 'under_investigation' END AS verdict FROM part")
def _(spark, sf):
    k = F.col("p_partkey")
    return P.table(spark, sf, "part").select(k.alias("id"), R.verdict(k % 2 == 0, F.col("p_size") >= 10, k % 3 == 0).alias("verdict"))


@query("J13_resolution", """WITH r AS (SELECT o_orderkey AS rel, 'Brand#'||(11 + o_orderkey % 5) AS path, p_name AS name, CASE WHEN o_orderkey % 2 = 0 THEN p_type||'.'||p_brand||'.'||p_name||'#'||p_partkey END AS hint FROM orders JOIN part ON p_partkey = o_orderkey % 200),
  s AS (SELECT p_partkey AS id, p_brand AS path, p_name AS name, p_type||'.'||p_brand||'.'||p_name||'#'||p_partkey AS qn FROM part),
  t AS (SELECT rel, s.id, 1 AS tier FROM r JOIN s ON r.name = s.name AND r.path = s.path UNION ALL SELECT rel, s.id, 2 FROM r JOIN s ON hint = qn UNION ALL SELECT rel, s.id, 4 FROM r JOIN s ON r.name = s.name),
  u AS (SELECT rel, tier, min(id) AS id FROM t GROUP BY rel, tier HAVING count(DISTINCT id) = 1)
  SELECT rel, arg_min(id, tier) AS id, CAST(min(tier) AS BIGINT) AS tier FROM u GROUP BY rel""")
def _(spark, sf):
    p = P.table(spark, sf, "part")
    qn = F.concat_ws(".", "p_type", "p_brand", F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")))
    o = P.table(spark, sf, "orders").withColumn("k", F.col("o_orderkey") % 200).join(p, F.col("k") == F.col("p_partkey"))
    rel = o.select(F.col("o_orderkey").alias("rel"), F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 5 + 11).cast("string")).alias("path"), F.col("p_name").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, qn).alias("hint"))
    return RS.resolve_relations(rel, p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"), F.col("p_name").alias("name"), qn.alias("qualified_name")))


@query("J15_overrides", """WITH o AS (SELECT l_orderkey AS type, l_linenumber AS pos, 'p'||l_partkey AS ancestor FROM lineitem), m AS (SELECT 'p'||p_partkey AS id, 'p'||p_partkey AS type, p_brand AS name FROM part),
  x AS (SELECT o_orderkey AS type, 'Brand#'||(11 + o_orderkey % 5) AS name FROM orders)
  SELECT 'o'||x.type AS src, arg_min(m.id, (pos, m.id)) AS dst FROM x JOIN o USING (type) JOIN m ON m.type = o.ancestor AND m.name = x.name GROUP BY x.type""")
def _(spark, sf):
    li = P.table(spark, sf, "lineitem")
    order = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("type"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("ancestor"))
    o = P.table(spark, sf, "orders")
    key = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    mine = o.select(key.alias("id"), key.alias("type"), F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 5 + 11).cast("string")).alias("name"))
    k = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    return RS.overrides(mine.union(P.table(spark, sf, "part").select(k.alias("id"), k.alias("type"), F.col("p_brand").alias("name"))), order)


@query("J26_unused_keys", "SELECT p_partkey AS id, CASE WHEN lower(p_name) LIKE '%old%' OR lower(p_name) LIKE '%legacy%' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def _(spark, sf):
    uses = P.table(spark, sf, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("dst"))
    return RS.unused_keys(P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), uses)


@query("J27_missing_keys", "SELECT event_type AS name, array_to_string(list_sort(list_distinct(list(CAST(user_id % 3 AS VARCHAR)))), ',') AS paths FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_id = 0) GROUP BY 1")
def _(spark, sf):
    e = P.table(spark, sf, "events")
    return RS.missing_keys(e.select(F.col("event_type").alias("name"), (F.col("user_id") % 3).cast("string").alias("path")), e.filter("event_id = 0").select(F.col("event_type").alias("name")))


@query("J21_file_cascade", f"WITH {SPARSE}, f AS (SELECT DISTINCT a.p_brand AS s, b.p_brand AS t FROM e JOIN part a ON a.p_partkey = e.s JOIN part b ON b.p_partkey = e.t) SELECT DISTINCT s AS id, CAST(1 AS BIGINT) AS hops FROM f WHERE t = 'Brand#11' AND s <> 'Brand#11'")
def _(spark, sf):
    b = P.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    e = P.part_calls_sparse(spark, sf).join(b.toDF("s", "a"), "s").join(b.toDF("t", "b"), "t").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return A.impact_radius(e, spark.createDataFrame([("Brand#11",)], "id string"), 1)


@query("G28_diffusion", """WITH x0 AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), e AS (SELECT vec_id AS s, (vec_id * 7 + 1) % 100 AS t FROM embeddings UNION ALL SELECT vec_id, (vec_id * 3 + 2) % 100 FROM embeddings WHERE vec_id % 2 = 0),
  """ + ", ".join(f"m{i} AS (SELECT e.s AS id, dim, avg(x) AS m FROM e JOIN x{i - 1} x ON x.id = e.t GROUP BY ALL), x{i} AS (SELECT id, dim, CASE WHEN m IS NULL THEN x ELSE 0.75 * x + 0.25 * m END AS x FROM x{i - 1} LEFT JOIN m{i} USING (id, dim))" for i in (1, 2)) + """
  SELECT id, CAST(dim AS BIGINT) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM x2""")
def _(spark, sf):
    v = P.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    e = v.select(F.col("id").alias("src"), ((F.col("id") * 7 + 1) % 100).alias("dst")).unionAll(v.filter("id % 2 = 0").select("id", (F.col("id") * 3 + 2) % 100))
    return S.diffused(v, e).select("id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


@query("Q17_keyword_recall", "SELECT p_partkey AS id, round((CASE WHEN contains(' '||p_name||' ', ' green ') THEN 1 ELSE 0 END + CASE WHEN contains(' '||p_name||' ', ' part ') THEN 1 ELSE 0 END) / 2.0, 6)::DOUBLE AS recall FROM part")
def _(spark, sf):
    return P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(S.keyword_recall(T.tokens(F.col("p_name")), ["green", "part"]), 6).alias("recall"))


@query("D03_review_seeds", f"WITH {CHANGES} SELECT DISTINCT id FROM (SELECT src AS id FROM x UNION ALL SELECT dst FROM x UNION ALL SELECT p_partkey FROM part WHERE p_size = 50)")
def _(spark, sf):
    x = H.diff_edges(*_snapshots(spark, sf))
    hunk = P.table(spark, sf, "part").filter("p_size = 50").select(F.col("p_partkey").alias("id"))
    return x.select(F.col("src").alias("id")).union(x.select("dst")).union(hunk).distinct()


@query("A27_blast_summary", f"""WITH RECURSIVE {SPARSE}, r(id, hops) AS (SELECT p_partkey, CAST(0 AS BIGINT) FROM part WHERE p_partkey % 400 = 3 UNION SELECT e.s, least(hops + 1, 2) FROM r JOIN e ON e.t = r.id),
  m AS (SELECT id, min(hops) AS hops FROM r GROUP BY 1 HAVING min(hops) > 0), f AS (SELECT 'file' AS kind, p_brand AS name, count(*) AS n FROM m JOIN part ON p_partkey = id GROUP BY 2 ORDER BY n DESC, name LIMIT 10)
  SELECT 'direct' AS kind, NULL AS name, count(*) FILTER (hops = 1) AS n FROM m UNION ALL SELECT 'transitive', NULL, count(*) FROM m UNION ALL SELECT * FROM f""")
def _(spark, sf):
    places = P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"))
    return RP.blast_summary(_calls(spark, sf), places, _parts(spark, sf).filter("id % 400 = 3"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct calls between parts, through the pattern language."""
    return gql.run(P.call_graph(spark, sf_dir), "MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a, b")


from lattica import more_queries  # noqa: E402, F401  registers its queries here

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
