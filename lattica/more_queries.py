"""More registered queries: scopes, reports, changes, resolution and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import source_text as ST
from lattica.functions import text as T
from lattica.functions import versions as VS
from lattica.graph import PropertyGraph, as_edges, as_nodes
from lattica.operators import algorithms as A
from lattica.operators import flow as N
from lattica.operators import mutations as M
from lattica.operators import reports as RP
from lattica.operators import resolution as RS
from lattica.operators import verbs as V
from lattica.queries import DENSE, EDGES, NODES, PARTS, SPARSE, P, _calls, query
from lattica.sources import exports as EX
from lattica.sources import formats as FM
from lattica.sources import python_source as PY


def _part(spark, sf, **columns):
    return P.table(spark, sf, "part").select(*[F.expr(x).alias(n) for n, x in columns.items()])


# --- scopes, members, symbols

_IN = "(translate(qn, '\\.', '//') LIKE 'ECONOMY%' OR (qn IS NULL AND '/'||path||'/' LIKE '%/ECONOMY/%'))"


@query("P09_scope_crossing", f"WITH {NODES}, {EDGES}, w AS (SELECT id, coalesce({_IN}, false) AS i FROM n) SELECT g.src, g.dst, g.edge_type FROM g JOIN w a ON a.id = src JOIN w b ON b.id = dst WHERE a.i <> b.i")
def _(spark, sf):
    return V.scoped_edges(P.entity_graph(spark, sf), "ECONOMY", "crossing")


@query("P14_constructors", "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 IN (0, 1) OR p_partkey % 5 = 0")
def _(spark, sf):
    rows = _part(spark, sf, id="p_partkey", name="p_type", node_type="'function'", qn="element_at(array(concat(p_type, '::', p_type), concat('a.', p_type, '.', p_type, '(int)'), concat(p_type, 'x.', p_type), p_type), int(p_partkey % 4 + 1))", properties="if(p_partkey % 5 = 0, map('is_constructor', 'true'), map('kind', 'method'))")
    return rows.filter(T.is_constructor(F.col("node_type"), F.col("name"), F.col("qn"), F.col("properties"))).select("id")


@query("P15_members", "SELECT p_type||'.'||p_brand AS type, 'part:'||p_partkey AS id FROM part")
def _(spark, sf):
    parts = P.part_nodes(spark, sf)
    parts = parts.withColumn("qualified_name", F.regexp_replace("qualified_name", "#([0-9]+)$", "_$1"))
    kind = F.concat_ws(".", "p_type", "p_brand")
    # The brand's own mark splits owners, so it is written as a word here.
    parts = parts.withColumn("qualified_name", F.regexp_replace("qualified_name", "Brand#", "Brand"))
    types = P.table(spark, sf, "part").select(kind.alias("id"), F.lit("class").alias("node_type"), F.regexp_replace(kind, "#", "").alias("qualified_name")).distinct()
    return V.members(PropertyGraph(parts.unionByName(as_nodes(types)), parts.sparkSession.createDataFrame([], "src string, dst string, edge_type string")))


@query("P16_symbols", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 1 THEN 'src/m.rs' END AS file, CASE WHEN p_partkey % 3 = 0 THEN 'a::'||p_type END AS klass, replace(p_name, ' ', '_') AS name FROM part")
def _(spark, sf):
    rows = _part(spark, sf, id="p_partkey", s="concat(element_at(array(concat('a::', p_type, '::'), 'src/m.rs:', ''), int(p_partkey % 3 + 1)), replace(p_name, ' ', '_'))")
    return rows.select("id", T.symbol_parts(F.col("s")).alias("x")).select("id", "x.file", F.col("x.class").alias("klass"), "x.name")


@query("P25_json_cells", f"WITH {NODES} SELECT CAST(json_object('id', id, 'name', name, 'type', node_type) AS VARCHAR) AS cell FROM n WHERE node_type <> 'file'")
def _(spark, sf):
    return V.as_json(P.entity_graph(spark, sf).nodes.filter("node_type <> 'file'").withColumn("type", F.col("node_type")), "id", "name", "type")


@query("P27_excluded", f"WITH {PARTS} SELECT id FROM parts WHERE contains('/'||lower(path)||'/', '/economy/') OR contains('/'||lower(path)||'/', '/small/brand4/')")
def _(spark, sf):
    return P.part_nodes(spark, sf).filter(T.excluded(F.col("file_path"), ["**/ECONOMY/**", "small/Brand4/*", "**"])).select("id")


@query("P31_field_writes", "SELECT p_partkey AS site FROM part WHERE p_type = 'SMALL' AND p_name LIKE 'b%' AND p_partkey % 3 <> 0")
def _(spark, sf):
    writes = _part(spark, sf, site="p_partkey", receiver_type="concat('a.b::', p_type)", member="left(p_name, 1)", in_constructor="p_partkey % 3 = 0")
    return V.field_writes(writes, "SMALL", "b").select("site")


@query("P34_semantic_scope", "SELECT p_partkey AS id, p_size AS rank FROM part WHERE p_partkey % 4 IN (0, 2)")
def _(spark, sf):
    nodes = _part(spark, sf, id="p_partkey", node_type="if(p_partkey % 4 = 0, 'function', 'module')", properties="map('kind', element_at(array('x', 'file', 'heading', 'other'), int(p_partkey % 4 + 1)))")
    return V.semantic_scope(_part(spark, sf, id="p_partkey", rank="p_size"), nodes)


@query("J28_multi_callers", f"""WITH {SPARSE}, c AS (SELECT 'part:'||s AS id, t, row_number() OVER (PARTITION BY t ORDER BY 'part:'||s) AS k FROM e WHERE t % 100 = 5)
  SELECT id, arg_min('part:'||t, (t, 'part:'||t)) AS seed FROM c WHERE k <= 2 GROUP BY id""")
def _(spark, sf):
    seeds = _part(spark, sf, id="concat('part:', p_partkey)", place="p_partkey").filter("place % 100 = 5")
    return V.multi_callers(P.call_graph(spark, sf), seeds, 2)


# --- reports

@query("A07_inventory_filter", f"WITH {NODES} SELECT node_type AS bucket, count(*) AS n FROM n WHERE node_type LIKE 'f%' GROUP BY 1 ORDER BY n DESC, bucket LIMIT 2")
def _(spark, sf):
    return V.bucket_prefix(V.inventory(P.entity_graph(spark, sf), "type").filter("n > 0"), "f", 2)


@query("A16_package_summary", f"""WITH {DENSE}, d AS (SELECT s AS id, count(*) AS x FROM e GROUP BY 1), m AS (SELECT p_partkey AS id, p_brand AS package, p_type AS community, p_size AS size, coalesce(x, 0) AS x FROM part LEFT JOIN d ON id = p_partkey),
  l AS (SELECT package FROM m GROUP BY 1 ORDER BY count(*) DESC, package LIMIT 6), q AS (SELECT * REPLACE (CASE WHEN package IN (FROM l) THEN package ELSE '(other)' END AS package) FROM m),
  v AS (SELECT package, community, count(*) AS n FROM q GROUP BY ALL), b AS (SELECT package, arg_min(community, (-n, community)) AS community FROM v GROUP BY 1)
  SELECT package, count(*) AS members, round(avg(x), 6) AS pagerank, round(avg(size), 6) AS harmonic, round(avg(x * size), 6) AS betweenness, max(x) AS blast, any_value(b.community) AS community FROM q JOIN b USING (package) GROUP BY 1""")
def _(spark, sf):
    out = P.part_calls(spark, sf).groupBy(F.col("s").alias("id")).agg(F.count(F.lit(1)).alias("x"))
    m = RP.function_metrics(_part(spark, sf, id="p_partkey", package="p_brand", community="p_type", size="p_size"), out).withColumn("x", F.coalesce("x", F.lit(0)))
    m = m.select("id", "package", "community", F.col("x").alias("pagerank"), F.col("size").alias("harmonic"), (F.col("x") * F.col("size")).alias("betweenness"), F.col("x").alias("blast"))
    return RP.package_summary(m, 6).withColumns({c: F.round(c, 6) for c in ("pagerank", "harmonic", "betweenness")})


@query("A18_metanodes", "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), b AS (SELECT p_brand, arg_min(p_type, (-n, p_type)) AS community FROM c GROUP BY 1) SELECT p_brand AS package, count(*) FILTER (p_partkey % 3 > 0) AS functions, count(*) FILTER (p_partkey % 3 = 0) AS classes, round(avg(p_size), 6) AS complexity, any_value(community) AS community FROM part JOIN b USING (p_brand) GROUP BY 1")
def _(spark, sf):
    return RP.metagraph(*_meta(spark, sf))[0].withColumn("complexity", F.round("complexity", 6))


@query("A18_metaedges", f"WITH {DENSE} SELECT a.p_brand AS a, b.p_brand AS b, CASE WHEN s % 2 = 0 THEN 'calls' ELSE 'uses' END AS edge_type, count(*) AS n FROM e JOIN part a ON a.p_partkey = s JOIN part b ON b.p_partkey = t WHERE a.p_brand <> b.p_brand GROUP BY ALL")
def _(spark, sf):
    return RP.metagraph(*_meta(spark, sf))[1]


def _meta(spark, sf):
    nodes = _part(spark, sf, id="p_partkey", package="p_brand", node_type="if(p_partkey % 3 = 0, 'class', 'function')", complexity="p_size", community="p_type")
    return nodes, P.part_calls(spark, sf).select(F.col("s").alias("src"), F.col("t").alias("dst"), F.expr("if(s % 2 = 0, 'calls', 'uses')").alias("edge_type"))


@query("A22_change_risk", f"""WITH {SPARSE}, d AS (SELECT t AS id, count(DISTINCT s) AS impact FROM e GROUP BY 1)
  SELECT p_brand AS file, count(*) AS symbols, max(25.0::DOUBLE * impact) AS score, max(impact) AS impact, CASE WHEN max(25 * impact) >= 80 OR max(impact) >= 50 THEN 'critical' WHEN max(25 * impact) >= 60 THEN 'high' WHEN max(25 * impact) >= 40 THEN 'medium' ELSE 'low' END AS risk FROM part JOIN d ON id = p_partkey WHERE p_size > 10 GROUP BY 1""")
def _(spark, sf):
    d = _calls(spark, sf).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("impact")).withColumn("score", 25.0 * F.col("impact"))
    return RP.change_risk(_part(spark, sf, file="p_brand"), _part(spark, sf, id="p_partkey", file="p_brand", size="p_size").filter("size > 10").drop("size"), d)


@query("A24_function_metrics", f"WITH {SPARSE}, i AS (SELECT t AS id, count(*) AS fan_in FROM e GROUP BY 1), o AS (SELECT s AS id, count(*) AS fan_out FROM e GROUP BY 1) SELECT p_partkey AS id, p_size AS complexity, fan_in, fan_out FROM part LEFT JOIN i ON i.id = p_partkey LEFT JOIN o ON o.id = p_partkey")
def _(spark, sf):
    e = _calls(spark, sf)
    own = [e.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias(n)) for c, n in (("dst", "fan_in"), ("src", "fan_out"))]
    return RP.function_metrics(_part(spark, sf, id="p_partkey", complexity="p_size"), *own)


@query("A26_verdict_counts", "SELECT event_type AS verdict, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return RP.verdict_counts(P.table(spark, sf, "events").withColumnRenamed("event_type", "verdict"))


@query("W14_seed_ranking", "SELECT p_partkey AS id, p_size > 40 AS touched, true AS truncated FROM part ORDER BY touched DESC, id LIMIT 50")
def _(spark, sf):
    return RP.ranked_seeds(_part(spark, sf, id="p_partkey", touched="p_size > 40"))


@query("G02_hotspots", f"WITH {SPARSE} SELECT t AS id, count(*)::DOUBLE AS score FROM e JOIN part ON p_partkey = t WHERE p_partkey % 4 <> 1 AND p_partkey % 7 <> 0 GROUP BY 1")
def _(spark, sf):
    nodes = _part(spark, sf, id="p_partkey", name="if(p_partkey % 7 = 0, 'std::println!', p_name)", file_path="if(p_partkey % 4 = 1, 'tests/x.rs', 'src/x.rs')")
    scores = _calls(spark, sf).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return RP.hotspots(scores, nodes)


@query("G14_type_blast", f"""WITH RECURSIVE {SPARSE}, m AS (SELECT p_brand AS type, p_partkey AS id FROM part WHERE p_brand IN ('Brand#2', 'Brand#17')), r(type, id) AS (SELECT * FROM m UNION SELECT r.type, e.s FROM r JOIN e ON e.t = r.id)
  SELECT * FROM r EXCEPT SELECT * FROM m""")
def _(spark, sf):
    return RP.type_blast(_calls(spark, sf), _part(spark, sf, type="p_brand", id="p_partkey").filter("type IN ('Brand#2', 'Brand#17')"))


@query("G24_community_labels", """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), b AS (SELECT p_brand, arg_min(p_type, (-n, p_type)) AS t, max(n) AS n, sum(n) AS every FROM c GROUP BY 1),
  s AS (SELECT p_brand, arg_max(p_name, (p_retailprice, p_name)) AS name FROM part GROUP BY 1), l AS (SELECT p_brand AS id, CASE WHEN 3 * n >= every THEN t ELSE name END AS label FROM b JOIN s USING (p_brand)),
  k AS (SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY id) AS k FROM l) SELECT id, CASE WHEN k = 1 THEN label ELSE label||' ('||k||')' END AS label FROM k""")
def _(spark, sf):
    return RP.community_labels(_part(spark, sf, community="p_brand", package="p_type", name="p_name", score="p_retailprice"))


# --- resolution

@query("J14_parked", """WITH r AS (SELECT o_orderkey AS rel, CAST(o_orderkey % 2 AS INT) AS repo, p_partkey AS k, p_name AS name, CASE WHEN o_orderkey % 3 = 0 THEN p_type||'.'||p_partkey END AS hint, p_brand AS m FROM orders JOIN part ON p_partkey = o_orderkey % 150),
  s AS (SELECT p_partkey AS id, CAST(p_size % 2 AS INT) AS repo, p_type||'.'||p_partkey AS qn, p_name AS name, p_brand AS m FROM part),
  t AS (SELECT rel, id, 1 AS tier FROM r JOIN s ON hint = qn AND r.repo <> s.repo UNION ALL SELECT rel, id, 2 FROM r JOIN s ON r.name = s.name AND r.m = s.m AND r.repo <> s.repo UNION ALL SELECT rel, id, 3 FROM r JOIN s ON r.name = s.name AND r.repo <> s.repo),
  u AS (SELECT rel, tier, min(id) AS id FROM t GROUP BY ALL HAVING count(DISTINCT id) = 1) SELECT rel, arg_min(id, tier) AS id, min(tier) AS tier FROM u GROUP BY 1""")
def _(spark, sf):
    p = P.table(spark, sf, "part")
    o = P.table(spark, sf, "orders").withColumn("k", F.col("o_orderkey") % 150).join(p, F.col("k") == F.col("p_partkey"))
    rel = o.select(F.col("o_orderkey").alias("rel"), F.expr("int(o_orderkey % 2)").alias("repo"), F.expr("if(o_orderkey % 3 = 0, concat(p_type, '.', p_partkey), null)").alias("hint"), F.expr("concat('./src/', p_brand, '/index')").alias("module"), F.col("p_name").alias("name"))
    sym = _part(spark, sf, id="p_partkey", repo="int(p_size % 2)", qualified_name="concat(p_type, '.', p_partkey)", path="concat('lib/', p_brand, '.ts')", name="p_name")
    return RS.parked(rel, sym)


@query("G32_inheritance", "WITH t AS (SELECT p_partkey AS id, p_name||(p_partkey % 50) AS name FROM part), s AS (SELECT name, min(id) AS dst FROM t GROUP BY 1 HAVING count(*) = 1) SELECT DISTINCT p_partkey AS src, dst FROM part JOIN s ON s.name = p_name||(p_size % 50) WHERE p_partkey <> dst")
def _(spark, sf):
    types = _part(spark, sf, id="p_partkey", name="concat(p_name, p_partkey % 50)")
    return RS.inheritance(_part(spark, sf, id="p_partkey", base="concat(p_name, p_size % 50)"), types)


@query("G31_inherited_calls", """WITH o AS (SELECT l_orderkey AS type, l_linenumber AS pos, l_partkey AS ancestor FROM lineitem), c AS (SELECT o_orderkey AS src, o_orderkey AS type, 'Brand#'||(1 + o_orderkey % 5) AS name FROM orders)
  SELECT DISTINCT src, arg_min(p_partkey, (pos, p_partkey)) AS dst FROM c JOIN o USING (type) JOIN part ON p_partkey = ancestor AND p_brand = name GROUP BY src, type, name""")
def _(spark, sf):
    order = P.table(spark, sf, "lineitem").selectExpr("l_orderkey AS type", "l_linenumber AS pos", "l_partkey AS ancestor")
    calls = P.table(spark, sf, "orders").selectExpr("o_orderkey AS src", "o_orderkey AS type", "concat('Brand#', 1 + o_orderkey % 5) AS name")
    return RS.inherited_calls(calls, _part(spark, sf, id="p_partkey", type="p_partkey", name="p_brand"), order)


@query("S26_config_links", """WITH k AS (SELECT p_partkey AS id, 'app.'||replace(p_name, ' ', '-')||p_partkey AS name FROM part WHERE p_partkey % 2 = 0)
  SELECT p_partkey AS site, p_partkey AS id, p_partkey % 4 = 0 AS exact FROM part WHERE p_partkey % 2 = 0""")
def _(spark, sf):
    keys = _part(spark, sf, id="p_partkey", name="concat('app.', replace(p_name, ' ', '-'), p_partkey)").filter("id % 2 = 0")
    uses = _part(spark, sf, site="p_partkey", name="if(p_partkey % 4 = 0, concat('app.', replace(p_name, ' ', '-'), p_partkey), concat(upper(replace(p_name, ' ', '_')), p_partkey))")
    return RS.config_links(uses, keys)


# --- changes

@query("U06_merged_changes", """WITH x AS (SELECT p_brand AS path, 'added' AS kind, 0 AS k FROM part WHERE p_size < 5 UNION ALL SELECT p_brand, 'changed', 1 FROM part WHERE p_size < 20 UNION ALL SELECT p_brand, 'deleted', 2 FROM part)
  SELECT path, arg_min(kind, k) AS kind FROM x GROUP BY 1""")
def _(spark, sf):
    of = lambda most, kind: _part(spark, sf, path="p_brand", kind=f"'{kind}'", size="p_size").filter(f"size < {most}")
    return M.merged_changes(of(5, "added"), of(20, "changed"), of(1000, "deleted"))


@query("U09_preferred", "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'delta' ELSE 'base' END AS origin FROM part")
def _(spark, sf):
    base = _part(spark, sf, id="p_partkey", origin="'base'")
    return M.preferred(_part(spark, sf, id="p_partkey", origin="'delta'", size="p_size").filter("size > 25").drop("size"), base)


def _updated(spark, sf):
    """Files (brands) whose hash changed are read again: their parts come back renamed."""
    base = P.call_graph(spark, sf)
    base = PropertyGraph(base.nodes.withColumn("file_path", F.element_at(F.split("qualified_name", r"[.]"), 2)), base.edges)
    old = _part(spark, sf, path="p_brand", hash="p_brand").distinct()
    new = old.filter("path <> 'Brand#4'").withColumn("hash", F.expr("if(path = 'Brand#2', 'moved', hash)"))

    def extract(files):
        nodes = base.nodes.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi")
        ids = nodes.select("id")
        nodes = nodes.withColumn("name", F.lit("read again")).select(*base.nodes.columns)
        edges = ids.select(F.col("id").alias("src"), F.lit("part:1").alias("dst"), F.lit("calls").alias("edge_type"))
        return PropertyGraph(nodes, as_edges(edges))

    return M.updated(base, old, new, extract)


@query("T05_updated_nodes", "SELECT 'part:'||p_partkey AS id, CASE WHEN p_brand = 'Brand#2' THEN 'read again' ELSE p_name END AS name FROM part WHERE p_brand <> 'Brand#4'")
def _(spark, sf):
    return _updated(spark, sf).nodes.select("id", "name")


@query("T07_head_edges", f"""WITH {SPARSE} SELECT 'part:'||s AS src, 'part:'||t AS dst FROM e JOIN part a ON a.p_partkey = s JOIN part b ON b.p_partkey = t WHERE a.p_brand NOT IN ('Brand#2', 'Brand#4') AND b.p_brand <> 'Brand#4'
  UNION ALL SELECT 'part:'||p_partkey, 'part:1' FROM part WHERE p_brand = 'Brand#2'""")
def _(spark, sf):
    return _updated(spark, sf).edges.select("src", "dst")


@query("T08_stale", "SELECT 'part:'||p_partkey AS id FROM part WHERE p_size > 30")
def _(spark, sf):
    nodes = P.part_nodes(spark, sf)
    now = nodes.withColumn("name", F.expr("if(end_line > 30, 'x', name)")).withColumn("end_line", F.col("end_line") + 1)
    return M.stale(M.digest(nodes.drop("properties")), now.drop("properties"))


@query("T09_mutations", f"""WITH {NODES}, {EDGES}, k AS (SELECT * FROM g WHERE edge_type <> 'references' AND src NOT LIKE 'nation:1%' AND dst NOT LIKE 'nation:1%')
  SELECT id, CASE WHEN id LIKE 'part:%' THEN 'yes' END AS seen FROM n WHERE id NOT LIKE 'nation:1%' AND (id IN (SELECT src FROM k) OR id IN (SELECT dst FROM k) OR node_type <> 'class')""")
def _(spark, sf):
    g = P.entity_graph(spark, sf)
    g = M.without_edges(g, F.col("edge_type") == "references")
    g = M.deleted(g, g.nodes.filter("id LIKE 'nation:1%'").select("id"))
    g = M.without_orphans(g, "class")
    g = M.with_properties(g, g.nodes.filter("id LIKE 'part:%'").select("id", F.expr("map('seen', 'yes', 'cyclomatic', cast(null AS string))").alias("properties")))
    return g.nodes.select("id", F.col("properties")["seen"].alias("seen"))


# --- scalar functions

@query("F07_module_segments", r"""WITH x AS (SELECT p_partkey AS id, list_filter(string_split(lower(p_type)||'/'||lower(p_brand)||'/'||replace(p_name, ' ', '_'), '/'), lambda t: t NOT IN ('src', 'lib')) AS s FROM part) SELECT id, array_to_string(s, '>') AS segments, CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS shared FROM x""")
def _(spark, sf):
    rows = _part(spark, sf, id="p_partkey", a="concat('\"@src/', p_type, '/lib/', p_brand, '/', replace(p_name, ' ', '_'), element_at(array('/index.ts', '.py'), int(p_partkey % 2 + 1)), '\"')", b="if(p_partkey % 2 = 0, concat('../x/', p_brand, '::', replace(p_name, ' ', '_')), 'none')")
    s = T.module_segments(F.col("a"))
    return rows.select("id", F.array_join(s, ">").alias("segments"), T.suffix_overlap(s, T.module_segments(F.col("b"))).alias("shared"))


@query("F14_severity", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 10 WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN 7 WHEN p_partkey % 3 = 0 THEN 9 ELSE 5 END AS severity FROM part")
def _(spark, sf):
    rows = _part(spark, sf, id="p_partkey", a="element_at(array('http_parameter', 'file_input', 'user'), int(p_partkey % 3 + 1))", b="element_at(array('sql_query', 'html_render'), int(p_partkey % 2 + 1))")
    return rows.select("id", T.severity(F.col("a"), F.col("b")).alias("severity"))


@query("F15_purls", "SELECT p_partkey AS id, 'pkg:npm/'||CASE WHEN p_partkey % 2 = 0 THEN p_type||'/' ELSE '' END||replace(p_name, ' ', '-')||'@1.'||p_size AS url, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS namespace, '1.'||p_size AS version FROM part")
def _(spark, sf):
    rows = _part(spark, sf, id="p_partkey", ns="if(p_partkey % 2 = 0, p_type, null)", name="replace(p_name, ' ', '-')", v="concat('1.', p_size)")
    rows = rows.withColumn("url", T.purl(F.lit("NPM"), F.col("ns"), F.col("name"), F.col("v")))
    parts = T.purl_parts(F.concat("url", F.lit("?arch=x#y")))
    return rows.select("id", "url", parts["namespace"].alias("namespace"), parts["version"].alias("version"))


@query("F16_versions", "SELECT a.n AS a, b.n AS b, a.k < b.k AS less FROM (VALUES " + ", ".join(f"('{v}', {k})" for k, v in enumerate(VS.SAMPLE)) + ") a(n, k), (VALUES " + ", ".join(f"('{v}', {k})" for k, v in enumerate(VS.SAMPLE)) + ") b(n, k)")
def _(spark, sf):
    v = spark.createDataFrame([(x,) for x in VS.SAMPLE], "n string").withColumn("k", VS.version_key("semver")(F.col("n")))
    return v.toDF("a", "x").crossJoin(F.broadcast(v.toDF("b", "y"))).select("a", "b", (F.col("x") < F.col("y")).alias("less"))


_M64 = "18446744073709551616::UHUGEINT"


@query("F17_splitmix", f"""WITH x AS (SELECT p_partkey AS id, ((p_partkey::UHUGEINT + 11400714819323198485::UHUGEINT) % {_M64})::UBIGINT AS z FROM part),
  y AS (SELECT id, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % {_M64})::UBIGINT AS z FROM x), w AS (SELECT id, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % {_M64})::UBIGINT AS z FROM y)
  SELECT id, lower(to_hex(xor(z, z >> 31))) AS h FROM w""")
def _(spark, sf):
    return _part(spark, sf, id="p_partkey").select("id", F.lower(F.hex(VS.splitmix64(F.col("id")))).alias("h"))


@query("F18_stable_key", "SELECT p_partkey AS id, md5(p_type||chr(255)||p_brand||chr(255)||''||chr(255)||p_partkey) AS key FROM part")
def _(spark, sf):
    return _part(spark, sf, p_partkey="p_partkey", p_type="p_type", p_brand="p_brand").select(F.col("p_partkey").alias("id"), T.stable_key(F.col("p_type"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_partkey")).alias("key"))


@query("F22_idl_types", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'i64' WHEN 1 THEN 'double' WHEN 2 THEN 'bool' ELSE 'string' END AS thrift, CASE p_partkey % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'boolean' ELSE 'string' END AS openapi FROM part")
def _(spark, sf):
    rows = _part(spark, sf, id="p_partkey", kind="element_at(array('int64', 'double', 'bool', 'Thing'), int(p_partkey % 4 + 1))")
    return rows.select("id", T.idl_type(F.col("kind"), "thrift").alias("thrift"), T.idl_type(F.col("kind"), "openapi").alias("openapi"))


@query("S22_facts_cache", "SELECT DISTINCT p_name||'|'||p_type AS hash FROM part WHERE p_name||'|'||p_type NOT IN (SELECT p_name||'|'||p_type FROM part WHERE p_size < 10)")
def _(spark, sf):
    every = _part(spark, sf, hash="concat(p_name, '|', p_type)", size="p_size")
    return every.select("hash").distinct().join(every.filter("size < 10"), "hash", "left_anti")


# --- extraction and flow

def _files(spark, sf):
    """A Python file for each part: a function that calls another part's, and a loop."""
    text = "concat('import os\n\ndef f', p_partkey, '(a):\n    b = a\n    while b:\n        b = f', p_partkey % 7, '(b)\n        if b > ', p_size, ':\n            return a\n    return b\n')"
    # A few MB of parts are one or two tasks to a scan, but many files: they are dealt to all.
    dealt = P.table(spark, sf, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return dealt.select(F.expr("concat('m', p_partkey, '.py')").alias("path"), F.expr(text).alias("content"))


@query("S05_extract_nodes", "SELECT 'm'||p_partkey||'.py' AS id, 'module' AS node_type, 1 AS start_line, 11 AS end_line FROM part UNION ALL SELECT 'm'||p_partkey||'.py::f'||p_partkey, 'function', 3, 9 FROM part")
def _(spark, sf):
    return PY.extract(_files(spark, sf)).nodes.select("id", "node_type", "start_line", F.expr("if(node_type = 'module', end_line + 1, end_line)").alias("end_line"))


@query("S05_extract_calls", "SELECT 'm'||p_partkey||'.py::f'||p_partkey AS src, 'm'||(p_partkey % 7)||'.py::f'||(p_partkey % 7) AS dst FROM part WHERE p_partkey % 7 IN (SELECT p_partkey FROM part)")
def _(spark, sf):
    return PY.extract(_files(spark, sf)).edges_of("calls").select("src", "dst")


@query("N01_control_flow", "SELECT 'm'||p_partkey||'.py::f'||p_partkey AS fn, a AS line, b AS next FROM part, (VALUES (0, 4), (4, 5), (5, 6), (6, 7), (7, 8), (7, 5), (8, -1), (5, 9), (9, -1)) v(a, b)")
def _(spark, sf):
    return PY.control_flow(_files(spark, sf)).select("fn", "line", "next")


@query("N02_defs_uses", "SELECT 'm'||p_partkey||'.py::f'||p_partkey AS fn, a AS line, d AS defs, replace(u, 'f', 'f'||(p_partkey % 7)) AS uses FROM part, (VALUES (0, 'a', ''), (4, 'b', 'a'), (5, '', 'b'), (6, 'b', 'b,f'), (7, '', 'b'), (8, '', 'a'), (9, '', 'b')) v(a, d, u)")
def _(spark, sf):
    return PY.control_flow(_files(spark, sf)).select("fn", "line", F.array_join("defs", ",").alias("defs"), F.array_join("uses", ",").alias("uses")).distinct()


def _python_flow(spark, sf):
    rows = PY.control_flow(_files(spark, sf)).persist()
    stmts = rows.select("fn", "line", F.when(F.size("defs") > 0, F.col("defs")[0]).alias("def"), "uses").distinct()
    return stmts, rows.select("fn", F.col("line").alias("src"), F.col("next").alias("dst"))


def _python_ways(spark, sf):
    return PY.control_flow(_files(spark, sf)).select("fn", F.col("line").alias("src"), F.col("next").alias("dst"))


_FN = "SELECT 'm'||p_partkey||'.py::f'||p_partkey AS fn"


@query("N06_reaching", f"{_FN}, v, s AS src, t AS at FROM part, (VALUES ('a', 0, 4), ('a', 0, 5), ('a', 0, 6), ('a', 0, 7), ('a', 0, 8), ('a', 0, 9), ('a', 0, -1), ('b', 4, 5), ('b', 4, 6), ('b', 4, 9), ('b', 4, -1), ('b', 6, 7), ('b', 6, 8), ('b', 6, 5), ('b', 6, 6), ('b', 6, 9), ('b', 6, -1)) x(v, s, t)".replace("fn, v,", "fn, v AS var,"))
def _(spark, sf):
    return N.reaching_definitions(*_python_flow(spark, sf))


@query("N04_dominators", f"{_FN}, b AS block, d AS idom FROM part, (VALUES (4, 0), (5, 4), (6, 5), (7, 6), (8, 7), (9, 5), (-1, 5)) x(b, d)")
def _(spark, sf):
    return N.dominators(_python_ways(spark, sf))


@query("N04_frontiers", f"{_FN}, b AS block, d AS frontier FROM part, (VALUES (5, 5), (6, 5), (7, 5), (6, -1), (7, -1), (8, -1), (9, -1)) x(b, d)")
def _(spark, sf):
    return N.frontiers(_python_ways(spark, sf))


@query("N05_post_dominators", f"{_FN}, b AS block, d AS idom FROM part, (VALUES (9, -1), (8, -1), (7, -1), (6, 7), (5, -1), (4, 5), (0, 4)) x(b, d)")
def _(spark, sf):
    return N.post_dominators(_python_ways(spark, sf), -1)


@query("N08_control_deps", f"{_FN}, a AS src, b AS dst FROM part, (VALUES (5, 6), (5, 7), (5, 9), (7, 5), (7, 8)) x(a, b)")
def _(spark, sf):
    return N.control_dependencies(_python_ways(spark, sf))


@query("N09_loop_carried", f"{_FN}, a AS src, b AS dst, v AS var, c AS carried FROM part, (VALUES (0, 4, 'a', false), (4, 5, 'b', false), (4, 6, 'b', false), (4, 9, 'b', false), (6, 5, 'b', true), (6, 6, 'b', true), (6, 7, 'b', false), (6, 9, 'b', false), (0, 8, 'a', false)) x(a, b, v, c)")
def _(spark, sf):
    return N.data_dependencies(*_python_flow(spark, sf))


@query("N07_anti_deps", f"{_FN}, a AS src, b AS dst, 'b' AS var FROM part, (VALUES (5, 6), (6, 6)) x(a, b)")
def _(spark, sf):
    return N.anti_dependencies(_python_flow(spark, sf)[0])


@query("N10_flow_depth", f"SELECT fn||'#'||l AS id, CAST(d AS BIGINT) AS depth FROM ({_FN} FROM part), (VALUES (0, 0), (4, 1), (8, 1), (5, 2), (6, 2), (9, 2), (7, 3)) x(l, d)")
def _(spark, sf):
    stmts, cfg = _python_flow(spark, sf)
    return N.flow_depth(N.data_dependencies(stmts, cfg).filter("NOT carried"))


@query("N12_aliases", "SELECT p_partkey||'#'||v AS id, p_partkey||'#a' AS component FROM part, (VALUES ('a'), ('b'), ('b.x'), ('c')) x(v) UNION ALL SELECT p_partkey||'#'||v, p_partkey||'#d' FROM part, (VALUES ('d'), ('d.y')) x(v)")
def _(spark, sf):
    one = F.explode(F.expr("array(struct('b' AS d, array('a') AS u), struct('c' AS d, array('b.x') AS u), struct('b.x' AS d, array('c') AS u), struct('c' AS d, array('b') AS u), struct('d' AS d, array('a', 'd.y') AS u))"))
    stmts = _part(spark, sf, fn="p_partkey").select("fn", one.alias("s")).select("fn", F.col("s.d").alias("def"), F.col("s.u").alias("uses"))
    return N.alias_names(stmts)


@query("N11_backward_slice", f"SELECT fn||'#'||l AS id, CAST(h AS BIGINT) AS hops FROM ({_FN} FROM part), (VALUES (9, 0), (4, 1), (6, 1), (0, 2)) x(l, h)")
def _(spark, sf):
    stmts, cfg = _python_flow(spark, sf)
    seeds = stmts.select(F.concat("fn", F.lit("#9")).alias("id")).distinct()
    return N.slice_of(N.data_dependencies(stmts, cfg), seeds)


@query("N03_unreachable", "SELECT p_partkey AS fn, CAST(v AS BIGINT) AS block FROM part, (VALUES (5), (6)) x(v)")
def _(spark, sf):
    edges = F.explode(F.expr("array(struct(0L AS s, 1L AS d), struct(1L AS s, 2L AS d), struct(5L AS s, 6L AS d), struct(6L AS s, 2L AS d))"))
    return N.unreachable(_part(spark, sf, fn="p_partkey").select("fn", edges.alias("e")).select("fn", F.col("e.s").alias("src"), F.col("e.d").alias("dst")))


@query("N15_taint", f"SELECT fn||'#8' AS id, CAST(1 AS BIGINT) AS hops FROM ({_FN} FROM part)")
def _(spark, sf):
    stmts, cfg = _python_flow(spark, sf)
    at = lambda line: stmts.select(F.concat("fn", F.lit(f"#{line}")).alias("id")).distinct()
    return N.taint(N.data_dependencies(stmts, cfg), at(0), at(8).union(at(9)), at(4))


@query("G34_simple_paths", f"{_FN}, p AS path FROM part, (VALUES ('0,4,5,6,7,8,-1'), ('0,4,5,9,-1')) x(p)")
def _(spark, sf):
    return N.simple_paths(_python_ways(spark, sf), 0, -1)


@query("P11_annotated", "SELECT 'part:'||p_partkey AS id, 'Route' AS notes FROM part WHERE p_partkey % 4 = 1")
def _(spark, sf):
    g = P.call_graph(spark, sf)
    notes = spark.createDataFrame([("n1", "annotation", "@app.Route('/x')"), ("n2", "annotation", "#[Other]")], "id string, node_type string, name string")
    marks = _part(spark, sf, src="concat('part:', p_partkey)", dst="if(p_partkey % 4 = 1, 'n1', 'n2')", edge_type="'annotatedwith'")
    return V.annotated(PropertyGraph(g.nodes.unionByName(as_nodes(notes)), as_edges(marks)), ["@Route"])


@query("F03_owner_member", "SELECT p_partkey AS id, p_type||'::'||p_partkey AS owner, replace(p_name, ' ', '_') AS member FROM part")
def _(spark, sf):
    q = F.concat("t", F.lit("::"), "k", F.lit("."), "n")
    return _part(spark, sf, k="p_partkey", t="p_type", n="replace(p_name, ' ', '_')").select(F.col("k").alias("id"), T.owner(q).alias("owner"), T.member(q).alias("member"))


@query("F04_plain_type", "SELECT p_partkey AS id, p_type AS plain FROM part")
def _(spark, sf):
    return _part(spark, sf, id="p_partkey", x="element_at(array(concat('&mut a::b::', p_type, '<T>'), concat('java.util.', p_type, '[]'), concat(p_type, '*')), int(p_partkey % 3 + 1))").select("id", T.plain_type(F.col("x")).alias("plain"))


@query("F05_import_prefix", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN p_type||'.'||replace(p_name, ' ', '_') END AS prefix FROM part")
def _(spark, sf):
    return _part(spark, sf, id="p_partkey", x="element_at(array(concat(p_type, '.', replace(p_name, ' ', '_'), '.x'), concat('\"', p_type, '/', replace(p_name, ' ', '_'), '\"'), '/abs/path'), int(p_partkey % 3 + 1))").select("id", T.import_prefix(F.col("x")).alias("prefix"))


@query("F06_package_label", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'org.'||p_type WHEN 1 THEN p_type ELSE 'a/'||p_type END AS label FROM part")
def _(spark, sf):
    return _part(spark, sf, id="p_partkey", x="element_at(array(concat('m/src/main/java/org/', p_type, '/A.java'), concat('crates/', p_type, '/x.rs'), concat('z/a/', p_type, '/f.c')), int(p_partkey % 3 + 1))").select("id", T.package_label(F.col("x")).alias("label"))


@query("F20_escaped", "SELECT p_partkey AS id, '&lt;'||p_type||' a=&quot;'||p_size||'&quot;&gt;&amp;' AS x FROM part")
def _(spark, sf):
    return _part(spark, sf, id="p_partkey", x="concat('<', p_type, ' a=\"', p_size, '\">&')").select("id", T.escaped(F.col("x")).alias("x"))


@query("U02_merged_repositories", f"WITH {NODES} SELECT 'a/'||id AS id, node_type FROM n WHERE node_type <> 'file' UNION ALL SELECT 'b/part:'||p_partkey, 'function' FROM part")
def _(spark, sf):
    g = P.entity_graph(spark, sf)
    g = PropertyGraph(g.nodes.filter("node_type <> 'file'"), g.edges)
    return g.union(P.call_graph(spark, sf), ("a", "b")).nodes.select("id", "node_type")


# --- files and exports

def _config(spark, sf, name, content):
    return _part(spark, sf, path=f"concat(p_partkey, '/{name}')", content=content).withColumn("content", F.col("content").cast("binary"))


_KV = "SELECT p_partkey||'/{0}' AS path, {1} AS key, {2} AS value FROM part"


def _keys(name, content, *pairs):
    @query(f"S_{name.rsplit('.', 1)[1]}_keys", " UNION ALL ".join(_KV.format(name, k, v) for k, v in pairs))
    def _(spark, sf):
        return FM.config_keys(_config(spark, sf, name, content)).select("path", "key", "value")


_keys("a.json", "concat('{\"a\": {\"b\": ', p_size, ', \"c\": [\"', p_type, '\"]}}')", ("'a.b'", "p_size||''"), ("'a.c[0]'", "p_type"))
_keys("a.toml", "concat('[a]\nb = ', p_size, '\n[a.d]\nc = \"', p_type, '\"\n')", ("'a.b'", "p_size||''"), ("'a.d.c'", "p_type"))
_keys("a.properties", "concat('# x\na.b = ', p_size, '\na.c:', p_type, '\n')", ("'a.b'", "p_size||''"), ("'a.c'", "p_type"))
_keys("a.yaml", "concat('a:\n  b: ', p_size, '\n  c: ', p_type, '\n')", ("'a.b'", "p_size||''"), ("'a.c'", "p_type"))


@query("S11_manifest", "SELECT p_partkey||'/package.json' AS path, 'npm' AS ecosystem, p_type AS package, '^1.'||p_size AS version FROM part")
def _(spark, sf):
    return FM.dependencies(_config(spark, sf, "package.json", "concat('{\"dependencies\": {\"', p_type, '\": \"^1.', p_size, '\"}}')"))


@query("S12_lockfile", "SELECT p_partkey||'/go.sum' AS path, 'github.com/x/'||p_type AS package, p_size||'.0.0' AS version FROM part")
def _(spark, sf):
    return FM.dependencies(_config(spark, sf, "go.sum", "concat('github.com/x/', p_type, ' v', p_size, '.0.0 h1:abc=\n')")).select("path", "package", F.regexp_replace("version", "^v", "").alias("version"))


@query("S14_bill_of_materials", "SELECT p_partkey||'' AS path, p_type AS package, '1.'||p_size AS version FROM part")
def _(spark, sf):
    return FM.bill_of_materials(_part(spark, sf, path="string(p_partkey)", json="concat('{\"', element_at(array('components', 'packages', 'Results'), int(p_partkey % 3 + 1)), '\": [', if(p_partkey % 3 = 2, '{\"Packages\": [', ''), '{\"', if(p_partkey % 3 = 2, 'Name', 'name'), '\": \"', p_type, '\", \"', element_at(array('version', 'versionInfo', 'Version'), int(p_partkey % 3 + 1)), '\": \"1.', p_size, '\"}', if(p_partkey % 3 = 2, ']}', ''), ']}')"))


@query("S15_advisories", "SELECT 'A-'||p_partkey AS id, 'npm' AS ecosystem, p_type AS package, '0' AS introduced, '1.'||p_size AS fixed FROM part")
def _(spark, sf):
    return FM.advisories(_part(spark, sf, json="concat('{\"id\": \"A-', p_partkey, '\", \"affected\": [{\"package\": {\"ecosystem\": \"npm\", \"name\": \"', p_type, '\"}, \"ranges\": [{\"type\": \"SEMVER\", \"events\": [{\"introduced\": \"0\"}, {\"fixed\": \"1.', p_size, '\"}]}]}]}')")).drop("last_affected")


@query("S18_hunks", "SELECT 'src/'||p_partkey||'.rs' AS path, p_size AS h_start, p_size + 3 AS h_end FROM part")
def _(spark, sf):
    lines = F.posexplode(F.expr("array(concat('--- a/src/', p_partkey, '.rs'), concat('+++ b/src/', p_partkey, '.rs'), concat('@@ -1,2 +', p_size, ',4 @@ fn x'), '+y')"))
    return FM.diff_hunks(P.table(spark, sf, "part").select(F.col("p_partkey").alias("diff"), lines.alias("n", "line")))


@query("S04_sniffed", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'matlab' ELSE 'objectivec' END AS kind FROM part")
def _(spark, sf):
    return _part(spark, sf, id="p_partkey", x="if(p_partkey % 2 = 0, concat('% ', p_name, '\nfunction y = f(x)\ny = x.^2;\nend\n'), concat('#import <x.h>\n@implementation ', p_type, '\n[self go];\n@end\n'))").select("id", FM.sniffed(F.col("x")).alias("kind"))


@query("S02_routes", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'source' WHEN 1 THEN 'config' WHEN 2 THEN 'lockfile' ELSE 'skip' END AS route FROM part")
def _(spark, sf):
    return _part(spark, sf, id="p_partkey", x="concat(p_type, '/', element_at(array('m.rs', 'c.yaml', 'Cargo.lock', 'p.png'), int(p_partkey % 4 + 1)))").select("id", FM.route(F.col("x")).alias("route"))


@query("F08_usages", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE 'X_'||p_size||',Y' END AS names FROM part")
def _(spark, sf):
    text = "element_at(array('a = os.environ[\"X_{n}\"]; os.getenv(\"Y\")', 'process.env.X_{n} + process.env[\"Y\"]', 'os.Getenv(\"X_{n}\"); os.LookupEnv(\"Y\")', 'env::var(\"X_{n}\"); env!(\"Y\")', 'Z'), int(p_partkey % 5 + 1))"
    rows = _part(spark, sf, id="p_partkey", lang="element_at(array('python', 'typescript', 'go', 'rust', 'cobol'), int(p_partkey % 5 + 1))", x=f"replace({text}, '{{n}}', string(p_size))")
    return rows.select("id", F.array_join(ST.usages(F.col("lang"), F.col("x")), ",").alias("names"))


@query("F09_signatures", "SELECT p_partkey AS id, 'f'||p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'a:i64,b:unknown' ELSE '' END AS params, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS returns, p_partkey % 2 = 0 AS same FROM part")
def _(spark, sf):
    rows = _part(spark, sf, id="p_partkey", x="if(p_partkey % 2 = 0, concat('pub fn f', p_partkey, '(a: i64, b) -> ', p_type, ' {'), concat('def f', p_partkey, '():'))", y="concat('def g(x, y) -> ', lower(p_type))")
    rows = rows.select("id", ST.signature(F.col("x")).alias("s"), ST.signature(F.col("y")).alias("t"))
    shown = F.array_join(F.transform("s.params", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",")
    return rows.select("id", "s.name", shown.alias("params"), "s.returns", ST.equivalent(F.col("s"), F.col("t")).alias("same"))


def _nation_graph(spark, sf):
    g = P.entity_graph(spark, sf)
    return PropertyGraph(g.nodes.filter("node_type = 'module'"), g.edges.filter("src LIKE 'region%'"))


@query("X03_graphml", """SELECT '<node id="nation:'||n_nationkey||'"><data key="name">'||n_name||'</data><data key="type">module</data></node>' AS line FROM nation UNION ALL SELECT '<edge source="region:'||n_regionkey||'" target="nation:'||n_nationkey||'"><data key="type">contains</data></edge>' FROM nation""")
def _(spark, sf):
    return EX.graphml(_nation_graph(spark, sf)).filter("part IN (1, 2) AND n LIKE '%nation%'").select("line")


@query("X04_dot", """SELECT '  "nation:'||n_nationkey||'" [label="'||n_name||'"];' AS line FROM nation UNION ALL SELECT '  "region:'||n_regionkey||'" -> "nation:'||n_nationkey||'" [label="contains"];' FROM nation""")
def _(spark, sf):
    return EX.dot(_nation_graph(spark, sf)).filter("part IN (1, 2) AND n LIKE '%nation%'").select("line")


@query("X05_mermaid", """SELECT '  n'||substr(sha256('nation:'||n_nationkey), 1, 12)||'["'||n_name||'"]' AS line FROM nation""")
def _(spark, sf):
    return EX.mermaid(_nation_graph(spark, sf)).filter("part = 1 AND n LIKE 'nation%'").select("line")


@query("X06_vault", """SELECT 'nation_'||n_nationkey||'.md' AS file, '---'||chr(10)||'type: module'||chr(10)||'---'||chr(10)||'# '||n_name||chr(10) AS content FROM nation""")
def _(spark, sf):
    return EX.vault(_nation_graph(spark, sf)).filter("file LIKE 'nation%'")


@query("X07_okf", """SELECT '{"id":"nation:'||n_nationkey||'","type":"module","title":"'||n_name||'"}' AS line FROM nation""")
def _(spark, sf):
    return EX.okf(_nation_graph(spark, sf)).filter("line LIKE '%nation:%' AND line NOT LIKE '%region%'")


@query("X08_sarif", """SELECT '{"ruleId":"'||p_type||'","level":"error","message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"'||p_brand||'"},"region":{"startLine":'||p_size||'}}}]},' AS line FROM part""")
def _(spark, sf):
    rows = _part(spark, sf, id="p_partkey", rule="p_type", level="'error'", message="'m'", path="p_brand", line="p_size")
    return EX.sarif(rows, "lattica").filter("part = 1").select("line")


@query("X08_openvex", """SELECT '{"vulnerability":{"name":"CVE-'||p_partkey||'"},"products":[{"@id":"pkg:npm/'||p_type||'"}],"status":"fixed"},' AS line FROM part""")
def _(spark, sf):
    return EX.openvex(_part(spark, sf, id="p_partkey", vulnerability="concat('CVE-', p_partkey)", product="concat('pkg:npm/', p_type)", status="'fixed'")).filter("part = 1").select("line")


# --- review

@query("G23_heading_projection", "SELECT p_partkey AS src, p_partkey + 2 AS dst FROM part WHERE p_partkey % 4 = 0 AND p_partkey + 2 IN (SELECT p_partkey FROM part) UNION SELECT p_partkey, p_partkey + 1 FROM part")
def _(spark, sf):
    nodes = _part(spark, sf, id="p_partkey", node_type="'module'", properties="map('kind', if(p_partkey % 2 = 0, 'heading', 'block'))")
    step = _part(spark, sf, src="p_partkey", dst="p_partkey + if(p_partkey % 4 = 0, 2, 4)", edge_type="'contains'").filter("src % 4 <> 2")
    return RP.heading_projection(nodes, step.union(_part(spark, sf, src="p_partkey", dst="p_partkey + 1", edge_type="'calls'")))


@query("D05_call_spine", f"""WITH {SPARSE}, s AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 50 = 7), a1 AS (SELECT DISTINCT e.s AS id FROM e JOIN s ON e.t = s.id WHERE e.s NOT IN (FROM s)),
  a2 AS (SELECT DISTINCT e.s AS id FROM e JOIN a1 ON e.t = a1.id WHERE e.s NOT IN (FROM s) AND e.s NOT IN (FROM a1)), b1 AS (SELECT DISTINCT e.t AS id FROM e JOIN s ON e.s = s.id WHERE e.t NOT IN (FROM s))
  SELECT id, 'seed' AS side, CAST(0 AS BIGINT) AS hops FROM s UNION ALL SELECT id, 'caller', 1 FROM a1 UNION ALL SELECT id, 'caller', 2 FROM a2 UNION ALL SELECT id, 'callee', 1 FROM b1 ORDER BY hops, side, id LIMIT 200""")
def _(spark, sf):
    return RP.call_spine(_calls(spark, sf), _part(spark, sf, id="p_partkey").filter("id % 50 = 7"))


@query("D05_spine_delta", "SELECT p_partkey AS id, 'caller' AS side, CASE WHEN p_size >= 40 THEN 'added' WHEN p_size < 10 THEN 'removed' ELSE 'kept' END AS kind FROM part")
def _(spark, sf):
    rows = _part(spark, sf, id="p_partkey", side="'caller'", size="p_size")
    return RP.spine_delta(rows.filter("size < 40"), rows.filter("size >= 10"))


@query("D06_symbol_filter", f"WITH {NODES} SELECT id FROM n WHERE name = (SELECT min(p_name) FROM part)")
def _(spark, sf):
    first = P.table(spark, sf, "part").agg(F.min("p_name")).first()[0]
    return RP.symbol_filter(P.entity_graph(spark, sf).nodes, first)


@query("D11_introduced", """WITH s AS (SELECT o_custkey AS key, o_orderkey AS seq, o_orderstatus = 'O' AS bad FROM orders), g AS (SELECT key, max(seq) FILTER (NOT bad) AS good, arg_max(bad, seq) AS now FROM s GROUP BY 1)
  SELECT key, min(seq) AS seq FROM s JOIN g USING (key) WHERE now AND bad AND (good IS NULL OR seq > good) GROUP BY 1""")
def _(spark, sf):
    return RP.introduced_by(P.table(spark, sf, "orders").selectExpr("o_custkey AS key", "o_orderkey AS seq", "o_orderstatus = 'O' AS bad"))


@query("D12_scoped_scores", f"WITH {SPARSE} SELECT t AS id, count(*)::DOUBLE AS score FROM e JOIN part ON p_partkey = t WHERE p_brand IN ('Brand#2', 'Brand#17') GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    scores = _calls(spark, sf).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return RP.scoped_scores(scores, _part(spark, sf, id="p_partkey", b="p_brand").filter("b IN ('Brand#2', 'Brand#17')"), 1.0)


@query("D18_weaknesses", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-78' END AS cwe FROM part")
def _(spark, sf):
    return RP.advised(_part(spark, sf, id="p_partkey", sink="element_at(array('sql_query', 'shell_command', 'log'), int(p_partkey % 3 + 1))")).select("id", "cwe")


@query("D19_gates", "SELECT false AS passed, 'prices,sizes' AS failed")
def _(spark, sf):
    checks = P.table(spark, sf, "part").agg(F.max("p_size").cast("double").alias("sizes"), F.max("p_retailprice").cast("double").alias("prices"), F.lit(0.0).alias("cycles"))
    rows = checks.select(F.explode(F.create_map(*[x for c in checks.columns for x in (F.lit(c), F.col(c))])).alias("check", "value"))
    return RP.gates(rows.withColumn("most", F.lit(1.0)))


@query("G07_dispatched")
def _(spark, sf):
    found, mode = A.dispatched(_calls(spark, sf))
    return found.withColumn("mode", F.lit(mode))


@query("J25_stub_paths", f"WITH {SPARSE} SELECT a.s AS source, b.t AS sink, min(a.s||'>'||a.t||'>'||b.t) AS path FROM e a JOIN e b ON a.t = b.s WHERE a.s % 20 = 3 AND b.t % 20 = 9 AND (a.s, b.t) NOT IN (SELECT (s, t) FROM e) AND a.s <> b.t AND a.t % 20 <> 9 GROUP BY 1, 2")
def _(spark, sf):
    ids = _part(spark, sf, id="p_partkey")
    return RP.shortest_paths(_calls(spark, sf), ids.filter("id % 20 = 3"), ids.filter("id % 20 = 9"), 2).filter("hops = 2").drop("hops")
