"""Graph operators on the star graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import make_id
from ..operators import catalog, delete, graph, shape
from ..plans.guard import is_read_only, lexical_violation
from . import star
from .star import key, sql_edges, sql_id, sql_nodes, t

UP = ["nation", "customer", "orders"]
ALL = ["nation", "customer", "orders", "lineitem"]


def _seed(spark, label, *keys):
    columns = [f"k{i}" for i in range(len(keys))]
    return spark.createDataFrame([keys], columns).select(key(label, columns).alias("id"))


def _seed_sql(label, *keys):
    return sql_id(label, [str(k) for k in keys])


def _reach_sql(edges: str, seeds: str, depth: int, at: str = "src", to: str = "dst", least: int = 1) -> str:
    return f"""
WITH RECURSIVE e AS ({edges}), r(id, depth) AS (
  SELECT id, 0 FROM ({seeds}) UNION SELECT e.{to}, r.depth + 1 FROM r JOIN e ON e.{at} = r.id WHERE r.depth < {depth}
) SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) >= {least}"""


def _first_line(spark, d):
    """The line of least order and number: the tables' keys differ from one size to another."""
    first = t(spark, d, "lineitem").orderBy("l_orderkey", "l_linenumber").limit(1)
    return first.select(key("lineitem", ["l_orderkey", "l_linenumber"]).alias("id"))


_FIRST_LINE = f"SELECT {sql_id('lineitem', ['l_orderkey', 'l_linenumber'])} AS id FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1)"


def g1_upstream(spark, d):
    return graph.reach(star.edges(spark, d, ALL, ["CONTAINS"]), _first_line(spark, d), 6, "in", ["CONTAINS"])


def g2_downstream(spark, d):
    return graph.reach(star.edges(spark, d, ALL, ["CONTAINS"]), _seed(spark, "region", 1), 4, "out", ["CONTAINS"])


def g3_khop(spark, d):
    return graph.reach(star.edges(spark, d, ALL), _seed(spark, "nation", 3), 2, "both")


def g1_trails(spark, d):
    seeds = _seed(spark, "customer", 1)
    found = graph.trails(star.edges(spark, d, UP), seeds, 3, "both", 500)
    return found.select("start", "depth", "node", F.concat_ws(">", "path").alias("path"))


_TRAILS = f"""
WITH RECURSIVE e AS ({sql_edges(UP)}), s AS (SELECT src AS at, dst AS next, src || '|' || rel || '|' || dst AS eid FROM e UNION ALL SELECT dst, src, src || '|' || rel || '|' || dst FROM e),
p(start, depth, node, path, used) AS (
  SELECT {_seed_sql('customer', 1)}, 0, {_seed_sql('customer', 1)}, {_seed_sql('customer', 1)}, CAST([] AS VARCHAR[])
  UNION ALL SELECT p.start, p.depth + 1, s.next, p.path || '>' || s.next, list_append(p.used, s.eid) FROM p JOIN s ON s.at = p.node WHERE p.depth < 3 AND NOT list_contains(p.used, s.eid)
) SELECT start, depth, node, path FROM p WHERE depth > 0 ORDER BY depth, path LIMIT 500"""


def g4_list_nodes(spark, d):
    return catalog.list_nodes(star.nodes(spark, d), "customer", "CUSTOMER#00000001", 20, 3).select("id", "label", "name")


def g5_schema(spark, d):
    return catalog.schema_summary(star.nodes(spark, d), star.edges(spark, d))


def g6_adhoc(spark, d):
    views = {"nodes": star.nodes(spark, d, ["region", "nation"]), "edges": star.edges(spark, d, ["nation"])}
    return catalog.adhoc(spark, "SELECT n.name, count(*) AS n FROM nodes n JOIN edges e ON e.src = n.id WHERE e.rel = :rel GROUP BY n.name", views, rel="CONTAINS")


_GUARDED = [(1, "MATCH (n) RETURN n"), (2, "CREATE (n)"), (3, "MATCH (n) /* delete */ RETURN n"), (4, "RETURN 'set this'"), (5, "MATCH (n) SET n.x = 1"), (6, "  "), (7, "RETURN n // drop"), (8, "match (n) detach delete n"), (9, "RETURN created, setting")]


def g7_guard(spark, d):
    rows = spark.createDataFrame(_GUARDED, "id int, query string")
    return rows.select("id", lexical_violation(F.col("query")).alias("violation"))


#: Statements and whether the guard lets them run.
_STATEMENTS = [
    ("SELECT 1 -- drop", True), ("WITH c AS (SELECT id FROM nodes) SELECT count(*) FROM c WHERE id IN (SELECT src FROM edges)", True), ("SELECT a FROM t UNION SELECT b FROM u ORDER BY 1 LIMIT 3", True),
    ("VALUES (1), (2)", True), ("SELECT x FROM t LATERAL VIEW explode(xs) v AS x", True), ("SELECT k, sum(v) FROM t GROUP BY k HAVING sum(v) > (SELECT avg(v) FROM t)", True),
    ("INSERT INTO t SELECT 1", False), ("EXECUTE IMMEDIATE 'DROP TABLE t'", False), ("COMMENT ON TABLE t IS 'x'", False), ("ALTER TABLE t UNSET TBLPROPERTIES ('a')", False), ("CLEAR CACHE", False),
    ("SELECT reflect('java.lang.System', 'exit', 0)", False), ("SELECT * FROM (SELECT java_method('a', 'b') AS x)", False), ("SELECT 1 WHERE EXISTS (SELECT reflect('a', 'b'))", False),
    ("WITH c AS (SELECT reflect('a', 'b') AS x) SELECT * FROM c", False), ("CREATE TABLE t AS SELECT 1", False), ("MERGE INTO t USING u ON t.a = u.a WHEN MATCHED THEN DELETE", False),
    ("SET x = 1", False), ("USE other", False), ("REFRESH TABLE t", False), ("CACHE TABLE t", False), ("FROM u INSERT INTO t SELECT 1", False), ("DECLARE VARIABLE v = 1", False), ("", False), ("nonsense", False),
]


def g7_read_only(spark, d):
    """The guard that adhoc() asks, statement by statement."""
    rows = [(i, s, is_read_only(spark, s)) for i, (s, _) in enumerate(_STATEMENTS)]
    return spark.createDataFrame(rows, "id int, statement string, allowed boolean").select("id", "allowed")


def g9_optional_match(spark, d):
    c = t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(key("customer", ["c_custkey"]).alias("customer"))
    o = t(spark, d, "orders")
    e = star.edges(spark, d, ["orders"]).withColumn("rel", F.lit("PLACED"))
    late = o.filter("o_orderpriority = '1-URGENT'").select(key("customer", ["o_custkey"]).alias("src"), key("orders", ["o_orderkey"]).alias("dst"), F.lit("RUSHED").alias("rel"))
    return catalog.optional_hops(c, e.unionByName(late), [("customer", "PLACED", "order", True), ("customer", "RUSHED", "rushed", True)])


_OPT = f"""
WITH c AS (SELECT {sql_id('customer', ['c_custkey'])} AS customer FROM customer WHERE c_mktsegment = 'BUILDING'),
o AS (SELECT {sql_id('customer', ['o_custkey'])} AS customer, {sql_id('orders', ['o_orderkey'])} AS "order", o_orderpriority AS p FROM orders)
SELECT c.customer, o."order", r."order" AS rushed FROM c LEFT JOIN o USING (customer) LEFT JOIN (SELECT * FROM o WHERE p = '1-URGENT') r USING (customer)"""


def g10_write_targets(spark, d):
    c = _seed(spark, "nation", 5).withColumnRenamed("id", "nation")
    e = star.edges(spark, d, ["customer", "orders"]).withColumn("rel", F.lit("CONTAINS"))
    return catalog.optional_hops(c, e, [("nation", "CONTAINS", "customer", False), ("customer", "CONTAINS", "order", True)])


def g12_chain_0_6(spark, d):
    closed = graph.reach(star.edges(spark, d, ALL, ["CONTAINS"]), _seed(spark, "nation", 7), 6, "out", include_seeds=True)
    uses = t(spark, d, "lineitem").select(key("lineitem", ["l_orderkey", "l_linenumber"]).alias("id"), "l_partkey")
    part = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return closed.join(uses, "id").join(part, "l_partkey").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))


def g8_presets(spark, d):
    return spark.createDataFrame([(p,) for p in catalog.list_presets()], "preset string")


def _relabelled(spark, d, rels):
    """Edges of the star schema under relations of the estate: {(table, source label): relation}, turned where marked."""
    out = None
    for table, rel, turned in rels:
        part = star.edges(spark, d, [table], ["CONTAINS"]).select("src", "dst").withColumn("rel", F.lit(rel))
        part = part.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel") if turned else part
        out = part if out is None else out.unionByName(part)
    return out


def g12_chart_preset(spark, d):
    """The preset, with regions as charts, nations as their fields, customers as sources and orders as tables."""
    nodes = star.nodes(spark, d, ["region"]).withColumn("label", F.lit("QlikChart"))
    edges = _relabelled(spark, d, [("nation", "USES_FIELD", False), ("customer", "DERIVES_FROM", False), ("orders", "HAS_COLUMN", True)])
    return catalog.run_preset("qlikview-chart-lineage", nodes, edges)


def g13_cross_preset(spark, d):
    """The preset, with regions as dashboards and lines as dataframes."""
    edges = _relabelled(spark, d, [("nation", "DISPLAYS_WORKSHEET", False), ("customer", "USES_FIELD", False), ("orders", "HAS_COLUMN", True), ("lineitem", "WRITES_TABLE", True)])
    scripts = t(spark, d, "lineitem").select(key("supplier", ["l_suppkey"]).alias("src"), key("lineitem", ["l_orderkey", "l_linenumber"]).alias("dst"), F.lit("CONTAINS_DATAFRAME").alias("rel"))
    found = catalog.run_preset("cross-tool", star.nodes(spark, d, ["region"]), edges.unionByName(scripts))
    return found.groupBy("dashboard", "script").agg(F.count(F.lit(1)).alias("n"))


def g14_connection_frames(spark, d):
    """Regions as connections: what derives from what they provide, at any depth."""
    region = F.lit(make_id("region", 1))
    edges = _relabelled(spark, d, [("nation", "PROVIDES_DATAFRAME", False), ("customer", "DERIVES_FROM_DATAFRAME", False), ("orders", "DERIVES_FROM_DATAFRAME", False), ("lineitem", "DERIVES_FROM_DATAFRAME", False)])
    return catalog.connection_dataframes(edges, region)


def g13_cross_tool(spark, d):
    l, o, c, n, r, s = (t(spark, d, x) for x in ("lineitem", "orders", "customer", "nation", "region", "supplier"))
    j = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).join(c, F.col("n_nationkey") == F.col("c_nationkey"))
    j = j.join(o, F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("o_orderkey") == F.col("l_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("r_name", "s_name").agg(F.count(F.lit(1)).alias("n"))


def g14_closure_each(spark, d):
    seeds = t(spark, d, "region").select(key("region", ["r_regionkey"]).alias("id"))
    return graph.reach_from_each(star.edges(spark, d, UP, ["CONTAINS"]), seeds, 6).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"))


def g15_both_exist(spark, d):
    parts = t(spark, d, "part").select(key("part", ["p_partkey"]).alias("id"), "p_name")
    l = t(spark, d, "lineitem")
    p = key("part", ["l_partkey"])
    e = l.filter("l_returnflag = 'R'").select(p.alias("src"), F.lit("x").alias("dst"), F.lit("RETURNED").alias("rel")).unionByName(l.filter("l_quantity >= 49").select(F.lit("x").alias("src"), p.alias("dst"), F.lit("BULK").alias("rel")))
    return catalog.both_exist(parts, e, "RETURNED", "BULK")


def g16_unresolved(spark, d):
    n = t(spark, d, "supplier").select(key("supplier", ["s_suppkey"]).alias("id"), F.lit("Connection").alias("label"), "s_name", F.create_map(F.lit("resolved"), (F.col("s_acctbal") > 0).cast("string")).alias("props"))
    return catalog.unresolved(n).select("id", "s_name")


def g17_hits_connection(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    ir = o.groupBy(F.col("o_custkey").alias("name")).agg(F.collect_set("l_suppkey").alias("reads"))
    return catalog.hits_connection(ir, 3)


def g18_dedupe_payload(spark, d):
    e = star.edges(spark, d, UP)
    paths = graph.trails(e, _seed(spark, "customer", 2), 2, "both", None)
    n, hit = catalog.payload(paths, star.nodes(spark, d, ["region", "nation", "customer", "orders"]), e)
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b")).unionByName(hit.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


_PAY = f"""
WITH e AS ({sql_edges(UP)}), n AS ({sql_nodes(['region', 'nation', 'customer', 'orders'])}), s AS (SELECT src AS here, dst AS next, src, dst FROM e UNION ALL SELECT dst, src, src, dst FROM e),
a AS (SELECT src, dst, next FROM s WHERE here = {_seed_sql('customer', 2)}),
b AS (SELECT s.src, s.dst, s.next FROM a JOIN s ON s.here = a.next AND NOT (s.src = a.src AND s.dst = a.dst)),
h AS (SELECT src, dst FROM a UNION SELECT src, dst FROM b), i AS (SELECT src AS id FROM h UNION SELECT dst FROM h)
SELECT 'node' AS kind, n.id AS a, n.label AS b FROM n JOIN i USING (id) UNION ALL SELECT 'edge', src, dst FROM h"""


def g19_source_system(spark, d):
    labels = F.split(F.element_at(F.array(F.lit("TableauSheet,Table"), F.lit("QlikTable"), F.lit("Table"), F.lit("Thing"), F.lit("SparkScript,Script")), (F.col("n_nationkey") % 5 + 1).cast("int")), ",")
    props = F.when(F.col("n_nationkey") == 0, F.create_map(F.lit("source_system"), F.lit("manual"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    n = t(spark, d, "nation").select("n_name", labels.alias("labels"), props.alias("props"))
    return n.select("n_name", catalog.source_system(F.lit(None), F.col("labels"), F.col("props")).alias("source_system"), catalog.primary_label(F.col("labels")).alias("primary_label"))


_SYS = """
SELECT n_name, CASE WHEN n_nationkey = 0 THEN 'manual' ELSE ['tableau', 'qlikview', 'shared', 'unknown', 'spark'][n_nationkey % 5 + 1] END AS source_system,
       ['TableauSheet', 'QlikTable', 'Table', 'Thing', 'SparkScript'][n_nationkey % 5 + 1] AS primary_label FROM nation"""


def g21_catalog_union(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    named = o.filter("o_totalprice > 200000").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("name"))
    orphans = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    return catalog.file_catalog(named, orphans)


def g22_counts(spark, d):
    return star.nodes(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _graph(spark, d):
    return star.nodes(spark, d, ["region", "nation", "customer", "orders"]), star.edges(spark, d, UP)


def g23_exclusive_delete(spark, d):
    n, e = _graph(spark, d)
    left, kept, _ = delete.delete_exclusive(n, e, _seed(spark, "nation", 4), ["CONTAINS"], ["region"])
    return left.groupBy("label").agg(F.count(F.lit(1)).alias("n")).unionByName(kept.groupBy("rel").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("rel", "label"))


_DEL = f"""
WITH RECURSIVE n AS ({sql_nodes(['region', 'nation', 'customer', 'orders'])}), e AS ({sql_edges(UP)}),
r(root, id) AS (SELECT id, id FROM n WHERE label = 'nation' AND key {{keys}} UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.id)"""
_DEL23 = _DEL.format(keys="= '4'") + """
SELECT label, count(*) AS n FROM n WHERE id NOT IN (SELECT id FROM r) GROUP BY 1
UNION ALL SELECT rel, count(*) FROM e WHERE src NOT IN (SELECT id FROM r) AND dst NOT IN (SELECT id FROM r) GROUP BY 1"""


def g24_bulk_delete(spark, d):
    n, e = _graph(spark, d)
    roots = n.filter("label = 'nation' AND props['key'] IN ('1', '2', '3')").select("id")
    return delete.delete_exclusive(n, e, roots, ["CONTAINS"], ["region"])[2]


def g25_only_owned(spark, d):
    l = t(spark, d, "lineitem")
    e = l.select(key("supplier", ["l_suppkey"]).alias("src"), key("part", ["l_partkey"]).alias("dst"), F.lit("HAS_COLUMN").alias("rel"))
    owners = t(spark, d, "supplier").filter("s_acctbal > 0").select(key("supplier", ["s_suppkey"]).alias("id"))
    return delete.only_owned(e, owners, ["HAS_COLUMN"])


_OWN = f"""
WITH x AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT {sql_id('part', ['l_partkey'])} AS id FROM x JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey HAVING bool_and(s_acctbal > 0)"""


def g28_stitch(spark, d):
    """URLs as invoked files: the last path token's base name and extension, joined to labels by them."""
    path = F.regexp_extract("url", r"^[^?#]*", 0)
    last = F.element_at(F.split(path, "/"), -1)
    p = t(spark, d, "pages").select("page_id", F.lower(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", "")).alias("base"), F.regexp_extract(last, r"\.([A-Za-z0-9]+)$", 1).alias("ext"))
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("base"), "source")
    label = F.when(F.col("ext") == "html", "Workbook").when(F.col("ext") == "", "Script").otherwise("File")
    return p.join(docs, "base").select("page_id", "base", label.alias("label"), "source").dropDuplicates(["page_id", "base"])


_STITCH = r"""
WITH p AS (SELECT page_id, string_split(regexp_extract(url, '^[^?#]*'), '/')[-1] AS last FROM pages),
q AS (SELECT page_id, lower(regexp_replace(last, '\.[A-Za-z0-9]+$', '')) AS base, regexp_extract(last, '\.([A-Za-z0-9]+)$', 1) AS ext FROM p)
SELECT page_id, base, CASE WHEN ext = 'html' THEN 'Workbook' WHEN ext = '' THEN 'Script' ELSE 'File' END AS label, source FROM q JOIN documents d ON d.doc_id::VARCHAR = q.base"""


def g29_combined(spark, d):
    seeds = _seed(spark, "customer", 3).unionByName(_seed(spark, "nation", 2))
    return graph.combined(star.edges(spark, d, UP), seeds, 3)


_COMB = f"""
WITH RECURSIVE e AS ({sql_edges(UP)}), s AS (SELECT {_seed_sql('customer', 3)} AS id UNION SELECT {_seed_sql('nation', 2)}),
u(id, depth) AS (SELECT id, 0 FROM s UNION SELECT e.src, depth + 1 FROM u JOIN e ON e.dst = u.id WHERE depth < 3),
w(id, depth) AS (SELECT id, 0 FROM s UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.id WHERE depth < 3)
SELECT id, min(depth) AS depth FROM (SELECT * FROM u UNION ALL SELECT * FROM w) GROUP BY id"""


def g30_fold(spark, d):
    n = star.nodes(spark, d, ["nation", "customer", "orders"])
    out, left = shape.fold_attributes(n, star.edges(spark, d, ["customer", "orders"]), ["CONTAINS"], "orders")
    return out.select("id", "label", "col_count", F.concat_ws(",", "columns").alias("columns")).unionByName(left.select(F.col("src").alias("id"), F.lit("edge").alias("label"), F.lit(0).cast("long").alias("col_count"), F.col("dst").alias("columns")))


_FOLD = f"""
WITH n AS ({sql_nodes(['nation', 'customer', 'orders'])}), e AS ({sql_edges(['customer', 'orders'])}),
f AS (SELECT e.src AS id, count(DISTINCT e.dst) AS c, string_agg(DISTINCT n.name, ',' ORDER BY n.name) AS s FROM e JOIN n ON n.id = e.dst WHERE n.label = 'orders' GROUP BY 1)
SELECT n.id, n.label, coalesce(f.c, 0) AS col_count, coalesce(f.s, '') AS columns FROM n LEFT JOIN f USING (id) WHERE n.label <> 'orders'
UNION ALL SELECT src, 'edge', 0, dst FROM e WHERE src IN (SELECT id FROM n WHERE label <> 'orders') AND dst IN (SELECT id FROM n WHERE label <> 'orders')"""


def g31_fanout_cap(spark, d):
    e = t(spark, d, "customer").select(key("nation", ["c_nationkey"]).alias("src"), key("customer", ["c_custkey"]).alias("dst"), F.lit("CONTAINS").alias("rel"))
    labels = t(spark, d, "customer").select(key("customer", ["c_custkey"]).alias("id"), F.col("c_mktsegment").alias("label"))
    summaries, moved = shape.cap_fanout(e, labels)
    return summaries.select("id", F.lit("").alias("dst"), "n_hidden").unionByName(moved.select(F.col("src").alias("id"), "dst", F.lit(0).cast("long").alias("n_hidden")))


_FAN = f"""
WITH c AS (SELECT {sql_id('nation', ['c_nationkey'])} AS src, {sql_id('customer', ['c_custkey'])} AS dst, c_mktsegment AS g FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY src, g ORDER BY dst) AS k, count(*) OVER (PARTITION BY src, g) AS n FROM c),
x AS (SELECT src, CASE WHEN n > 12 AND k > 11 THEN 'summary::' || src || '::' || g END AS s, dst FROM r)
SELECT s AS id, '' AS dst, count(*) AS n_hidden FROM x WHERE s IS NOT NULL GROUP BY 1
UNION ALL SELECT DISTINCT src, coalesce(s, dst), 0 FROM x"""


def g32_line_index(spark, d):
    l = t(spark, d, "lineitem")
    rows = l.select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_partkey").cast("string").alias("id"), F.col("l_linenumber").alias("line_start"), F.when(F.col("l_quantity") > 10, F.col("l_linenumber") + (F.col("l_quantity") % 4).cast("int")).alias("line_end"))
    return shape.line_index(rows).select("path", "line", F.concat_ws(",", "ids").alias("ids"))


_LINES = """
WITH l AS (SELECT l_orderkey::VARCHAR AS path, l_partkey::VARCHAR AS id, l_linenumber AS a, CASE WHEN l_quantity > 10 THEN l_linenumber + (l_quantity % 4)::INTEGER ELSE l_linenumber END AS b FROM lineitem),
x AS (SELECT path, id, unnest(range(a, b + 1))::INTEGER AS line FROM l)
SELECT path, line, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM x GROUP BY 1, 2"""


def _page_files(spark, d):
    return t(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", r"^[^?#]*", 0).alias("path"), F.col("html").alias("text"))


def g33_source_view(spark, d):
    return catalog.source_view(_page_files(spark, d), {"html": "html", "py": "python", "sql": "sql"}, 2000)


def g33_source_view_full(spark, d):
    return catalog.source_view(_page_files(spark, d), {"html": "html", "py": "python", "sql": "sql"})


_VIEW = r"""
WITH p AS (SELECT page_id AS id, regexp_extract(url, '^[^?#]*') AS path, coalesce(html, '') AS text FROM pages)
SELECT id, path, CASE lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) WHEN 'html' THEN 'html' WHEN 'py' THEN 'python' WHEN 'sql' THEN 'sql' ELSE 'text' END AS language,
       len(string_split(text, chr(10)))::INTEGER AS n_lines, length(text) > 2000 AS truncated, substr(text, 1, 2000) AS text FROM p"""


def g34_plain_values(spark, d):
    return shape.plain_values(t(spark, d, "orders").select("o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day")))


def c10_anchor(spark, d):
    n, e = _graph(spark, d)
    return graph.anchors(e, n, F.col("name") == "F")


_ANCHOR = f"""
WITH n AS ({sql_nodes(['region', 'nation', 'customer', 'orders'])}), e AS ({sql_edges(UP)}), f AS (SELECT src AS id, count(*) AS c FROM e GROUP BY 1), x AS (SELECT DISTINCT dst AS id FROM e)
SELECT n.id, coalesce(f.c, 0) AS fan_out, x.id IS NULL AS is_root, n.name = 'F' OR x.id IS NULL OR coalesce(f.c, 0) >= 2 AS is_anchor FROM n LEFT JOIN f USING (id) LEFT JOIN x USING (id)"""


def _modular(spark, d):
    p = t(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(k.cast("string").alias("src"), F.when(k % 7 == 0, (k % 49 + 7)).otherwise(k + 1).cast("string").alias("dst"), F.lit("D").alias("rel"))


def c17_cycles(spark, d):
    return graph.on_cycles(_modular(spark, d), 8)


_CYC = """
WITH RECURSIVE e AS (SELECT p_partkey::VARCHAR AS src, (CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 49 + 7 ELSE p_partkey + 1 END)::VARCHAR AS dst FROM part),
r(root, id, k) AS (SELECT src, dst, 1 FROM e UNION SELECT r.root, e.dst, r.k + 1 FROM r JOIN e ON e.src = r.id WHERE r.k < 9)
SELECT DISTINCT root AS id FROM r WHERE root = id"""


def g_flow_modes(spark, d):
    """USES edges point against the flow of data: the canonical mode turns them, the parity mode does not."""
    first = _first_line(spark, d)
    e = star.edges(spark, d, ["lineitem"]).join(first.withColumnRenamed("id", "src"), "src", "left_semi")
    turned = graph.flow_edges(star.edges(spark, d, ["lineitem"]), {"USES": -1}).join(first.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.withColumn("mode", F.lit("parity")).unionByName(turned.withColumn("mode", F.lit("canonical"))).select("mode", "src", "dst", "rel")


_FLOW = f"""
WITH e AS ({sql_edges(['lineitem'])}), t AS (SELECT CASE WHEN rel = 'USES' THEN dst ELSE src END AS src, CASE WHEN rel = 'USES' THEN src ELSE dst END AS dst, rel FROM e)
SELECT 'parity' AS mode, src, dst, rel FROM e WHERE src IN ({_FIRST_LINE})
UNION ALL SELECT 'canonical', src, dst, rel FROM t WHERE dst IN ({_FIRST_LINE})"""

_BOTH = f"SELECT src, dst FROM ({sql_edges(ALL)}) UNION ALL SELECT dst, src FROM ({sql_edges(ALL)})"

QUERIES = {
    "g1_upstream": (g1_upstream, _reach_sql(sql_edges(ALL, ["CONTAINS"]), _FIRST_LINE, 6, "dst", "src")),
    "g1_trails": (g1_trails, _TRAILS),
    "g2_downstream": (g2_downstream, _reach_sql(sql_edges(ALL, ["CONTAINS"]), f"SELECT {_seed_sql('region', 1)} AS id", 4)),
    "g3_khop": (g3_khop, _reach_sql(_BOTH, f"SELECT {_seed_sql('nation', 3)} AS id", 2)),
    "g4_list_nodes": (g4_list_nodes, f"SELECT id, label, name FROM ({sql_nodes(['customer'])}) WHERE contains(lower(name), 'customer#00000001') ORDER BY id LIMIT 20 OFFSET 3"),
    "g5_schema": (g5_schema, f"WITH n AS ({sql_nodes()}), e AS ({sql_edges()}) SELECT 'label' AS kind, label AS name, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'rel', rel, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'property', 'key', count(*) FROM n"),
    "g6_adhoc": (g6_adhoc, f"WITH n AS ({sql_nodes(['region', 'nation'])}), e AS ({sql_edges(['nation'])}) SELECT n.name, count(*) AS n FROM n JOIN e ON e.src = n.id GROUP BY 1"),
    "g7_guard": (g7_guard, "SELECT * FROM (VALUES (1, NULL), (2, 'create'), (3, NULL), (4, NULL), (5, 'set'), (6, 'empty'), (7, NULL), (8, 'detach'), (9, NULL)) v(id, violation)"),
    "g7_read_only": (g7_read_only, "SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(ok).lower()})" for i, (_, ok) in enumerate(_STATEMENTS)) + ") v(id, allowed)"),
    "g8_presets": (g8_presets, f"SELECT * FROM (VALUES {', '.join(f"('{p}')" for p in ('combined', 'cross-tool', 'lineage-downstream', 'lineage-upstream', 'qlikview-chart-lineage', 'spark-connections', 'spark-write-targets', 'tableau-physical-tables'))}) v(preset)"),
    "g9_optional_match": (g9_optional_match, _OPT),
    "g10_write_targets": (g10_write_targets, f"SELECT {_seed_sql('nation', 5)} AS nation, {sql_id('customer', ['c_custkey'])} AS customer, CASE WHEN o_orderkey IS NOT NULL THEN {sql_id('orders', ['o_orderkey'])} END AS \"order\" FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 5"),
    "g12_chain_0_6": (g12_chain_0_6, "SELECT p_brand, count(*) AS n, 3 AS depth FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_nationkey = 7 GROUP BY 1"),
    "g12_chart_preset": (
        g12_chart_preset,
        f"""WITH u AS (SELECT {sql_id('region', ['n_regionkey'])} AS chart, {sql_id('nation', ['n_nationkey'])} AS attribute, n_nationkey FROM nation),
s AS (SELECT chart, attribute, {sql_id('customer', ['c_custkey'])} AS source, c_custkey FROM u JOIN customer ON c_nationkey = n_nationkey)
SELECT chart, attribute, source, {sql_id('orders', ['o_orderkey'])} AS "table" FROM s JOIN orders ON o_custkey = c_custkey ORDER BY ALL LIMIT 200""",
    ),
    "g13_cross_preset": (
        g13_cross_preset,
        f"""SELECT {sql_id('region', ['n_regionkey'])} AS dashboard, {sql_id('supplier', ['l_suppkey'])} AS script, count(*) AS n
FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    ),
    "g14_connection_frames": (
        g14_connection_frames,
        f"""WITH n AS (SELECT * FROM nation WHERE n_regionkey = 1), c AS (SELECT * FROM customer JOIN n ON c_nationkey = n_nationkey), o AS (SELECT * FROM orders JOIN c ON o_custkey = c_custkey)
SELECT {sql_id('nation', ['n_nationkey'])} AS id FROM n UNION SELECT {sql_id('customer', ['c_custkey'])} FROM c UNION SELECT {sql_id('orders', ['o_orderkey'])} FROM o
UNION SELECT {sql_id('lineitem', ['l_orderkey', 'l_linenumber'])} FROM lineitem JOIN o ON l_orderkey = o_orderkey""",
    ),
    "g13_cross_tool": (g13_cross_tool, "SELECT r_name, s_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"),
    "g14_closure_each": (g14_closure_each, f"WITH RECURSIVE e AS ({sql_edges(UP)}), r(root, id, depth) AS (SELECT {sql_id('region', ['r_regionkey'])}, {sql_id('region', ['r_regionkey'])}, 0 FROM region UNION SELECT r.root, e.dst, depth + 1 FROM r JOIN e ON e.src = r.id) SELECT root, depth, count(*) AS n FROM r GROUP BY 1, 2"),
    "g15_both_exist": (g15_both_exist, f"SELECT {sql_id('part', ['p_partkey'])} AS id, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"),
    "g16_unresolved": (g16_unresolved, f"SELECT {sql_id('supplier', ['s_suppkey'])} AS id, s_name FROM supplier WHERE NOT s_acctbal > 0"),
    "g17_hits_connection": (g17_hits_connection, "SELECT DISTINCT o_custkey AS name FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey = 3"),
    "g18_dedupe_payload": (g18_dedupe_payload, _PAY),
    "g19_source_system": (g19_source_system, _SYS),
    "g21_catalog_union": (g21_catalog_union, "WITH u AS (SELECT 'f' || o_orderkey AS id, o_orderpriority AS name FROM orders WHERE o_totalprice > 200000 UNION SELECT 'c' || c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) SELECT * FROM u ORDER BY lower(name), id LIMIT 1000"),
    "g22_counts": (g22_counts, f"SELECT label, count(*) AS n FROM ({sql_nodes()}) GROUP BY 1"),
    "g23_exclusive_delete": (g23_exclusive_delete, _DEL23),
    "g24_bulk_delete": (g24_bulk_delete, _DEL.format(keys="IN ('1', '2', '3')") + " SELECT root, count(*) AS n_deleted FROM r GROUP BY 1"),
    "g25_only_owned": (g25_only_owned, _OWN),
    "g28_stitch": (g28_stitch, _STITCH),
    "g29_combined": (g29_combined, _COMB),
    "g30_fold": (g30_fold, _FOLD),
    "g31_fanout_cap": (g31_fanout_cap, _FAN),
    "g32_line_index": (g32_line_index, _LINES),
    "g33_source_view": (g33_source_view, _VIEW),
    "g33_source_view_full": (g33_source_view_full, _VIEW.replace("2000", str(2 * 1024 * 1024))),
    "g34_plain_values": (g34_plain_values, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"),
    "g_flow_modes": (g_flow_modes, _FLOW),
    "c10_anchor": (c10_anchor, _ANCHOR),
    "c17_cycles": (c17_cycles, _CYC),
}
