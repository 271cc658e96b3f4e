"""Traversal against plain Python on random graphs, and its edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import catalog, delete, graph, relational, shape, upsert
from strandline.plans.guard import ReadOnlyViolation, assert_read_only


def _edges(spark, pairs, rel="R"):
    return spark.createDataFrame([(a, b, rel) for a, b in pairs], "src string, dst string, rel string")


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _bfs(pairs, start, depth):
    seen, frontier = {start: 0}, [start]
    for d in range(1, depth + 1):
        frontier = [b for a in frontier for x, b in pairs if x == a and b not in seen and not seen.update({b: d})]
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_is_breadth_first(spark, seed):
    r = random.Random(seed)
    pairs = list({(str(r.randint(0, 12)), str(r.randint(0, 12))) for _ in range(25)})
    got = {x.id: x.depth for x in graph.reach(_edges(spark, pairs), _ids(spark, "0"), 4, include_seeds=True).collect()}
    assert got == _bfs(pairs, "0", 4)


def test_reach_from_each_keeps_seeds_apart_and_empty_edges_give_the_seed(spark):
    got = {(x.root, x.id, x.depth) for x in graph.reach_from_each(_edges(spark, [("a", "b"), ("b", "c")]), _ids(spark, "a", "b")).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("b", "b", 0), ("b", "c", 1)}
    assert graph.reach(_edges(spark, [("x", "y")]).limit(0), _ids(spark, "a")).count() == 0


def test_trails_use_no_edge_twice(spark):
    got = [x.path for x in graph.trails(_edges(spark, [("a", "b"), ("b", "a")]), _ids(spark, "a"), 6).collect()]
    assert got == [["a", "b"], ["a", "b", "a"]]


def test_cycles(spark):
    found = graph.on_cycles(_edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("d", "f")]), 6)
    assert {x.id for x in found.collect()} == {"a", "b", "c", "e"}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "k int, v string, w string")
    once = upsert.upsert(old, new, ["k"], {"w": "first"})
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upsert.upsert(once, new, ["k"], {"w": "first"}).collect())) == [(1, "a", None), (2, "b", "x"), (3, "c", None)]


def test_allow_list_raises(spark):
    rows = spark.createDataFrame([("ok",), ("bad",)], "label string")
    with pytest.raises(Exception, match="not allowed"):
        upsert.allowed(rows, "label", ["ok"]).collect()


def test_delete_keeps_shared(spark):
    nodes = spark.createDataFrame([("s", "Script"), ("d", "DataFrame"), ("t", "Table"), ("o", "Script")], "id string, label string")
    edges = _edges(spark, [("s", "d"), ("d", "t"), ("o", "t")])
    left, kept, counts = delete.delete_exclusive(nodes, edges, _ids(spark, "s"), ["R"], ["Table"])
    assert {x.id for x in left.collect()} == {"t", "o"} and kept.count() == 1 and counts.first().n_deleted == 2


def test_presets_and_guard(spark):
    assert "lineage-upstream" in catalog.list_presets()
    with pytest.raises(KeyError):
        catalog.run_preset("nothing", None, None)
    assert_read_only(spark, "SELECT 1 -- drop")
    for bad in ("", "INSERT INTO t SELECT 1", "DROP TABLE t", "not sql at all", "CREATE VIEW v AS SELECT 1", "SET x = 1", "EXECUTE IMMEDIATE 'DROP TABLE t'", "COMMENT ON TABLE t IS 'x'", "ALTER TABLE t UNSET TBLPROPERTIES ('a')", "CLEAR CACHE"):
        with pytest.raises(ReadOnlyViolation):
            assert_read_only(spark, bad)


def test_adhoc_leaves_the_session_as_it_was(spark):
    spark.range(3).createOrReplaceTempView("nodes")
    got = catalog.adhoc(spark, "SELECT count(*) AS n FROM nodes JOIN edges ON id = src WHERE dst > :least", {"nodes": spark.range(9), "edges": spark.createDataFrame([(4, 7), (5, 1)], "src long, dst long")}, least=3)
    assert got.first().n == 1 and spark.table("nodes").count() == 3 and not spark.catalog.tableExists("edges")
    spark.sql("CREATE TABLE victim AS SELECT 1 AS a")
    with pytest.raises(ReadOnlyViolation):
        catalog.adhoc(spark, "EXECUTE IMMEDIATE 'DROP TABLE victim'", {})
    assert spark.table("victim").count() == 1
    spark.sql("DROP TABLE victim")
    spark.catalog.dropTempView("nodes")


def test_trails_stop_where_the_limit_is_reached(spark):
    # Twenty nodes, each with an edge to each: paths of length 6 are tens of millions.
    dense = _edges(spark, [(f"n{a}", f"n{b}") for a in range(20) for b in range(20)])
    got = graph.trails(dense, _ids(spark, "n0"), 6, limit=100).collect()
    assert len(got) == 100 and [x.depth for x in got] == [1] * 20 + [2] * 80


def test_reach_at_any_depth(spark):
    chain = _edges(spark, [(str(k), str(k + 1)) for k in range(12)])
    assert graph.reach(chain, _ids(spark, "0"), None).count() == 12


def test_upstream_walks_lineage_relations_only(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, name string").withColumn("props", F.create_map(F.lit("x"), F.lit("y")))
    edges = spark.createDataFrame([("a", "b", "READS_TABLE"), ("a", "c", "PROVIDES_DATAFRAME")], "src string, dst string, rel string")
    assert [x.node for x in catalog.run_preset("lineage-upstream", nodes, edges, id="a").collect()] == ["b"]
    assert len(catalog.LINEAGE_RELATIONS) == len(set(catalog.LINEAGE_RELATIONS)) == 62


def test_fold_hides_attributes(spark):
    nodes = spark.createDataFrame([("t", "Table", "t"), ("a", "Attribute", "x"), ("b", "Attribute", "y")], "id string, label string, name string")
    out, left = shape.fold_attributes(nodes, _edges(spark, [("t", "a"), ("t", "b")], "HAS_COLUMN"), ["HAS_COLUMN"])
    row = out.first()
    assert (row.col_count, row.columns) == (2, ["x", "y"]) and left.count() == 0


def test_chart_lineage_preset(spark):
    nodes = spark.createDataFrame([("c", "QlikChart", "c"), ("f", "Attribute", "f"), ("g", "Attribute", "g")], "id string, label string, name string").withColumn("props", F.create_map(F.lit("a"), F.lit("b")))
    edges = spark.createDataFrame([("c", "f", "USES_FIELD"), ("f", "g", "DERIVES_FROM"), ("t", "g", "HAS_COLUMN")], "src string, dst string, rel string")
    assert [tuple(x) for x in catalog.run_preset("qlikview-chart-lineage", nodes, edges).collect()] == [("c", "f", "g", "t")]


def test_level_of_detail(spark):
    df = spark.createDataFrame([("n", "x", 1, 10), ("n", "x", 2, 30), ("n", "y", 3, 5), ("s", "x", 4, 7)], "area string, kind string, customer int, v int")
    inc = {r.area: r.m for r in relational.include_lod(df, ["area"], ["customer"], F.sum("v"), F.avg, "m").collect()}
    assert inc == {"n": 15.0, "s": 7.0}
    exc = {(r.area, r.kind): r.t for r in relational.exclude_lod(df, ["area", "kind"], ["kind"], F.sum("v"), "t").collect()}
    assert exc == {("n", "x"): 45, ("n", "y"): 45, ("s", "x"): 7}
    assert {r.t for r in relational.exclude_lod(df, ["kind"], ["kind"], F.sum("v"), "t").collect()} == {52}


def test_natural_join_without_shared_names_is_refused(spark):
    with pytest.raises(ValueError, match="product"):
        relational.natural_join(spark.range(2).toDF("a"), spark.range(2).toDF("b"))
    assert relational.natural_join(spark.range(2).toDF("a"), spark.range(2).toDF("b"), allow_product=True).count() == 4
