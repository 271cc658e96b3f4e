"""Merge operators on slices of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upsert as u
from .star import key, sql_id, t

_SLICES = """old AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P'),
new AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN 'N' END AS status, o_totalprice + 1 AS price FROM orders WHERE o_orderpriority <> '5-LOW')"""


def _slices(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "o_orderpriority")
    new = o.filter("o_orderpriority <> '5-LOW'").select("k", F.when(F.col("price") > 100000, F.lit("N")).alias("status"), (F.col("price") + 1).alias("price"))
    return o.filter("status <> 'P'").drop("o_orderpriority"), new


def m1_upsert(spark, d):
    old, new = _slices(spark, d)
    return u.upsert(old, new, ["k"])


def m2_first_writer(spark, d):
    old, new = _slices(spark, d)
    return u.upsert(old, new, ["k"], {"status": "first", "price": "first"})


def m3_fill_nulls(spark, d):
    old, new = _slices(spark, d)
    return u.upsert(new, old, ["k"], {"status": "fill", "price": "last"})


def m4_bool_merge(spark, d):
    l = t(spark, d, "lineitem")
    half = lambda r: l.filter((F.col("l_returnflag") == "R") == r).groupBy(F.col("l_orderkey").alias("k")).agg(F.bool_and(F.col("l_quantity") > 5).alias("resolved"), F.bool_or(F.col("l_discount") > 0.09).alias("has_credentials"))
    return u.upsert(half(True), half(False), ["k"], {"resolved": "and", "has_credentials": "or"})


def m5_list_merge(spark, d):
    e = t(spark, d, "events")
    lists = lambda types: e.filter(F.col("event_type").isin(types)).groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("sources"))
    merged = u.upsert(lists(["signup", "view", "click"]), lists(["view", "error", "purchase"]), ["user_id"], {"sources": "append"})
    return merged.select("user_id", F.concat_ws(",", "sources").alias("sources"))


def m6_nonempty(spark, d):
    c = t(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("").alias("text"))
    new = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("text"))
    return u.upsert(old, new, ["k"], {"text": "nonempty"})


def m7_keyed_edges(spark, d):
    l = t(spark, d, "lineitem")
    e = l.select(key("supplier", ["l_suppkey"]).alias("src"), key("part", ["l_partkey"]).alias("dst"), F.lit("SHIPS").alias("rel"), F.col("l_returnflag").alias("key"))
    return u.merge_edges(e)


def m8_guarded_edges(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    nodes = t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id")).unionByName(t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))
    return u.guarded_edges(o, nodes)


def m10_coalesce_excluded(spark, d):
    old, new = _slices(spark, d)
    return u.upsert(old.drop("price"), new.drop("price"), ["k"], {"status": "last"})


def m11_insert_missing(spark, d):
    old, new = _slices(spark, d)
    return u.insert_missing(old, new, ["k"])


def m12_cascade(spark, d):
    gone = t(spark, d, "orders").filter("o_orderstatus = 'O'")
    return u.cascade(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey", "o_orderkey")


def m13_uniqueness(spark, d):
    return u.violations(t(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"])


def m14_allow_list(spark, d):
    return u.allowed(t(spark, d, "events").select("event_id", "event_type"), "event_type", ["signup", "view", "error", "click", "purchase"])


def m16_first_wins(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return u.first_wins(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


def m17_conflicts(spark, d):
    l = t(spark, d, "lineitem").groupBy("l_partkey", F.col("l_orderkey").alias("file")).agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"), F.min("l_suppkey").alias("l_suppkey"))
    return u.conflicts(l, "l_partkey", "file", ["l_returnflag", "l_linestatus", "l_suppkey"], "file")


_CONF = """
WITH l AS (SELECT l_partkey, l_orderkey AS file, min(l_returnflag) AS a, min(l_linestatus) AS b, min(l_suppkey) AS c FROM lineitem GROUP BY 1, 2),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY file) = 1)
SELECT l.l_partkey, f.file AS first_source, l.file AS later_source,
       concat_ws(',', CASE WHEN l.a IS DISTINCT FROM f.a THEN 'l_returnflag' END, CASE WHEN l.b IS DISTINCT FROM f.b THEN 'l_linestatus' END, CASE WHEN l.c IS DISTINCT FROM f.c THEN 'l_suppkey' END) AS fields
FROM l JOIN f USING (l_partkey) WHERE l.file <> f.file AND (l.a IS DISTINCT FROM f.a OR l.b IS DISTINCT FROM f.b OR l.c IS DISTINCT FROM f.c)"""


def m18_commonality(spark, d):
    return u.commonality(t(spark, d, "events"), "user_id", "event_type").select("user_id", "n_sources", F.concat_ws(",", "sources").alias("sources"), "common")


def m19_disjoint_edges(spark, d):
    # Users of even and odd number keep to event types of their own, but for some of them.
    e = t(spark, d, "events").filter("event_type IN ('view', 'click') AND user_id % 2 = 0 OR event_type = 'error' AND user_id % 2 = 1 OR event_type = 'view' AND user_id % 5 = 0")
    sources = u.commonality(e, "user_id", "event_type").select(F.col("user_id").alias("id"), "sources")
    pairs = e.select(F.col("user_id").alias("src"), (F.col("user_id") + 1).alias("dst")).distinct()
    return u.disjoint_edges(pairs, sources)


_DIS = """
WITH e AS (SELECT * FROM events WHERE event_type IN ('view', 'click') AND user_id % 2 = 0 OR event_type = 'error' AND user_id % 2 = 1 OR event_type = 'view' AND user_id % 5 = 0),
s AS (SELECT user_id AS id, array_agg(DISTINCT event_type) AS x FROM e GROUP BY 1), p AS (SELECT DISTINCT user_id AS src, user_id + 1 AS dst FROM e)
SELECT p.src, p.dst, list_min(a.x) AS src_source, list_min(b.x) AS dst_source FROM p JOIN s a ON a.id = p.src JOIN s b ON b.id = p.dst WHERE NOT list_has_any(a.x, b.x)"""


def m20_shared_tables(spark, d):
    a = t(spark, d, "lineitem").filter("l_shipdate < '1995-03-01'").select(key("part", ["l_partkey"]).alias("id"))
    b = t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(key("part", ["l_partkey"]).alias("id"))
    return a.intersect(b)


QUERIES = {
    "m1_upsert": (m1_upsert, f"WITH {_SLICES} SELECT k, coalesce(new.status, old.status) AS status, coalesce(new.price, old.price) AS price FROM old FULL JOIN new USING (k)"),
    "m2_first_writer": (m2_first_writer, f"WITH {_SLICES} SELECT k, coalesce(old.status, new.status) AS status, coalesce(old.price, new.price) AS price FROM old FULL JOIN new USING (k)"),
    "m3_fill_nulls": (m3_fill_nulls, f"WITH {_SLICES} SELECT k, coalesce(new.status, old.status) AS status, coalesce(old.price, new.price) AS price FROM old FULL JOIN new USING (k)"),
    "m4_bool_merge": (m4_bool_merge, "SELECT l_orderkey AS k, bool_and(l_quantity > 5) AS resolved, bool_or(l_discount > 0.09) AS has_credentials FROM lineitem GROUP BY 1"),
    "m5_list_merge": (
        m5_list_merge,
        "WITH a AS (SELECT user_id, list_sort(array_agg(DISTINCT event_type)) AS x FROM events WHERE event_type IN ('signup', 'view', 'click') GROUP BY 1), b AS (SELECT user_id, list_sort(array_agg(DISTINCT event_type)) AS y FROM events WHERE event_type IN ('view', 'error', 'purchase') GROUP BY 1) SELECT user_id, array_to_string(list_concat(list_filter(coalesce(x, []), lambda v: NOT list_contains(coalesce(y, []), v)), coalesce(y, [])), ',') AS sources FROM a FULL JOIN b USING (user_id)",
    ),
    "m6_nonempty": (m6_nonempty, "SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 AND c_mktsegment <> '' THEN c_mktsegment ELSE c_name END AS text FROM customer"),
    "m7_keyed_edges": (m7_keyed_edges, f"SELECT DISTINCT {sql_id('supplier', ['l_suppkey'])} AS src, {sql_id('part', ['l_partkey'])} AS dst, 'SHIPS' AS rel, l_returnflag AS key FROM lineitem"),
    "m8_guarded_edges": (m8_guarded_edges, "WITH n AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_custkey IN (SELECT id FROM n) AND o_orderkey IN (SELECT id FROM n)"),
    "m10_coalesce_excluded": (m10_coalesce_excluded, f"WITH {_SLICES} SELECT k, coalesce(new.status, old.status) AS status FROM old FULL JOIN new USING (k)"),
    "m11_insert_missing": (m11_insert_missing, f"WITH {_SLICES} SELECT * FROM old UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)"),
    "m12_cascade": (m12_cascade, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')"),
    "m13_uniqueness": (m13_uniqueness, "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "m14_allow_list": (m14_allow_list, "SELECT event_id, event_type FROM events"),
    "m16_first_wins": (m16_first_wins, "SELECT user_id, event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"),
    "m17_conflicts": (m17_conflicts, _CONF),
    "m18_commonality": (m18_commonality, "SELECT user_id, count(DISTINCT event_type) AS n_sources, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources, count(DISTINCT event_type) >= 2 AS common FROM events GROUP BY 1"),
    "m19_disjoint_edges": (m19_disjoint_edges, _DIS),
    "m20_shared_tables": (m20_shared_tables, f"SELECT {sql_id('part', ['l_partkey'])} AS id FROM lineitem WHERE l_shipdate < '1995-03-01' INTERSECT SELECT {sql_id('part', ['l_partkey'])} FROM lineitem WHERE l_returnflag = 'R'"),
}
