"""Scheduler, join, aggregation, window, sort and set operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as r
from ..operators import scheduler as s
from ..plans.storage import scoped_views
from .star import t


def _jobs(spark, d):
    """Events as jobs: users are workstations, types are schedules, the time of day is the start."""
    e = t(spark, d, "events")
    start = F.when(F.col("event_type") != "signup", F.date_format("ts", "HH:mm"))
    return e.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("schedule_id"), start.alias("start_time"), F.concat(F.lit("/opt/"), "event_type", F.lit("/run_"), (F.col("user_id") % 7).cast("string"), F.lit(".sh")).alias("script_path"), F.concat(F.lit("WS"), (F.col("user_id") % 5).cast("string")).alias("workstation"))


_JOBS = "j AS (SELECT event_id AS job_id, event_type AS schedule_id, CASE WHEN event_type <> 'signup' THEN strftime(ts, '%H:%M') END AS start_time, '/opt/' || event_type || '/run_' || (user_id % 7) || '.sh' AS script_path, 'WS' || (user_id % 5) AS workstation FROM events)"


def _schedules(spark, d):
    return t(spark, d, "events").groupBy(F.col("event_type").alias("schedule_id")).agg(F.count(F.lit(1)).alias("n_jobs"))


def q1_jobs_with_schedule(spark, d):
    return s.jobs_with_schedule(_jobs(spark, d), _schedules(spark, d))


def q2_runtime_window(spark, d):
    return s.runtime_window(_jobs(spark, d), _schedules(spark, d)).select("job_id", "schedule_id", "start_time")


def q3_window_search(spark, d):
    return s.search_jobs(_jobs(spark, d), "06:00", "09:30", "VIEW/RUN_", "WS1", 200)


def q3_overnight(spark, d):
    return s.search_jobs(_jobs(spark, d), "23:00", "02:00", limit=2000, wrap=True)


def q4_half_open(spark, d):
    return s.export_jobs(_jobs(spark, d), "06:00", "09:30", "click")


def _files(spark, d):
    o = t(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("file_id"), F.col("o_orderstatus").alias("source"), F.col("o_orderdate").alias("added"))


def q5_filtered_counts(spark, d):
    p = t(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("project_name"), F.col("c_nationkey").alias("created"))
    return s.project_list(p, _files(spark, d), ["F", "O", "P"])


def q6_project_detail(spark, d):
    return s.project_detail(_files(spark, d)).select("project_id", "source", F.concat_ws(",", F.col("files").cast("array<string>")).alias("files"))


def q7_get_or_create(spark, d):
    n = t(spark, d, "nation")
    names = n.select(F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("project_name"))
    have = n.filter("n_regionkey < 2").select(F.col("n_name").alias("project_name"))
    return s.get_or_create(have, names)


def q8_attach_files(spark, d):
    f = _files(spark, d)
    return s.attach_files(f.filter("source = 'F'"), f.filter("source <> 'P'").unionByName(f.filter("source = 'O'"))).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_files"))


def q9_delete_project(spark, d):
    return _files(spark, d).filter("project_id <> 7").select("project_id", "file_id")


def q10_status_rollup(spark, d):
    return s.status_rollup(t(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") != "R")


def q11_file_stats(spark, d):
    l, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_jobs"), F.count_distinct("l_orderkey").alias("n_schedules"), F.count_distinct("l_partkey").alias("n_resources"))


def q12_distinct_counts(spark, d):
    l = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_list("l_partkey").alias("needs"), F.collect_list("l_orderkey").alias("opens"))
    return l.select("l_suppkey", F.size(F.array_distinct("needs")).alias("n_resources"), F.size(F.array_distinct("opens")).alias("n_files"))


def _cn(spark, d):
    c = t(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey")
    o = t(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return c, o


_CN = "c AS (SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_acctbal > 0), o AS (SELECT o_orderkey, o_custkey AS c_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F')"


def _join(how):
    def run(spark, d):
        c, o = _cn(spark, d)
        return c.join(o, "c_custkey", how)

    return run


def j1_cross(spark, d):
    return t(spark, d, "region").select("r_name").crossJoin(t(spark, d, "nation").select("n_name"))


def j1_theta(spark, d):
    """An inequality over a band: sizes in bands of 5 make it an equi-join, then the exact condition holds."""
    sizes = t(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    p = sizes.select("p_size", "n", F.explode(F.array(F.floor(F.col("p_size") / 5), F.floor(F.col("p_size") / 5) + 1)).alias("band"))
    q = sizes.select(F.col("p_size").alias("other"), F.col("n").alias("m"), F.floor(F.col("p_size") / 5).alias("band"))
    return p.join(q, "band").filter((F.col("other") > F.col("p_size")) & (F.col("other") <= F.col("p_size") + 5)).select("p_size", "other", (F.col("n") * F.col("m")).alias("pairs"))


def j3_broadcast(spark, d):
    l = t(spark, d, "lineitem")
    named = t(spark, d, "nation").join(t(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "n_name")
    return l.join(r.broadcast_if_small(named), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


def j6_natural_join(spark, d):
    c, o = _cn(spark, d)
    return r.natural_join(c, o, "outer")


def j7_keep(spark, d):
    c, o = _cn(spark, d)
    a, b = r.keep(c, o)
    return a.select(F.lit("c").alias("side"), F.col("c_custkey").alias("id")).unionByName(b.select(F.lit("o").alias("side"), F.col("o_orderkey").alias("id")))


def j8_shared_fields(spark, d):
    """Fields that two event types share refer to one another; others derive."""
    e = t(spark, d, "events").select("event_type", (F.col("user_id") % 50).alias("field")).distinct()
    a, b = e.filter("event_type = 'view'").select("field"), e.filter("event_type = 'purchase'").select("field", F.lit(True).alias("shared"))
    return a.join(b, "field", "left").select("field", F.when(F.col("shared"), "REFERENCES_FK").otherwise("DERIVES_FROM").alias("rel"), F.when(F.col("shared"), 0.6).otherwise(0.85).alias("confidence"))


def j10_blend(spark, d):
    """A blend: the secondary source is aggregated to the linked field, then joined from the left."""
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    second = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return c.select("c_custkey", "c_mktsegment").join(second, "c_custkey", "left")


def j11_name_resolution(spark, d):
    n = t(spark, d, "nation").select(F.lower("n_name").alias("name"), "n_nationkey")
    refs = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_acctbal") < 0, "nowhere").otherwise(F.col("n_name")).alias("ref"))
    return refs.join(n, F.lower("ref") == F.col("name")).select("c_custkey", "n_nationkey")


def j12_scoped_resolve(spark, d):
    l = t(spark, d, "lineitem")
    text = lambda c: F.col(c).cast("string")
    targets = l.dropDuplicates(["l_suppkey", "l_linenumber", "l_returnflag"]).select(text("l_suppkey").alias("workstation"), text("l_linenumber").alias("stream"), F.col("l_returnflag").alias("job"), F.concat_ws("#", text("l_suppkey"), text("l_linenumber"), F.col("l_returnflag")).alias("target_id"))
    refs = l.select(F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("ref_id"), text("l_suppkey").alias("workstation"), F.when(F.col("l_quantity") > 25, "99").otherwise(text("l_linenumber")).alias("stream"), F.col("l_returnflag").alias("job"), (F.col("l_quantity") > 25).alias("external"))
    found, missing = r.scoped_resolve(refs, targets)
    return found.unionByName(missing.select("ref_id", "external", F.lit(None).cast("string").alias("target_id")))


_SCOPE = """
WITH l AS (SELECT l_orderkey || '-' || l_linenumber AS ref_id, l_quantity > 25 AS external, l_suppkey || '#' || l_linenumber || '#' || l_returnflag AS x FROM lineitem)
SELECT ref_id, external, CASE WHEN NOT external THEN x END AS target_id FROM l"""


def j14_unique_name(spark, d):
    p = t(spark, d, "part")
    targets = p.select(F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("name"), F.col("p_partkey").alias("target_id"))
    refs = t(spark, d, "part").select(F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("name"), "p_partkey")
    return r.unique_name_join(refs, targets, "name")


def j18_order_correlate(spark, d):
    e = t(spark, d, "events")
    a = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("planned"), F.col("ts").alias("ta"))
    b = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("ran"), F.col("ts").alias("tb"))
    return r.positional_join(a, b, ["user_id"], [F.col("ta"), F.col("planned")], [F.col("tb"), F.col("ran")]).select("user_id", "position", "planned", "ran")


def j20_missing_tables(spark, d):
    refs = t(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return refs.join(t(spark, d, "part").filter("p_size > 5").select("p_partkey"), "p_partkey", "left_anti")


def apply_map(spark, d):
    m = t(spark, d, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return r.apply_map(t(spark, d, "customer").select("c_custkey", "c_nationkey"), m, "c_nationkey", "country", F.lit("Unknown"))


def a1_groupby_agg(spark, d):
    l = t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.max("l_shipdate").alias("last"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("n_parts"))


def a2_stats(spark, d):
    l = t(spark, d, "lineitem")
    x, y = "l_quantity", "l_extendedprice"
    return l.groupBy("l_returnflag").agg(*[F.round(f, 5).alias(n) for n, f in {"mean": F.mean(x), "sd": F.stddev(x), "sd_pop": F.stddev_pop(x), "var": F.variance(x), "var_pop": F.var_pop(x), "corr": F.corr(x, y), "cov_pop": F.covar_pop(x, "l_discount"), "cov_samp": F.covar_samp(x, "l_discount"), "skew": F.skewness(x), "kurt": F.kurtosis(x)}.items()], F.min(x).alias("low"), F.max(x).alias("high"))


_M = "avg(pow(l_quantity - m, {k}))"
_STATS = """
WITH x AS (SELECT *, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)
SELECT l_returnflag, round(avg(l_quantity), 5) AS mean, round(stddev_samp(l_quantity), 5) AS sd, round(stddev_pop(l_quantity), 5) AS sd_pop, round(var_samp(l_quantity), 5) AS var, round(var_pop(l_quantity), 5) AS var_pop,
       round(corr(l_quantity, l_extendedprice), 5) AS corr, round(covar_pop(l_quantity, l_discount), 5) AS cov_pop, round(covar_samp(l_quantity, l_discount), 5) AS cov_samp,
       round(avg(pow(l_quantity - m, 3)) / pow(var_pop(l_quantity), 1.5), 5) AS skew, round(avg(pow(l_quantity - m, 4)) / pow(var_pop(l_quantity), 2) - 3, 5) AS kurt, min(l_quantity) AS low, max(l_quantity) AS high
FROM x GROUP BY 1"""


def a4_conditional(spark, d):
    l = t(spark, d, "lineitem")
    return l.groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"), F.round(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).otherwise(0)), 2).alias("done"))


def a5_month_rollup(spark, d):
    o = t(spark, d, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def a7_lod_fixed(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return r.fixed_lod(c, ["c_nationkey"], F.round(F.avg("c_acctbal"), 4), "nation_avg")


def a10_signature(spark, d):
    return r.dag_signature(t(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_partkey")


def a11_forks(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


def a12_synkey(spark, d):
    """Event types as datasets, residues of their users as fields."""
    f = t(spark, d, "events").select(F.col("event_type").alias("dataset"), F.concat(F.lit("F"), (F.col("user_id") % 23).cast("string")).alias("field"))
    return r.synthetic_keys(f).select("a", "b", "n", F.concat_ws(",", "fields").alias("fields"))


def a13_ordered_collect(spark, d):
    l = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return l.select("l_orderkey", F.concat_ws(",", F.col("x.l_partkey").cast("array<string>")).alias("parts"))


def w1_topn(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn")).filter("rn <= 3")


def w2_rank(spark, d):
    with scoped_views(spark, {"part": t(spark, d, "part")}):
        return spark.sql("SELECT p_partkey, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")


def w3_range7d(spark, d):
    with scoped_views(spark, {"orders": t(spark, d, "orders")}):
        return spark.sql("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '7' DAY PRECEDING AND CURRENT ROW), 2) AS week FROM orders")


def w4_velocity(spark, d):
    e = t(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    a = Window.partitionBy("user_id")
    return e.select("event_id", F.count(F.lit(1)).over(w).alias("velocity"), F.round((F.col("value") - F.avg("value").over(a)) / F.stddev("value").over(a), 6).alias("z"))


def w6_qualify(spark, d):
    """QUALIFY, which Spark's parser lacks, as a filter over a subquery: rewritten from the vendor's text.

    Lines may share order and number. Of these the first read counts, by file and row, however the files are split:
    the SQL leaves it open, and DuckDB on one thread takes that row.
    """
    from ..plans.sql_lineage import rewrite_qualify

    lines = t(spark, d, "lineitem").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("read_at"))
    with scoped_views(spark, {"lineitem": lines}):
        return spark.sql(rewrite_qualify("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, read_at) = 1"))


def w7_lag_diff(spark, d):
    """Schema versions: the set of parts of a supplier's lines, one version a year."""
    l = t(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("table_fqn"), F.year("l_shipdate").alias("version"), F.concat(F.lit("c"), (F.col("l_partkey") % 40).cast("string")).alias("name"), "l_returnflag", "l_linestatus")
    cols = l.groupBy("table_fqn", "version", "name").agg(F.max("l_returnflag").alias("type"), (F.max("l_linestatus") == "O").alias("nullable"))
    v = cols.groupBy("table_fqn", "version").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("type", "nullable")))).alias("columns"))
    return r.schema_changes(v)


_DIFF = """
WITH c AS (SELECT l_suppkey::VARCHAR AS table_fqn, year(l_shipdate)::INTEGER AS version, 'c' || (l_partkey % 40) AS name, max(l_returnflag) AS type, max(l_linestatus) = 'O' AS nullable FROM lineitem GROUP BY 1, 2, 3),
v AS (SELECT DISTINCT table_fqn, version FROM c), p AS (SELECT *, lag(version) OVER (PARTITION BY table_fqn ORDER BY version) AS prev FROM v),
n AS (SELECT p.table_fqn, p.version, p.prev, c.name FROM p JOIN c ON c.table_fqn = p.table_fqn AND (c.version = p.version OR c.version = p.prev) WHERE p.prev IS NOT NULL GROUP BY ALL),
x AS (SELECT n.table_fqn, n.version, n.name AS "column", o.type AS from_type, m.type AS to_type, o.nullable AS from_nullable, m.nullable AS to_nullable,
  CASE WHEN o.name IS NULL THEN 'column_added' WHEN m.name IS NULL THEN 'column_dropped' WHEN o.type <> m.type THEN 'type_changed' WHEN o.nullable <> m.nullable THEN 'nullability_changed' END AS kind
  FROM n LEFT JOIN c o ON o.table_fqn = n.table_fqn AND o.version = n.prev AND o.name = n.name LEFT JOIN c m ON m.table_fqn = n.table_fqn AND m.version = n.version AND m.name = n.name)
SELECT table_fqn, version, kind, "column", from_type, to_type, from_nullable, to_nullable FROM x WHERE kind IS NOT NULL"""


def w9_creation_order(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).alias("creation_order"))


def o1_sort_limit(spark, d):
    return t(spark, d, "customer").select("c_mktsegment", "c_custkey").distinct().orderBy(F.desc("c_mktsegment"), "c_custkey").limit(50)


def o3_case_insensitive(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")).alias("name"))
    return p.orderBy(F.asc_nulls_last(F.lower("name")), "p_partkey").offset(10).limit(40)


def u1_union_by_name(spark, d):
    a = t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return a.unionByName(t(spark, d, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name")))


def u3_union_distinct(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


def u4_concatenate(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return r.concatenate(a, t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"))


def u5_intersect(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


def u6_except(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("k")).exceptAll(t(spark, d, "customer").select(F.col("c_custkey").alias("k")))


_SEL = {"inner": "SELECT c.*, o.o_orderkey, o.o_orderstatus FROM c JOIN o USING (c_custkey)", "left": "SELECT c.*, o.o_orderkey, o.o_orderstatus FROM c LEFT JOIN o USING (c_custkey)", "right": "SELECT c_custkey, c_name, c_nationkey, o_orderkey, o_orderstatus FROM c RIGHT JOIN o USING (c_custkey)", "full": "SELECT c_custkey, c_name, c_nationkey, o_orderkey, o_orderstatus FROM c FULL JOIN o USING (c_custkey)", "left_semi": "SELECT * FROM c WHERE c_custkey IN (SELECT c_custkey FROM o)", "left_anti": "SELECT * FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM o)"}

QUERIES = {
    "q1_jobs_with_schedule": (q1_jobs_with_schedule, f"WITH {_JOBS} SELECT j.*, n.n_jobs FROM j JOIN (SELECT event_type AS schedule_id, count(*) AS n_jobs FROM events GROUP BY 1) n USING (schedule_id)"),
    "q2_runtime_window": (q2_runtime_window, f"WITH {_JOBS} SELECT job_id, schedule_id, start_time FROM j WHERE start_time IS NOT NULL"),
    "q3_window_search": (q3_window_search, f"WITH {_JOBS} SELECT * FROM j WHERE start_time >= '06:00' AND start_time <= '09:30' AND script_path ILIKE '%VIEW/RUN_%' AND workstation = 'WS1' ORDER BY start_time NULLS LAST, job_id LIMIT 200"),
    "q3_overnight": (q3_overnight, f"WITH {_JOBS} SELECT * FROM j WHERE start_time >= '23:00' OR start_time <= '02:00' ORDER BY start_time NULLS LAST, job_id LIMIT 2000"),
    "q4_half_open": (q4_half_open, f"WITH {_JOBS} SELECT * FROM j WHERE start_time >= '06:00' AND start_time < '09:30' AND schedule_id = 'click'"),
    "q5_filtered_counts": (q5_filtered_counts, "SELECT c_custkey AS project_id, c_name AS project_name, c_nationkey AS created, count(o_orderkey) AS n_files, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"n_P\" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3"),
    "q6_project_detail": (q6_project_detail, "SELECT o_custkey AS project_id, o_orderstatus AS source, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS files FROM orders GROUP BY 1, 2"),
    "q7_get_or_create": (q7_get_or_create, "SELECT n_name AS project_name FROM nation WHERE n_regionkey >= 2"),
    "q8_attach_files": (q8_attach_files, "SELECT o_custkey AS project_id, count(*) AS n_files FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1"),
    "q9_delete_project": (q9_delete_project, "SELECT o_custkey AS project_id, o_orderkey AS file_id FROM orders WHERE o_custkey <> 7"),
    "q10_status_rollup": (q10_status_rollup, "SELECT l_orderkey, CASE WHEN bool_and(l_returnflag <> 'R') THEN 'ok' WHEN NOT bool_or(l_returnflag <> 'R') THEN 'failed' ELSE 'partial' END AS status, count(*) AS n FROM lineitem GROUP BY 1"),
    "q11_file_stats": (q11_file_stats, "SELECT o_orderpriority, count(*) AS n_jobs, count(DISTINCT l_orderkey) AS n_schedules, count(DISTINCT l_partkey) AS n_resources FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"),
    "q12_distinct_counts": (q12_distinct_counts, "SELECT l_suppkey, count(DISTINCT l_partkey)::INTEGER AS n_resources, count(DISTINCT l_orderkey)::INTEGER AS n_files FROM lineitem GROUP BY 1"),
    **{f"j1_{how}": (_join(how), f"WITH {_CN} {sql}") for how, sql in _SEL.items()},
    "j1_cross": (j1_cross, "SELECT r_name, n_name FROM region, nation"),
    "j1_theta": (j1_theta, "WITH s AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT p.p_size, q.p_size AS other, p.n * q.n AS pairs FROM s p JOIN s q ON q.p_size > p.p_size AND q.p_size <= p.p_size + 5"),
    "j3_broadcast": (j3_broadcast, "SELECT n_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1"),
    "j6_natural_join": (j6_natural_join, f"WITH {_CN} {_SEL['full']}"),
    "j7_keep": (j7_keep, f"WITH {_CN} SELECT 'c' AS side, c_custkey AS id FROM c WHERE c_custkey IN (SELECT c_custkey FROM o) UNION ALL SELECT 'o', o_orderkey FROM o WHERE c_custkey IN (SELECT c_custkey FROM c)"),
    "j8_shared_fields": (j8_shared_fields, "WITH a AS (SELECT DISTINCT user_id % 50 AS field FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id % 50 AS field FROM events WHERE event_type = 'purchase') SELECT a.field, CASE WHEN b.field IS NULL THEN 'DERIVES_FROM' ELSE 'REFERENCES_FK' END AS rel, CASE WHEN b.field IS NULL THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence FROM a LEFT JOIN b USING (field)"),
    "j10_blend": (j10_blend, "SELECT c_custkey, c_mktsegment, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"),
    "j11_name_resolution": (j11_name_resolution, "SELECT c_custkey, c_nationkey AS n_nationkey FROM customer WHERE c_acctbal >= 0"),
    "j12_scoped_resolve": (j12_scoped_resolve, _SCOPE),
    "j14_unique_name": (j14_unique_name, "WITH u AS (SELECT p_brand || '|' || p_size AS name, min(p_partkey) AS target_id FROM part GROUP BY 1 HAVING count(*) = 1) SELECT u.name, p_partkey, target_id FROM part JOIN u ON u.name = p_brand || '|' || p_size"),
    "j18_order_correlate": (j18_order_correlate, "WITH a AS (SELECT user_id, event_id AS planned, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id AS ran, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE event_type = 'click') SELECT user_id, position::INTEGER AS position, planned, ran FROM a JOIN b USING (user_id, position)"),
    "j20_missing_tables": (j20_missing_tables, "SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)"),
    "apply_map": (apply_map, "SELECT c_custkey, c_nationkey, coalesce(CASE WHEN n_regionkey <> 2 THEN n_name END, 'Unknown') AS country FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"),
    "a1_groupby_agg": (a1_groupby_agg, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, max(l_shipdate) AS last, count(*) AS n, count(DISTINCT l_partkey) AS n_parts FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY 1, 2"),
    "a2_stats": (a2_stats, _STATS),
    "a4_conditional": (a4_conditional, "SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned, round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END), 2) AS done FROM lineitem GROUP BY 1"),
    "a5_month_rollup": (a5_month_rollup, "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2"),
    "a7_lod_fixed": (a7_lod_fixed, "SELECT c_custkey, c_nationkey, c_acctbal, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS nation_avg FROM customer"),
    "a10_signature": (a10_signature, "SELECT l_orderkey, substr(sha256(string_agg(DISTINCT l_suppkey || '>' || l_partkey, ';' ORDER BY l_suppkey || '>' || l_partkey)), 1, 16) AS signature FROM lineitem GROUP BY 1"),
    "a11_forks": (a11_forks, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 2"),
    "a12_synkey": (a12_synkey, "WITH f AS (SELECT DISTINCT event_type AS d, 'f' || (user_id % 23) AS f FROM events) SELECT x.d AS a, y.d AS b, count(*) AS n, string_agg(f, ',' ORDER BY f) AS fields FROM f x JOIN f y USING (f) WHERE x.d < y.d GROUP BY 1, 2 HAVING count(*) >= 2"),
    "a13_ordered_collect": (a13_ordered_collect, "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1"),
    "w1_topn": (w1_topn, "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS rn FROM orders QUALIFY rn <= 3"),
    "w2_rank": (w2_rank, "SELECT p_partkey, (rank() OVER w)::INTEGER AS rk, (dense_rank() OVER w)::INTEGER AS dr FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)"),
    "w3_range7d": (w3_range7d, "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW), 2) AS week FROM orders"),
    "w4_velocity": (w4_velocity, "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS velocity, round((value - avg(value) OVER (PARTITION BY user_id)) / stddev_samp(value) OVER (PARTITION BY user_id), 6) AS z FROM events"),
    "w6_qualify": (w6_qualify, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1"),
    "w7_lag_diff": (w7_lag_diff, _DIFF),
    "w9_creation_order": (w9_creation_order, "SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INTEGER AS creation_order FROM lineitem"),
    "o1_sort_limit": (o1_sort_limit, "SELECT DISTINCT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 50"),
    "o3_case_insensitive": (o3_case_insensitive, "SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS name FROM part ORDER BY lower(name) NULLS LAST, p_partkey LIMIT 40 OFFSET 10"),
    "u1_union_by_name": (u1_union_by_name, "SELECT c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier"),
    "u3_union_distinct": (u3_union_distinct, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "u4_concatenate": (u4_concatenate, "SELECT c_custkey AS k, c_mktsegment, NULL::VARCHAR AS s_name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier"),
    "u5_intersect": (u5_intersect, "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "u6_except": (u6_except, "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer"),
}
