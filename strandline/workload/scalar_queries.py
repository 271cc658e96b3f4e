"""Scalar functions, projections and user functions on the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import ids, text
from .star import t


def p1_select(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.col("l_quantity").cast("int").alias("qty"))


def p2_select_expr(spark, d):
    return t(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size", "substring(o_orderpriority, 1, 1) AS prio")


def p3_with_column(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.struct("p_size", "p_brand").alias("info"))
    p = p.withColumn("info", F.col("info").withField("p_size", F.col("info.p_size") + 1))
    return p.select("p_partkey", F.col("info.p_size").alias("p_size"), F.col("info.p_brand").alias("p_brand"))


def p4_rename_drop(spark, d):
    return t(spark, d, "supplier").withColumnRenamed("s_name", "supplier").drop("s_acctbal")


def p6_filter(spark, d):
    return t(spark, d, "lineitem").filter((F.col("l_quantity") < 10) & F.col("l_returnflag").isin("A", "R") & F.col("l_discount").between(0.05, 0.07)).select("l_orderkey", "l_linenumber")


def p10_star_expand(spark, d):
    return t(spark, d, "region").select("*", F.upper("r_name").alias("loud"))


_IF = [(1, "'a' = 'a'"), (2, "'a' = 'b'"), (3, "3 = 3"), (4, "-1"), (5, "0"), (6, "$(x) = 1"), (7, "TRUE"), (8, "2 <> 2")]


def p13_static_if(spark, d):
    from ..sources.qlik import static_truth

    rows = spark.createDataFrame(_IF, "id int, condition string")
    return rows.select("id", static_truth(F.col("condition")).alias("truth"))


def p14_distinct_edges(spark, d):
    return t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").dropDuplicates()


def s_strings(spark, d):
    p = t(spark, d, "part")
    n = F.col("p_name")
    return p.select("p_partkey", F.concat_ws("-", n, "p_brand").alias("joined"), F.upper(n).alias("u"), F.lower("p_type").alias("l"), F.substring(n, 2, 4).alias("sub"), F.length(n).alias("len"), F.regexp_replace(n, "[aeiou]", "_").alias("masked"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("digits"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"), F.rtrim(F.concat(n, F.lit("  "))).alias("rt"))


def s_dates(spark, d):
    o = t(spark, d, "orders")
    c = F.col("o_orderdate")
    return o.select("o_orderkey", F.year(c).alias("y"), F.month(c).alias("m"), F.dayofmonth(c).alias("dom"), F.dayofweek(c).alias("dow"), F.hour(c).alias("h"), F.minute(c).alias("mi"), F.second(c).alias("s"), F.to_date(c).cast("string").alias("d"))


def s_math(spark, d):
    l = t(spark, d, "lineitem")
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    return l.select("l_orderkey", "l_linenumber", F.bround(x, 0).alias("r"), F.abs(-q).alias("a"), F.floor(x / q).cast("long").alias("f"), F.ceil(x / q).cast("long").alias("c"), (F.col("l_orderkey") % 7).alias("mod"), F.pow(q, F.lit(2.0)).alias("sq"), F.floor(x / q * 1000).alias("div"))


def s_conditional(spark, d):
    c = t(spark, d, "customer")
    k = F.col("c_custkey")
    maybe = F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", F.coalesce(maybe, F.lit("none")).alias("seg"), maybe.isNull().alias("gone"), F.when(k % 2 == 0, "even").otherwise("odd").alias("parity"), k.cast("string").alias("text"), F.isnan(F.when(k == 1, F.lit(float("nan"))).otherwise(1.0)).alias("nan"))


def s_arrays(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("p"))
    return x.select("l_orderkey", F.size("p").alias("n"), F.array_contains("p", 5).alias("has"), F.concat_ws(",", F.filter("p", lambda v: v % 2 == 0).cast("array<string>")).alias("even"), F.aggregate("p", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.element_at("p", -1).alias("last"), F.size(F.array_distinct("p")).alias("kinds"))


def s_explode(spark, d):
    x = t(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("pos", "word"))
    return x


def s_json(spark, d):
    e = t(spark, d, "events")
    k = F.from_json("props", "k int")["k"]
    return e.select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("t"))).alias("j"))


def s_options(spark, d):
    """Options of a map as sorted k=v text."""
    p = t(spark, d, "part").select("p_partkey", F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")).alias("m"))
    return p.select("p_partkey", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("options"))


def s_hash(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", ids.canonical_id(F.lit("Table"), F.col("p_name")).alias("id"), F.sha2("p_name", 256).alias("full"), ids.table_id(F.concat(F.lit("Raw."), F.regexp_replace("p_name", " ", "_"))).alias("table_id"))


def s_urls(spark, d):
    p = t(spark, d, "pages").select("page_id", text.uri_parts(F.col("url")).alias("u"), text.scrubbed_url(F.col("url")).alias("clean"), ids.path_id(F.col("url")).alias("id"))
    return p.select("page_id", "u.scheme", "u.bucket", "u.path", "clean", "id")


_URLS = r"""
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS bucket,
       regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '(.)/+$', '\1') AS path, url AS clean, substr(sha256(lower('path::' || regexp_replace(trim(url), '/+$', ''))), 1, 16) AS id FROM pages"""

_CYCLES = [(1, "DAILY", "05:30"), (2, "MON_WED_FRI", "23:05"), (3, "WEEKDAYS", "00:00"), (4, "MONTHLY ON 15", "12:00"), (5, "MONTHLY", None), (6, "ON REQUEST", "01:00"), (7, "YEARLY", "02:00"), (8, "FISCAL", "03:00"), (9, "WEEKLY", "04:00")]


def s_runcycle(spark, d):
    rows = spark.createDataFrame(_CYCLES, "id int, name string, start string")
    rows = rows.select("id", text.run_cycle(F.col("name"), F.col("start")).alias("r"))
    return rows.select("id", "r.frequency", F.concat_ws(",", "r.days").alias("days"), "r.cron")


_TIMES = [(1, "0530"), (2, "05:30"), (3, "530"), (4, "2460"), (5, "25:00"), (6, "23:59"), (7, ""), (8, "x")]


def s_times(spark, d):
    rows = spark.createDataFrame(_TIMES, "id int, text string")
    return rows.select("id", text.clock_time(F.col("text")).alias("time"))


_DATES = [(1, "02/29/2024"), (2, "2024-01-31"), (3, "13/01/2024"), (4, "soon")]


def s_calendar(spark, d):
    rows = spark.createDataFrame(_DATES, "id int, text string")
    return rows.select("id", text.calendar_date(F.col("text")).cast("string").alias("date"))


_JDBC = [(1, "jdbc:postgresql://DB.example.org:5433/sales?ssl=true"), (2, "jdbc:sqlserver://sql1;databaseName=crm;user=x"), (3, "jdbc:oracle:thin:@ora1:1521:ORCL"), (4, "jdbc:mysql://user:pw@my.example.org/shop")]


def s_jdbc(spark, d):
    rows = spark.createDataFrame(_JDBC, "id int, url string").withColumn("p", text.jdbc_parts(F.col("url")))
    return rows.select("id", "p.class", "p.host", "p.port", "p.database")


_FORMULAS = [(1, "SUM([Sales]) / [Profit ]] Ratio]"), (2, "{FIXED [Region], [Segment] : AVG([Sales])}"), (3, "IF [A] = '[not]' THEN [B] END"), (4, "1 + 1")]


def s_bracket_refs(spark, d):
    rows = spark.createDataFrame(_FORMULAS, "id int, formula string")
    return rows.select("id", F.concat_ws("|", text.bracket_refs(F.col("formula"))).alias("refs"), text.lod_dimensions(F.col("formula"))["kind"].alias("lod"), F.concat_ws("|", text.lod_dimensions(F.col("formula"))["dims"]).alias("dims"))


def f1_pandas_udf(spark, d):
    """A vectorised user function: a banded price."""

    @F.pandas_udf("string")
    def band(price: pd.Series) -> pd.Series:
        return pd.cut(price, [-float("inf"), 50_000, 150_000, float("inf")], labels=["low", "mid", "high"]).astype(object)

    return t(spark, d, "orders").select("o_orderkey", band("o_totalprice").alias("band"))


def f4_transform(spark, d):
    with_net = lambda df: df.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return t(spark, d, "lineitem").transform(with_net).select("l_orderkey", "l_linenumber", "net")


def f5_udtf(spark, d):
    """A Python table function, the engine's host of parsers: tokens of a type."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos int, token string")
    class Tokens:
        def eval(self, text: str):
            for k, word in enumerate((text or "").split(" ")):
                yield k, word

    spark.udtf.register("type_tokens", Tokens)
    t(spark, d, "part").createOrReplaceTempView("udtf_part")
    return spark.sql("SELECT p_partkey, k.pos, k.token FROM udtf_part, LATERAL type_tokens(p_type) AS k")


def path_confidence(spark, d):
    """Confidence of a two-step path: the product of its edges'."""
    l = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (1 - F.col("l_discount")).alias("c1"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_acctbal") > 0, 0.9).otherwise(0.5).alias("c2"))
    return l.join(s, "l_suppkey").groupBy("l_orderkey").agg(F.round(F.max(F.exp(F.log("c1") + F.log("c2"))), 6).alias("confidence"))


_WORDS = "unnest(string_split(p_type, ' ')) AS word, generate_subscripts(string_split(p_type, ' '), 1) - 1"

QUERIES = {
    "p1_select": (p1_select, "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, trunc(l_quantity)::INTEGER AS qty FROM lineitem"),
    "p2_select_expr": (p2_select_expr, "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, substr(o_orderpriority, 1, 1) AS prio FROM orders"),
    "p3_with_column": (p3_with_column, "SELECT p_partkey, p_size + 1 AS p_size, p_brand FROM part"),
    "p4_rename_drop": (p4_rename_drop, "SELECT s_suppkey, s_name AS supplier, s_nationkey FROM supplier"),
    "p6_filter": (p6_filter, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_returnflag IN ('A', 'R') AND l_discount BETWEEN 0.05 AND 0.07"),
    "p10_star_expand": (p10_star_expand, "SELECT *, upper(r_name) AS loud FROM region"),
    "p13_static_if": (p13_static_if, "SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, true), (5, false), (6, NULL), (7, true), (8, false)) v(id, truth)"),
    "p14_distinct_edges": (p14_distinct_edges, "SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem"),
    "s_strings": (s_strings, r"SELECT p_partkey, p_name || '-' || p_brand AS joined, upper(p_name) AS u, lower(p_type) AS l, substr(p_name, 2, 4) AS sub, length(p_name)::INTEGER AS len, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked, regexp_extract(p_brand, '(\d+)', 1) AS digits, p_name AS trimmed, p_name AS rt FROM part"),
    "s_dates": (s_dates, "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS dom, (dayofweek(o_orderdate) + 1)::INTEGER AS dow, hour(o_orderdate)::INTEGER AS h, minute(o_orderdate)::INTEGER AS mi, second(o_orderdate)::INTEGER AS s, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders"),
    "s_math": (s_math, "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice, 0) AS r, l_quantity AS a, floor(l_extendedprice / l_quantity)::BIGINT AS f, ceil(l_extendedprice / l_quantity)::BIGINT AS c, l_orderkey % 7 AS mod, pow(l_quantity, 2) AS sq, floor(l_extendedprice / l_quantity * 1000)::BIGINT AS div FROM lineitem"),
    "s_conditional": (s_conditional, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE c_mktsegment END AS seg, c_custkey % 3 = 0 AS gone, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, c_custkey::VARCHAR AS text, c_custkey = 1 AS nan FROM customer"),
    "s_arrays": (s_arrays, "SELECT l_orderkey, count(*)::INTEGER AS n, bool_or(l_partkey = 5) AS has, coalesce(string_agg(CASE WHEN l_partkey % 2 = 0 THEN l_partkey::VARCHAR END, ',' ORDER BY l_partkey), '') AS even, sum(l_partkey)::BIGINT AS total, max(l_partkey) AS last, count(DISTINCT l_partkey)::INTEGER AS kinds FROM lineitem GROUP BY 1"),
    "s_explode": (s_explode, f"SELECT p_partkey, pos::INTEGER AS pos, word FROM (SELECT p_partkey, {_WORDS} AS pos FROM part)"),
    "s_json": (s_json, "SELECT event_id, (props->>'k')::INTEGER AS k, '{\"k\":' || (props->>'k') || ',\"t\":\"' || event_type || '\"}' AS j FROM events"),
    "s_options": (s_options, "SELECT p_partkey, 'brand=' || p_brand || ';size=' || p_size AS options FROM part"),
    "s_hash": (s_hash, "SELECT p_partkey, substr(sha256('table::' || lower(p_name)), 1, 16) AS id, sha256(p_name) AS full, substr(sha256('table::.raw.' || lower(replace(p_name, ' ', '_'))), 1, 16) AS table_id FROM part"),
    "s_urls": (s_urls, _URLS),
    "s_runcycle": (s_runcycle, "SELECT * FROM (VALUES (1, 'daily', '', '30 5 * * *'), (2, 'weekly', 'MON,WED,FRI', '5 23 * * 1,3,5'), (3, 'weekly', 'MON,TUE,WED,THU,FRI', '0 0 * * 1,2,3,4,5'), (4, 'monthly', '', '0 12 15 * *'), (5, 'monthly', '', '0 0 1 * *'), (6, 'on_request', '', NULL), (7, 'yearly', '', '0 2 1 1 *'), (8, 'custom', '', NULL), (9, 'weekly', '', '0 4 * * 0')) v(id, frequency, days, cron)"),
    "s_times": (s_times, "SELECT * FROM (VALUES (1, '05:30'), (2, '05:30'), (3, '05:30'), (4, NULL), (5, NULL), (6, '23:59'), (7, NULL), (8, NULL)) v(id, time)"),
    "s_calendar": (s_calendar, "SELECT * FROM (VALUES (1, '2024-02-29'), (2, '2024-01-31'), (3, NULL), (4, NULL)) v(id, date)"),
    "s_jdbc": (s_jdbc, "SELECT * FROM (VALUES (1, 'postgresql', 'db.example.org', 5433, 'sales'), (2, 'sqlserver', 'sql1', NULL, 'crm'), (3, 'oracle', 'ora1', 1521, 'ORCL'), (4, 'mysql', 'my.example.org', NULL, 'shop')) v(id, class, host, port, database)"),
    "s_bracket_refs": (s_bracket_refs, "SELECT * FROM (VALUES (1, 'Sales|Profit ] Ratio', NULL, ''), (2, 'Region|Segment|Sales', 'FIXED', 'Region|Segment'), (3, 'A|B', NULL, ''), (4, '', NULL, '')) v(id, refs, lod, dims)"),
    "f1_pandas_udf": (f1_pandas_udf, "SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 150000 THEN 'mid' ELSE 'high' END AS band FROM orders"),
    "f4_transform": (f4_transform, "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "f5_udtf": (f5_udtf, f"SELECT p_partkey, pos::INTEGER AS pos, word AS token FROM (SELECT p_partkey, {_WORDS} AS pos FROM part)"),
    "path_confidence": (path_confidence, "SELECT l_orderkey, round(max((1 - l_discount) * CASE WHEN s_acctbal > 0 THEN 0.9 ELSE 0.5 END), 6) AS confidence FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1"),
}
