"""Parsers and what is built on them, over the package's own artefacts; SQL lineage; streaming operators in batch."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from ..operators import catalog, graph
from ..plans import estate
from ..plans.sql_lineage import lineage_frame
from ..plans.storage import written
from ..sinks.openlineage import run_events
from ..sources import logs, notebooks, orchestration, qlik, tableau, tws
from ..sources.artifacts import artifact_kind, entities, parse
from ..sources.connectors import derive_connection
from ..sources.pyspark_ast import parse_pyspark
from ..streaming import events as streaming
from .star import t

FIXTURES = Path(__file__).parent / "fixtures"


def _values(columns: str, *rows: tuple) -> str:
    """SQL of literal rows: what a query over a fixed artefact must give."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({columns})"


def _files(spark, *names):
    rows = [(n, (FIXTURES / n).read_text()) for n in names]
    return spark.createDataFrame(rows, "path string, content string")


SCRIPTS = {
    "ctas.sql": "CREATE TABLE mart.daily AS SELECT o.region, CAST(sum(o.amount) AS DOUBLE) AS total FROM raw.orders o LEFT JOIN dim.customers c ON o.customer_id = c.id GROUP BY o.region",
    "insert.sql": "INSERT OVERWRITE TABLE mart.copy (id, big) SELECT order_id, amount * 2 FROM raw.orders",
    "merge.sql": "MERGE INTO mart.summary t USING stage.summary s ON t.customer_id = s.customer_id WHEN MATCHED THEN UPDATE SET t.total = s.total WHEN NOT MATCHED THEN INSERT (customer_id, total) VALUES (s.customer_id, s.total)",
    "cte.sql": "WITH x AS (SELECT customer_id, amount, row_number() OVER (PARTITION BY customer_id ORDER BY amount DESC) AS rn FROM raw.orders) INSERT INTO mart.top SELECT customer_id, amount FROM x WHERE rn <= 3 UNION ALL SELECT customer_id, 0 FROM raw.closed",
    "sub.sql": "CREATE VIEW mart.v AS SELECT o.id, (SELECT max(p.day) FROM raw.pays p WHERE p.order_id = o.id) AS last_pay, (SELECT max(day) FROM raw.pays) AS newest FROM raw.orders o",
    "lateral.sql": "SELECT u.user_id, tag FROM raw.users u LATERAL VIEW OUTER explode(u.tags) x AS tag",
    "bad.sql": "SELEC nothing",
}


def l_targets_sources(spark, d):
    return lineage_frame(spark, SCRIPTS).filter("kind IN ('target', 'source')").select("path", "kind", F.coalesce("target", "name").alias("name"))


def l_derivations(spark, d):
    return lineage_frame(spark, SCRIPTS).filter("kind = 'derivation'").select("path", "target", "name", "sources", "via").distinct()


def l_warnings(spark, d):
    return lineage_frame(spark, SCRIPTS).filter("kind = 'warning'").select("path", "name")


def j5_join_keys(spark, d):
    return lineage_frame(spark, SCRIPTS).filter("kind = 'join_key'").select("path", F.col("name").alias("a"), F.col("sources").alias("b"))


def s1_format_detect(spark, d):
    rows = spark.createDataFrame([("a/job.py", "x = 1"), ("a/nb.py", "# Databricks notebook source\nx"), ("d/dag.py", "with DAG('x'):"), ("q.sql", ""), ("n.ipynb", "{}"), ("t.txt", "SCHEDULE A#B\n:\nEND"), ("t2.txt", "hello"), ("s.xml", "<jobstream/>"), ("w.json", '{"tasks": [{"task_key": "a"}]}'), ("z", "")], "path string, content string")
    return rows.select("path", artifact_kind(F.col("path"), F.col("content")).alias("kind"))


def _spark_rows(spark):
    return parse(_files(spark, "etl_job.py"), parse_pyspark)


def s2_pyspark_io(spark, d):
    rows = _spark_rows(spark)
    schema = "frame int, target string, klass string, server string, mode string"
    return entities(rows, "read", schema).withColumn("kind", F.lit("read")).unionByName(entities(rows, "write", schema).withColumn("kind", F.lit("write"))).select("kind", "target", "klass", "server", "mode")


def s2_pyspark_derivations(spark, d):
    rows = entities(_spark_rows(spark), "derivation", "frame int, `column` string, sources array<string>, via string")
    return rows.select("column", F.concat_ws(",", "sources").alias("sources"), "via")


def s2_pyspark_joins(spark, d):
    rows = entities(_spark_rows(spark), "step", "frame int, op string, kind string, how string, columns array<string>, other string, broadcast boolean")
    return rows.filter("kind = 'join'").select("how", F.concat_ws(",", "columns").alias("keys"), "other", F.coalesce("broadcast", F.lit(False)).alias("broadcast"))


def c10_collapse(spark, d):
    """Anchors of a script's frames: named, roots, forks; the others collapse into the anchor they feed."""
    rows = _spark_rows(spark)
    frames = entities(rows, "frame", "id int, name string, line int").select(F.col("id").cast("string").alias("id"), "name")
    edges = entities(rows, "edge", "src int, dst int").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("D").alias("rel"))
    found = graph.anchors(edges, frames, F.col("name").isNotNull())
    return found.groupBy("is_anchor").agg(F.count(F.lit(1)).alias("n"))


_NB = json.dumps({"metadata": {"language_info": {"name": "python"}}, "cells": [
    {"cell_type": "markdown", "source": "# t", "execution_count": None},
    {"cell_type": "code", "source": ["%matplotlib inline\n", "df = spark.table('a.b')"], "execution_count": 1},
    {"cell_type": "code", "source": "%%sql\nSELECT * FROM a.b", "execution_count": 5},
    {"cell_type": "code", "source": "df.write.saveAsTable('c.d')", "execution_count": 3},
]})
_DBX = "# Databricks notebook source\nx = spark.table('p.q')\n# COMMAND ----------\n# MAGIC %sql\n# MAGIC SELECT 1\n# COMMAND ----------\n# MAGIC %run ./helpers/load\n# COMMAND ----------\ndbutils.notebook.run(\"./next\", 60)\n"


def s4_notebook_cells(spark, d):
    cells = notebooks.jupyter_cells(spark.createDataFrame([("n.ipynb", _NB)], "path string, content string"))
    return cells.select("index", "language", F.trim(F.regexp_replace("source", "\n", " ")).alias("source"), "execution_count")


def s5_databricks_cells(spark, d):
    cells = notebooks.databricks_cells(spark.createDataFrame([("n.py", _DBX)], "path string, content string"))
    return cells.select("index", "language", F.regexp_replace("source", "\n", " ").alias("source"))


def s7_out_of_order(spark, d):
    return notebooks.out_of_order(notebooks.jupyter_cells(spark.createDataFrame([("n.ipynb", _NB)], "path string, content string")))


def s7_notebook_calls(spark, d):
    return notebooks.notebook_calls(notebooks.databricks_cells(spark.createDataFrame([("n.py", _DBX)], "path string, content string")))


def _commit(version, fields, time):
    schema = json.dumps({"type": "struct", "fields": [{"name": n, "type": ty, "nullable": nl} for n, ty, nl in fields]})
    path = f"/lake/orders/_delta_log/{version:020d}.json"
    return [(path, json.dumps({"commitInfo": {"timestamp": time, "operation": "WRITE"}})), (path, json.dumps({"metaData": {"schemaString": schema}}))]


def s9_delta_log(spark, d):
    lines = [*_commit(0, [("id", "long", False), ("amount", "integer", True)], 1000), *_commit(1, [("id", "long", False), ("amount", "integer", True), ("note", "string", True)], 2000), *_commit(2, [("id", "long", True), ("amount", "double", True)], 3000)]
    return logs.delta_schema_events(spark.createDataFrame(lines, "path string, value string"))


def _event_lines():
    sql = "org.apache.spark.sql.execution.ui."
    return [
        {"Event": sql + "SparkListenerSQLExecutionStart", "executionId": 0, "description": "show", "time": 100, "physicalPlanDescription": "Scan"},
        {"Event": "SparkListenerJobStart", "Job ID": 7, "Stage Infos": [{"Stage ID": 1, "Stage Name": "s", "Number of Tasks": 4, "Parent IDs": []}, {"Stage ID": 2, "Stage Name": "r", "Number of Tasks": 2, "Parent IDs": [1]}], "Properties": {"spark.sql.execution.id": "0"}},
        {"Event": sql + "SparkListenerSQLExecutionEnd", "executionId": 0, "time": 350},
        {"Event": sql + "SparkListenerSQLExecutionStart", "executionId": 1, "description": "save", "time": 400, "physicalPlanDescription": "Execute InsertIntoHadoopFsRelationCommand"},
    ]


def _log(spark):
    lines = [("app", json.dumps(x)) for x in _event_lines()] + [("app", "{broken")]
    return logs.event_log(spark.createDataFrame(lines, "path string, value string"))


def s10_event_log(spark, d):
    log = _log(spark)
    stages = log["stages"].join(log["jobs"], ["path", "job_id"])
    return stages.select("job_id", "stage_id", "n_tasks", F.size("parents").alias("n_parents"), "executionId")


def s10_executions(spark, d):
    log = _log(spark)
    out = log["executions"].select("executionId", "description", "duration_ms")
    return out.unionByName(log["diagnostics"].select(F.lit(None).cast("long").alias("executionId"), F.col("code").alias("description"), F.lit(None).cast("long").alias("duration_ms")))


def j18_correlate(spark, d):
    planned = spark.createDataFrame([("app", "q1", "sql", 3), ("app", "w1", "write", 9), ("app", "w2", "write", 12)], "path string, block string, kind string, line int")
    return logs.correlate(planned, _log(spark)["executions"]).select("block", "executionId")


_DAG = "from airflow import DAG\nwith DAG(dag_id='nightly', schedule='0 2 * * *') as dag:\n    a = BashOperator(task_id='load', bash_command='load.sh')\n    b = SparkSubmitOperator(task_id='shape', application='shape.py')\n    c = PythonOperator(task_id='tell')\n    a >> [b, c]\n    c.set_upstream(b)\n"


def s12_airflow(spark, d):
    rows = parse(spark.createDataFrame([("dag.py", _DAG)], "path string, content string"), orchestration.parse_airflow)
    return entities(rows, "dependency", "task string, upstream string").select("task", "upstream").unionByName(entities(rows, "task", "task string, operator string, target string").select("task", F.concat_ws(":", "operator", "target").alias("upstream")))


_FLOW = json.dumps({"settings": {"name": "daily", "schedule": {"quartz_cron_expression": "0 0 3 * * ?"}, "tasks": [{"task_key": "a", "notebook_task": {"notebook_path": "/n/load"}}, {"task_key": "b", "spark_python_task": {"python_file": "etl.py"}, "depends_on": [{"task_key": "a"}]}]}})


def s13_workflow(spark, d):
    rows = orchestration.workflow_tasks(spark.createDataFrame([("w.json", _FLOW)], "path string, content string"))
    return rows.select("workflow", "cron", "task", "kind", "target", F.concat_ws(",", "upstream").alias("upstream"))


_SUBMIT = "#!/bin/sh\nset -e\nspark-submit --master yarn --deploy-mode=cluster \\\n  --conf spark.sql.shuffle.partitions=64 --conf 'a.b=c d' jobs/etl.py --day '2026-01-01'\n"


def s14_spark_submit(spark, d):
    rows = parse(spark.createDataFrame([("run.sh", _SUBMIT)], "path string, content string"), orchestration.parse_spark_submit)
    out = entities(rows, "submit", "application string, args array<string>, conf map<string,string>, options map<string,string>")
    return out.select("application", F.concat_ws(" ", "args").alias("args"), F.col("conf")["a.b"].alias("conf"), F.col("options")["deploy-mode"].alias("mode"))


def s15_load_script(spark, d):
    rows = parse(_files(spark, "parcels.qvs"), lambda p, x: qlik.parse_load_script(p, x))
    return entities(rows, "edge", "src string, dst string, rel string, confidence double").filter(~F.contains("src", F.lit("."))).select("src", "dst", "rel", "confidence")


def c15_constraints(spark, d):
    rows = parse(_files(spark, "parcels.qvs"), lambda p, x: qlik.parse_load_script(p, x))
    return entities(rows, "constraint", "dataset string, kind string, columns array<string>, confidence double, references string").select("dataset", "kind", F.concat_ws(",", "columns").alias("columns"), "confidence", "references")


def s17_qvd_header(spark, d):
    text = b"<QvdTableHeader><TableName>Trips</TableName><NoOfRecords>3</NoOfRecords><Fields><QvdFieldHeader><FieldName>id</FieldName><NoOfSymbols>3</NoOfSymbols><BitWidth>2</BitWidth><BitOffset>0</BitOffset><Bias>0</Bias></QvdFieldHeader><QvdFieldHeader><FieldName>van</FieldName><NoOfSymbols>2</NoOfSymbols><BitWidth>1</BitWidth><BitOffset>2</BitOffset><Bias>0</Bias></QvdFieldHeader></Fields></QvdTableHeader>\x00\x01"
    h = qlik.qvd_header(text)
    return spark.createDataFrame([(h["table"], h["records"], f["name"], f["symbols"], f["unique"]) for f in h["fields"]], "name string, records int, field string, symbols int, is_unique boolean")


def s18_workbook(spark, d):
    rows = parse(_files(spark, "fleet.twb"), tableau.parse_workbook)
    return tableau.dashboard_tables(rows).select("dashboard", "worksheet", "table")


def c17_field_dependencies(spark, d):
    rows = parse(_files(spark, "fleet.twb"), tableau.parse_workbook)
    return tableau.field_dependencies(rows).select("field", "depends_on")


def j16_cross_source(spark, d):
    rows = parse(_files(spark, "fleet.twb"), tableau.parse_workbook)
    return tableau.cross_source_refs(rows).select("field", "to_source", "to_field")


def c21_coverage(spark, d):
    return entities(parse(_files(spark, "fleet.twb"), tableau.parse_workbook), "coverage", "tag string").select("tag")


def _tws(spark):
    return parse(_files(spark, "night.txt", "regulator.xml"), tws.parse_scheduler)


def s19_topology(spark, d):
    return tws.topology(_tws(spark))


def j12_follows(spark, d):
    rows = _tws(spark)
    edges, warnings = tws.dependencies(rows)
    names = entities(rows, "job", tws.JOB).select("id", F.concat_ws(".", "stream", "name").alias("name")).unionByName(entities(rows, "schedule", tws.SCHEDULE).select("id", "name")).distinct()
    out = edges.join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    return out.select("a", "b", "key").unionByName(warnings.select(F.col("code").alias("a"), F.col("detail").alias("b"), F.lit("").alias("key")))


def j14_event_rules(spark, d):
    return tws.triggered(_tws(spark)).agg(F.count(F.lit(1)).alias("n"))


def s25_connections(spark, d):
    cases = [("jdbc", {"url": "jdbc:postgresql://DB1/sales?user=u&password=p", "dbtable": "t"}), ("kafka", {"kafka.bootstrap.servers": "b2:9093,a1", "subscribe": "x"}), ("snowflake", {"sfUrl": "acme.example.com", "sfDatabase": "OPS"}), ("parquet", {"path": "s3a://lake/a/"}), ("mongodb", {"connection.uri": "mongodb://u:p@m1/shop.items", "collection": "items"}), ("mystery", {}), ("redis", {"host": "localhost", "table": "k"})]
    rows = []
    for fmt, options in cases:
        c = derive_connection(fmt, options)
        rows.append((fmt, c.klass, c.server, c.port, c.database, c.resolved, c.has_credentials))
    return spark.createDataFrame(rows, "format string, klass string, server string, port int, dbname string, resolved boolean, has_credentials boolean")


def _estate(spark):
    # Parsed once: each graph picks many kinds of entities out of its rows.
    sheets = parse(_files(spark, "fleet.twb"), tableau.parse_workbook)
    scripts = parse(_files(spark, "parcels.qvs"), lambda p, x: qlik.parse_load_script(p, x))
    code, jobs, sheets, scripts = (written(x, "parsed") for x in (_spark_rows(spark), _tws(spark), sheets, scripts))
    return estate.combine([estate.spark_graph(code), estate.scheduler_graph(jobs), estate.workbook_graph(sheets), estate.script_graph(scripts)])


_CHARTS = [("parcels.qvf", "ch1", "barchart", "Load by courier", json.dumps({"qHyperCube": {"qMeasures": [{"qDef": "Sum([TotalWeight])"}], "qDimensions": [{"qFieldDefs": ["[Zone]"]}]}}))]


_BUILT: dict[str, tuple] = {}


def _estate_full(spark):
    """The estate with app objects, SQL scripts, orchestration and logs; written once in an application."""
    app = spark.sparkContext.applicationId
    if app not in _BUILT:
        _BUILT.clear()
        _BUILT[app] = _build_estate(spark)
    return _BUILT[app]


def _build_estate(spark):
    scripts = written(parse(_files(spark, "parcels.qvs"), lambda p, x: qlik.parse_load_script(p, x)), "parsed")
    code, jobs, sheets = (written(x, "parsed") for x in (_spark_rows(spark), _tws(spark), parse(_files(spark, "fleet.twb"), tableau.parse_workbook)))
    charts = spark.createDataFrame(_CHARTS, "app string, qId string, qType string, qTitle string, qData string")
    one = lambda name, text: spark.createDataFrame([(name, text)], "path string, content string")
    parts = [
        estate.spark_graph(code),
        estate.scheduler_graph(jobs),
        estate.workbook_graph(sheets),
        estate.script_graph(scripts),
        estate.objects_graph(charts, scripts),
        estate.sql_graph(written(lineage_frame(spark, SCRIPTS), "parsed")),
        estate.orchestration_graph(written(parse(one("dag.py", _DAG), orchestration.parse_airflow), "parsed"), written(orchestration.workflow_tasks(one("w.json", _FLOW)), "parsed"), written(parse(one("run.sh", _SUBMIT), orchestration.parse_spark_submit), "parsed")),
        estate.runtime_graph(written(s9_delta_log(spark, None), "parsed"), written(_log(spark)["executions"], "parsed")),
    ]
    return estate.combine(parts)


def estate_columns(spark, d):
    """(label, column, source): what each column that scripts write to a table derives from in one step, by owner and name."""
    nodes, edges = _estate_full(spark)
    owner = edges.filter("rel IN ('HAS_COLUMN', 'HAS_FIELD', 'HAS_ATTRIBUTE')").select(F.col("src").alias("owner"), F.col("dst").alias("id"))
    named = nodes.filter("label = 'Attribute'").join(owner, "id").join(nodes.select(F.col("id").alias("owner"), F.col("label").alias("of"), F.col("name").alias("owner_name")), "owner")
    named = named.filter("of IN ('Table', 'Dataset')").select("id", F.concat_ws(".", F.lower("owner_name"), F.lower("name")).alias("name"))
    closed = graph.reach_from_each(edges.filter("rel = 'DERIVES_FROM'"), named.select("id"), None).filter("depth > 0")
    both = closed.join(named.select(F.col("id").alias("root"), F.col("name").alias("column")), "root").join(named.withColumnRenamed("name", "source"), "id")
    return both.select("column", "source").distinct()


def estate_rels(spark, d):
    return _estate_full(spark)[1].groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def preset_cross_tool(spark, d):
    nodes, edges = _estate_full(spark)
    found = catalog.run_preset("cross-tool", nodes, edges)
    for c in ("dashboard", "worksheet", "attribute", "table", "script"):
        found = found.join(nodes.select(F.col("id").alias(c), F.lower("name").alias(f"{c}_name")), c)
    return found.select(*[F.col(f"{c}_name").alias(c) for c in ("dashboard", "worksheet", "attribute", "table", "script")]).distinct()


def preset_chart_lineage(spark, d):
    nodes, edges = _estate_full(spark)
    found = catalog.run_preset("qlikview-chart-lineage", nodes, edges)
    for c in ("chart", "attribute", "source", "table"):
        found = found.join(nodes.select(F.col("id").alias(c), F.lower("name").alias(f"{c}_name")), c)
    return found.select(*[F.col(f"{c}_name").alias(c) for c in ("chart", "attribute", "source", "table")]).distinct()


def preset_lineage_upstream(spark, d):
    """Names along the shortest trails from a dashboard; relations between connections and frames are not walked."""
    nodes, edges = _estate_full(spark)
    board = nodes.filter("label = 'TableauDashboard'").first()["id"]
    ends = catalog.run_preset("lineage-upstream", nodes, edges, id=board, depth=3).select("depth", F.col("node").alias("id")).distinct()
    return ends.join(nodes, "id").groupBy("depth", "label").agg(F.count(F.lit(1)).alias("n"))


def preset_physical_tables(spark, d):
    nodes, edges = _estate_full(spark)
    found = catalog.run_preset("tableau-physical-tables", nodes, edges)
    return found.join(nodes.select(F.col("id").alias("table"), F.lower("name").alias("name")), "table").select("name").distinct()


def l5_recursive(spark, d):
    sql = {"r.sql": "WITH RECURSIVE t AS (SELECT id, boss AS up FROM staff UNION ALL SELECT s.id, s.boss FROM staff s JOIN t ON s.boss = t.id) SELECT id FROM t", "n.sql": "WITH t AS (SELECT id FROM staff) SELECT id FROM t"}
    return lineage_frame(spark, sql).filter("via = 'recursive_cte'").select("path", "name", "sources")


def estate_answer(spark, d):
    """From dashboard to table, script, job, schedule and start time, across four kinds of artefact."""
    return estate.answer(*_estate(spark))


def estate_labels(spark, d):
    nodes, _ = _estate(spark)
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def k3_openlineage(spark, d):
    rows = run_events(_spark_rows(spark), "2026-01-01T00:00:00Z")
    e = F.from_json("event", "eventType string, run struct<runId: string>, inputs array<struct<namespace: string, name: string>>, outputs array<struct<name: string>>")
    out = rows.select("path", e.alias("e"))
    return out.select("path", "e.eventType", F.length("e.run.runId").alias("id_length"), F.concat_ws(",", "e.inputs.name").alias("inputs"), F.concat_ws(",", "e.outputs.name").alias("outputs"))


def t_windowed_counts(spark, d):
    out = streaming.windowed_counts(t(spark, d, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", "total")


def t_sessions(spark, d):
    out = streaming.session_counts(t(spark, d, "events"))
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


_SESSIONS = """
WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k"""


QUERIES = {
    "l1_targets_sources": (l_targets_sources, _values("path, kind, name", ("ctas.sql", "target", "mart.daily"), ("ctas.sql", "source", "raw.orders"), ("ctas.sql", "source", "dim.customers"), ("insert.sql", "target", "mart.copy"), ("insert.sql", "source", "raw.orders"), ("merge.sql", "target", "mart.summary"), ("merge.sql", "source", "stage.summary"), ("cte.sql", "target", "mart.top"), ("cte.sql", "source", "raw.orders"), ("cte.sql", "source", "raw.closed"), ("sub.sql", "target", "mart.v"), ("sub.sql", "source", "raw.pays"), ("sub.sql", "source", "raw.orders"), ("lateral.sql", "source", "raw.users"))),
    "l8_derivations": (l_derivations, _values("path, target, name, sources, via", ("ctas.sql", "mart.daily", "region", "o.region", "select"), ("ctas.sql", "mart.daily", "total", "o.amount", "select"), ("insert.sql", "mart.copy", "id", "order_id", "select"), ("insert.sql", "mart.copy", "big", "amount", "select"), ("merge.sql", "mart.summary", "total", "s.total", "merge_update"), ("merge.sql", "mart.summary", "customer_id", "s.customer_id", "merge_insert"), ("merge.sql", "mart.summary", "total", "s.total", "merge_insert"), ("cte.sql", "mart.top", "customer_id", "customer_id", "select"), ("cte.sql", "mart.top", "amount", "amount", "select"), ("cte.sql", "mart.top", "rn", "amount,customer_id", "window"), ("sub.sql", "mart.v", "id", "o.id", "select"), ("sub.sql", "mart.v", "last_pay", "p.day", "correlated_subquery"), ("sub.sql", "mart.v", "newest", "day", "scalar_subquery"), ("lateral.sql", None, "user_id", "u.user_id", "select"), ("lateral.sql", None, "tag", "tag", "select"), ("lateral.sql", None, "tag", "u.tags", "lateral_view"))),
    "l10_warnings": (l_warnings, _values("path, name", ("bad.sql", "parse_error"))),
    "j5_join_keys": (j5_join_keys, _values("path, a, b", ("ctas.sql", "o.customer_id", "c.id"), ("merge.sql", "t.customer_id", "s.customer_id"))),
    "s1_format_detect": (s1_format_detect, _values("path, kind", ("a/job.py", "pyspark"), ("a/nb.py", "databricks"), ("d/dag.py", "airflow"), ("q.sql", "sparksql"), ("n.ipynb", "notebook"), ("t.txt", "composer"), ("t2.txt", "unknown"), ("s.xml", "scheduler_xml"), ("w.json", "workflow"), ("z", "unknown"))),
    "s2_pyspark_io": (s2_pyspark_io, _values("kind, target, klass, server, mode", ("read", "s3a://lake/prod/shipments/", "s3", "lake", None), ("read", "prod.dim.carriers", "hive", "metastore", None), ("read", "daily", "postgresql", "rates-db", None), ("read", "s3a://archive/top/", "s3", "archive", None), ("read", "events", "kafka", "k1", None), ("write", "mart.shipments_priced", "hive", "metastore", "overwrite"), ("write", "s3a://gold/top/", "s3", "gold", "append"), ("write", "mart.events", "hive", "metastore", "append"))),
    "s2_pyspark_derivations": (s2_pyspark_derivations, _values('"column", sources, via', ("cost", "kg,rate", "select"), ("class", "kg", "udf"), ("total_cost", "cost", "aggregate"), ("n", "shipment_id", "aggregate"))),
    "s2_pyspark_joins": (s2_pyspark_joins, _values("how, keys, other, broadcast", ("left", "carrier_id,id", "carriers", True), ("inner", "currency", "rates", False))),
    "c10_collapse": (c10_collapse, _values("is_anchor, n", (True, 12), (False, 5))),
    "s4_notebook_cells": (s4_notebook_cells, _values('"index", language, source, execution_count', (1, "python", "df = spark.table('a.b')", 1), (2, "sql", "SELECT * FROM a.b", 5), (3, "python", "df.write.saveAsTable('c.d')", 3))),
    "s5_databricks_cells": (s5_databricks_cells, _values('"index", language, source', (0, "python", "x = spark.table('p.q')"), (1, "sql", "SELECT 1"), (2, "run", "%run ./helpers/load"), (3, "python", 'dbutils.notebook.run("./next", 60)'))),
    "s7_out_of_order": (s7_out_of_order, _values('path, "index", execution_count, before', ("n.ipynb", 3, 3, 5))),
    "s7_notebook_calls": (s7_notebook_calls, _values("path, target", ("n.py", "./helpers/load"), ("n.py", "./next"))),
    "s9_delta_log": (s9_delta_log, _values('table_fqn, version, kind, "column", from_type, to_type, from_nullable, to_nullable, timestamp_ms', ("orders", 0, "table_created", None, None, None, None, None, 1000), ("orders", 1, "column_added", "note", None, "string", None, True, 2000), ("orders", 2, "column_dropped", "note", "string", None, True, None, 3000), ("orders", 2, "type_changed", "amount", "integer", "double", True, True, 3000), ("orders", 2, "nullability_changed", "id", "long", "long", False, True, 3000))),
    "s10_event_log": (s10_event_log, _values('job_id, stage_id, n_tasks, n_parents, "executionId"', (7, 1, 4, 0, 0), (7, 2, 2, 1, 0))),
    "s10_executions": (s10_executions, _values('"executionId", description, duration_ms', (0, "show", 250), (1, "save", None), (None, "malformed_line", None))),
    "j18_correlate": (j18_correlate, _values('block, "executionId"', ("q1", 0), ("w1", 1), ("w2", None))),
    "s12_airflow": (s12_airflow, _values("task, upstream", ("shape", "load"), ("tell", "load"), ("tell", "shape"), ("load", "BashOperator:load.sh"), ("shape", "SparkSubmitOperator:shape.py"), ("tell", "PythonOperator"))),
    "s13_workflow": (s13_workflow, _values("workflow, cron, task, kind, target, upstream", ("daily", "0 0 3 * * ?", "a", "notebook", "/n/load", ""), ("daily", "0 0 3 * * ?", "b", "python", "etl.py", "a"))),
    "s14_spark_submit": (s14_spark_submit, _values("application, args, conf, mode", ("jobs/etl.py", "--day 2026-01-01", "c d", "cluster"))),
    "s15_load_script": (s15_load_script, _values("src, dst, rel, confidence", ("ZoneMap", "zones.csv", "SOURCED_FROM", 1.0), ("Courier", "OPS.MAIN.COURIER", "SOURCED_FROM", 1.0), ("Parcels", "parcels.qvd", "SOURCED_FROM", 1.0), ("Parcels", "old_x.qvd", "SOURCED_FROM", 0.9), ("Parcels", "old_y.qvd", "SOURCED_FROM", 0.9), ("ByCourier", "Parcels", "DERIVES_FROM", 0.95), ("ByCourier", "Courier", "JOINS", 0.85), ("ByCourier", "ByCourier.qvd", "STORED_AS", 1.0))),
    "c15_constraints": (c15_constraints, _values('dataset, kind, columns, confidence, "references"', ('ByCourier', 'foreign_key', 'CourierID', 0.6, 'Courier'), ('ByCourier', 'foreign_key', 'CourierName', 0.6, 'Courier'), ('ByCourier', 'primary_key', 'CourierID', 0.4, None), ('ByCourier', 'synthetic_key', 'CourierID,CourierName', 0.55, None), ('Courier', 'foreign_key', 'CourierID', 0.5, 'Parcels'), ('Courier', 'foreign_key', 'CourierName', 0.5, 'ByCourier'), ('Courier', 'primary_key', 'CourierID', 0.4, None), ('Courier', 'synthetic_key', 'CourierID,CourierName', 0.55, None), ('Parcels', 'foreign_key', 'CourierID', 0.5, 'Courier'), ('Parcels', 'primary_key', 'CourierID', 0.4, None), ('Parcels', 'primary_key', 'ParcelID', 0.4, None))),
    "s17_qvd_header": (s17_qvd_header, _values("name, records, field, symbols, is_unique", ("Trips", 3, "id", 3, True), ("Trips", 3, "van", 2, False))),
    "s18_workbook": (s18_workbook, _values('dashboard, worksheet, "table"', ("Fleet Board", "Trips", "OPS.main.trips"), ("Fleet Board", "Trips", "OPS.main.vans"), ("Fleet Board", "Costs", "mart.shipments_priced"))),
    "c17_field_dependencies": (c17_field_dependencies, _values("field, depends_on", ("Calc_1", "km"), ("Calc_1", "van"), ("Calc_2", "Calc_1"), ("Calc_9", "cost"))),
    "j16_cross_source": (j16_cross_source, _values("field, to_source, to_field", ("Calc_2", "Parameters", "Parameter 1"), ("Calc_9", "federated.fleet", "km"))),
    "c21_coverage": (c21_coverage, _values("tag", ("mystery-tag",))),
    "s19_topology": (s19_topology, _values("kind, n", ("workstation", 3), ("schedule", 3), ("job", 7), ("calendar", 1), ("resource", 1), ("prompt", 1), ("event_rule", 1))),
    "j12_follows": (j12_follows, _values("a, b, key", ("INTAKE.CHECK", "INTAKE.FETCH", "SUCC"), ("REPORTS", "INTAKE", ""), ("REPORTS.CHECK", "INTAKE.CHECK", "RC=0"), ("REPORTS.SEND", "REPORTS.CHECK", ""), ("WEEKLY.SEND_FILE", "WEEKLY.BALANCE", ""), ("unresolved_follows", "NODE_B#REPORTS.NOBODY", ""))),
    "j14_event_rules": (j14_event_rules, _values("n", (1,))),
    "s25_connections": (s25_connections, _values("format, klass, server, port, dbname, resolved, has_credentials", ("jdbc", "postgresql", "db1", 5432, "sales", True, True), ("kafka", "kafka", "a1", 9092, "", True, False), ("snowflake", "snowflake", "acme.example.com", 443, "OPS", True, False), ("parquet", "s3", "lake", None, "", True, False), ("mongodb", "mongodb", "m1", 27017, "shop", True, False), ("mystery", "unknown:mystery", "", None, "", False, False), ("redis", "redis", "localhost", 6379, "", True, False))),
    "estate_answer": (estate_answer, _values('dashboard, "table", script, job, schedule, start_time', ("Fleet Board", "mart.shipments_priced", "etl_job.py", "SEND", "REPORTS", "05:00"), ("Fleet Board", "mart.shipments_priced", "etl_job.py", "BALANCE", "WEEKLY", "23:00"))),
    "estate_labels": (estate_labels, _values('label, n', ('Attribute', 86), ('Connection', 7), ('DataFrame', 17), ('Dataset', 4), ('FileWatcher', 2), ('Job', 7), ('QlikScript', 1), ('Resource', 1), ('Schedule', 3), ('Script', 7), ('SparkScript', 1), ('Table', 16), ('TableauDashboard', 1), ('TableauDatasource', 3), ('TableauWorkbook', 1), ('TableauWorksheet', 2), ('Workstation', 3))),
    "estate_columns": (estate_columns, _values('"column", source', ("bycourier.courierid", "old_x.qvd.courierid"), ("bycourier.courierid", "old_y.qvd.courierid"), ("bycourier.courierid", "parcels.courierid"), ("bycourier.courierid", "parcels.qvd.courierid"), ("bycourier.couriername", "courier.couriername"), ("bycourier.couriername", "ops.main.courier.couriername"), ("bycourier.n", "old_x.qvd.parcelid"), ("bycourier.n", "old_y.qvd.parcelid"), ("bycourier.n", "parcels.parcelid"), ("bycourier.n", "parcels.qvd.parcelid"), ("bycourier.totalweight", "old_x.qvd.weight"), ("bycourier.totalweight", "old_y.qvd.weight"), ("bycourier.totalweight", "parcels.qvd.weight"), ("bycourier.totalweight", "parcels.weight"), ("courier.courierid", "ops.main.courier.courierid"), ("courier.couriername", "ops.main.courier.couriername"), ("courier.zone", "ops.main.courier.zonecode"), ("courier.zonecode", "ops.main.courier.zonecode"), ("mart.copy.big", "raw.orders.amount"), ("mart.copy.id", "raw.orders.order_id"), ("mart.shipments_priced.class", "daily.kg"), ("mart.shipments_priced.class", "prod.dim.carriers.kg"), ("mart.shipments_priced.class", "s3a://lake/prod/shipments/.kg"), ("mart.shipments_priced.cost", "daily.kg"), ("mart.shipments_priced.cost", "daily.rate"), ("mart.shipments_priced.cost", "prod.dim.carriers.kg"), ("mart.shipments_priced.cost", "prod.dim.carriers.rate"), ("mart.shipments_priced.cost", "s3a://lake/prod/shipments/.kg"), ("mart.shipments_priced.cost", "s3a://lake/prod/shipments/.rate"), ("mart.summary.customer_id", "stage.summary.customer_id"), ("mart.summary.total", "stage.summary.total"), ("parcels.courierid", "old_x.qvd.courierid"), ("parcels.courierid", "old_y.qvd.courierid"), ("parcels.courierid", "parcels.qvd.courierid"), ("parcels.fee", "parcels.qvd.weight"), ("parcels.parcelid", "old_x.qvd.parcelid"), ("parcels.parcelid", "old_y.qvd.parcelid"), ("parcels.parcelid", "parcels.qvd.parcelid"), ("parcels.weight", "old_x.qvd.weight"), ("parcels.weight", "old_y.qvd.weight"), ("parcels.weight", "parcels.qvd.weight"), ("zonemap.zonecode", "zones.csv.zonecode"), ("zonemap.zonename", "zones.csv.zonename"))),
    "estate_rels": (estate_rels, _values('rel, n', ('CONTAINS_DATAFRAME', 17), ('CONTAINS_DATASOURCE', 3), ('CONTAINS_EXECUTION', 2), ('CONTAINS_JOB', 12), ('CONTAINS_TABLE', 4), ('DEPENDS_ON', 9), ('DERIVES_FROM', 90), ('DERIVES_FROM_DATAFRAME', 15), ('DISPLAYS_WORKSHEET', 2), ('EXECUTES', 12), ('FEEDS_OBJECT', 2), ('HAS_ATTRIBUTE', 14), ('HAS_COLUMN', 53), ('HAS_FIELD', 41), ('HAS_SCHEMA_EVENT', 5), ('INVOKES_FILE', 2), ('MAPS_TO', 1), ('PROVIDES_DATAFRAME', 5), ('READS_DATASOURCE', 2), ('READS_TABLE', 17), ('REFERENCES_FK', 1), ('REQUIRES_RESOURCE', 2), ('RUNS_ON', 7), ('SOURCED_FROM', 3), ('STORED_AS', 1), ('USES_FIELD', 10), ('WAITS_FOR_FILE', 2), ('WRITES_TABLE', 8), ('WRITES_TO_CONNECTION', 3))),
    "preset_cross_tool": (preset_cross_tool, _values('dashboard, worksheet, attribute, "table", script', ("fleet board", "costs", "cost", "mart.shipments_priced", "etl_job.py"))),
    "preset_chart_lineage": (preset_chart_lineage, _values('chart, attribute, source, "table"', ("load by courier", "totalweight", "weight", "old_x.qvd"), ("load by courier", "totalweight", "weight", "old_y.qvd"), ("load by courier", "totalweight", "weight", "parcels.qvd"), ("load by courier", "zone", "zonecode", "ops.main.courier"))),
    "preset_lineage_upstream": (preset_lineage_upstream, _values('depth, label, n', (1, 'TableauWorksheet', 2), (2, 'Attribute', 8), (3, 'Attribute', 6))),
    "preset_physical_tables": (preset_physical_tables, _values('name', ('mart.shipments_priced',), ('ops.main.trips',), ('ops.main.vans',))),
    "l5_recursive": (l5_recursive, _values('path, name, sources', ("r.sql", "id", "id"), ("r.sql", "up", "up"))),
    "k3_openlineage": (k3_openlineage, _values('path, "eventType", id_length, inputs, outputs', ("etl_job.py", "COMPLETE", 36, "daily,events,prod.dim.carriers,s3a://archive/top/,s3a://lake/prod/shipments/", "mart.events,mart.shipments_priced,s3a://gold/top/"))),
    "t_windowed_counts": (t_windowed_counts, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"),
    "t_sessions": (t_sessions, _SESSIONS),
}
