"""Projects of several files, traced columns, and operators on what they give."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import graph
from ..plans.sql_lineage import custom_sql_tables, expanded_sources, extract_lineage, lineage_frame, traced_columns
from ..sources import project, qlik, spark_ui, tws
from ..sources.artifacts import entities, parse
from ..sources.pyspark_ast import parse_pyspark
from .artifact_queries import SCRIPTS, _files, _spark_rows, _tws, _values

_PROJECT = {
    "app/main.py": "from app.util import load\nfrom . import helpers\nimport app.missing\nimport os\ndf = load('orders')\ndf.write.saveAsTable('m.orders')\n",
    "app/util/__init__.py": "from .io import load\ndef load(n):\n    return spark.table(f'raw.{n}')\n",
    "app/util/io.py": "from app.main import df\ndef load(n):\n    return spark.table(n)\n",
    "app/helpers.py": "import app.util\n",
    "app/__init__.py": "",
}


def s8_import_edges(spark, d):
    files = spark.createDataFrame(list(_PROJECT.items()), "path string, content string")
    return project.import_edges(files).select("src", "dst", "symbol")


def s8_project_closure(spark, d):
    files = spark.createDataFrame(list(_PROJECT.items()), "path string, content string")
    edges = project.import_edges(files).filter("dst IS NOT NULL")
    return graph.reach(edges, spark.createDataFrame([("app/main.py",)], "id string"), project.MAX_DEPTH, "out")


def s8_cross_file_lineage(spark, d):
    rows = [(p, k, x.get("target") or x.get("code")) for p, found in project.parse_project(_PROJECT, "app/main.py").items() for k, x in found if k in ("read", "write", "diagnostic")]
    return spark.createDataFrame(rows, "path string, kind string, detail string")


def s11_spark_ui(spark, d):
    pages = {"sql": [{"id": 4, "description": "save", "duration": 12, "planDescription": "Execute", "status": "COMPLETED"}], "jobs": [{"jobId": 1, "status": "SUCCEEDED", "stageIds": [2, 3]}], "stages": [{"stageId": 2, "name": "a", "numTasks": 5, "status": "COMPLETE"}, {"stageId": 3, "name": "b", "numTasks": 1, "status": "COMPLETE"}]}
    found = spark_ui.runtime(spark, "http://history", "app-1", lambda url: json.dumps(pages[url.rsplit("/", 1)[-1]]))
    stages = found["jobs"].select("job_id", F.explode("stages").alias("stage_id")).join(found["stages"], "stage_id")
    return stages.select("job_id", "stage_id", "n_tasks")


def s16_server_tasks(spark, d):
    text = '<Server><Task name="Load" document="a.qvw"><Trigger type="schedule" schedule="daily"/></Task><Task name="Report" document="b.qvw"><Trigger type="edx" after="LOAD"/></Task></Server>'
    rows = parse(spark.createDataFrame([("s.xml", text)], "path string, content string"), qlik.server_tasks)
    return entities(rows, "edge", "src string, dst string, rel string, confidence double").select("src", "dst", "rel", "confidence")


def s21_sense_objects(spark, d):
    objects = spark.createDataFrame([("o1", "barchart", "Weights", json.dumps({"qDef": "Sum(Weight) / Count(ParcelID)"})), ("o2", "table", "Couriers", json.dumps({"qFieldDefs": ["[couriername]"]}))], "qId string, qType string, qTitle string, qData string")
    rows = parse(_files(spark, "parcels.qvs"), lambda p, x: qlik.parse_load_script(p, x))
    return qlik.feeds_objects(qlik.sense_fields(objects), entities(rows, "attribute", "dataset string, name string"))


def s27_unresolved_io(spark, d):
    text = "import os\na = spark.read.parquet(os.environ['IN'])\nb = spark.read.parquet(dbutils.secrets.get('s', 'k'))\nc = spark.read.parquet(dbutils.widgets.get('p'))\nd = spark.read.parquet(pick())\n"
    rows = parse(spark.createDataFrame([("x.py", text)], "path string, content string"), parse_pyspark)
    return entities(rows, "read", "line int, unresolved_source string").select("line", "unresolved_source")


def c2_call_cycles(spark, d):
    text = "def a():\n    b()\ndef b():\n    c()\ndef c():\n    a()\ndef e():\n    a()\n"
    rows = parse(spark.createDataFrame([("x.py", text)], "path string, content string"), parse_pyspark)
    calls = entities(rows, "call", "caller string, callee string")
    return graph.on_cycles(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), 10)


def c12_variable_links(spark, d):
    v = spark.createDataFrame([("vA", "1"), ("vB", "$(vA) + 1"), ("vC", "$(VB) * $(vA)"), ("vD", "$(nothing)")], "name string, value string")
    return qlik.variable_links(v).select("src", "dst")


def c13_binary_inheritance(spark, d):
    datasets = spark.createDataFrame([("a.qvw", "T1"), ("b.qvw", "T2"), ("c.qvw", "T3")], "path string, name string")
    binaries = spark.createDataFrame([("b.qvw", "a.qvw"), ("c.qvw", "b.qvw"), ("a.qvw", "c.qvw")], "path string, source string")
    return qlik.inherited(datasets, binaries).filter("path = 'c.qvw'").select("name", "origin", "depth")


def l11_temp_views(spark, d):
    rows = _spark_rows(spark)
    sql = {r["path"]: r["text"] for r in entities(rows, "sql", "text string").collect()}  # one statement a script here
    sources = lineage_frame(spark, sql).filter("kind = 'source'").select("path", "name")
    frames = entities(rows, "edge", "src int, dst int")
    reads = entities(rows, "read", "frame int, target string").select(F.col("frame").cast("string").alias("id"), "target")
    views = entities(rows, "view", "frame int, name string").select("path", F.col("name").alias("view"), "frame")
    up = graph.reach_from_each(frames.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("D").alias("rel")), views.select(F.col("frame").cast("string").alias("id")), 20, "in")
    backing = up.join(reads, "id").select(F.lit("etl_job.py").alias("path"), F.col("root").cast("int").alias("frame"), F.col("target").alias("name"))
    return expanded_sources(sources, views, backing)


def l12_custom_sql(spark, d):
    sql = "WITH c AS (SELECT van, cost FROM ops.main.costs) SELECT c.van, t.km FROM c JOIN ops.main.trips t ON t.van = C.van JOIN Ops.Main.Costs z ON z.van = c.van"
    return spark.createDataFrame([(x,) for x in custom_sql_tables(spark, sql)], "name string").distinct()


def l13_traced_columns(spark, d):
    sql = "WITH c AS (SELECT van, sum(cost) AS spent FROM main.costs GROUP BY van), u AS (SELECT van, spent FROM c UNION ALL SELECT van, fee FROM main.fees) SELECT u.van, u.spent / t.km AS rate, (SELECT max(day) FROM main.fees) AS newest, 1 AS one FROM u JOIN main.trips t ON t.van = u.van"
    return traced_columns(spark, sql, {"main.costs": "van string, cost double", "main.fees": "van string, fee double, day date", "main.trips": "van string, km double"})


def p11_confidence(spark, d):
    rows = [(p, x.target_column, x.via, x.confidence) for p in ("ctas.sql", "insert.sql", "sub.sql") for x in extract_lineage(spark, SCRIPTS[p]).derivations]
    return spark.createDataFrame(rows, "path string, name string, via string, confidence double").distinct()


def j13_local_follows(spark, d):
    rows = _tws(spark)
    names = entities(rows, "job", tws.JOB).select("id", F.concat_ws(".", "stream", "name").alias("name")).distinct()
    out = tws.local_dependencies(rows).join(names.toDF("job_id", "a"), "job_id").join(names.toDF("depends_on", "b"), "depends_on")
    return out.select("a", "b")


def c22_run_cycles(spark, d):
    return tws.cycles(_tws(spark)).select("name", "frequency", F.concat_ws(",", "days").alias("days"), "cron")


def s_script_parts(spark, d):
    return tws.commands(_tws(spark)).select("path", "args", "kind")


QUERIES = {
    "p11_confidence": (p11_confidence, _values("path, name, via, confidence", ("ctas.sql", "region", "select", 1.0), ("ctas.sql", "total", "select", 0.8), ("insert.sql", "id", "select", 1.0), ("insert.sql", "big", "select", 0.8), ("sub.sql", "id", "select", 1.0), ("sub.sql", "last_pay", "correlated_subquery", 0.3), ("sub.sql", "newest", "scalar_subquery", 0.3))),
    "j13_local_follows": (j13_local_follows, _values("a, b", ("INTAKE.CHECK", "INTAKE.FETCH"), ("REPORTS.SEND", "REPORTS.CHECK"), ("WEEKLY.SEND_FILE", "WEEKLY.BALANCE"))),
    "c22_run_cycles": (c22_run_cycles, _values("name, frequency, days, cron", ("DAILY", "daily", "", "30 1 * * *"), ("DESK", "custom", "", None), ("MON_WED_FRI", "weekly", "MON,WED,FRI", "0 5 * * 1,3,5"), ("WEEKDAYS", "weekly", "MON,TUE,WED,THU,FRI", "0 23 * * 1,2,3,4,5"))),
    "s_script_parts": (s_script_parts, _values("path, args, kind", ("/jobs/fetch.sh", "parcels", "shell"), ("/jobs/check.sh", "", "shell"), ("/jobs/tidy.sh", "", "shell"), ("/jobs/report_check.sh", "", "shell"), ("/jobs/spark-submit.sh", "etl_job.py --day 1", "shell"), ("/jobs/submit.sh", "etl_job.py --weekly", "shell"), ("/jobs/send.sh", "", "shell"))),
    "s8_import_edges": (s8_import_edges, _values("src, dst, symbol", ("app/main.py", "app/util/__init__.py", "load"), ("app/main.py", "app/helpers.py", "helpers"), ("app/main.py", None, ""), ("app/util/__init__.py", "app/util/io.py", "load"), ("app/util/io.py", "app/main.py", "df"), ("app/helpers.py", "app/util/__init__.py", ""))),
    "s8_project_closure": (s8_project_closure, _values("id, depth", ("app/util/__init__.py", 1), ("app/helpers.py", 1), ("app/util/io.py", 2))),
    "s8_cross_file_lineage": (s8_cross_file_lineage, _values("path, kind, detail", ("app/main.py", "read", "raw.orders"), ("app/main.py", "write", "m.orders"), ("app/main.py", "diagnostic", "import_missing"))),
    "s11_spark_ui": (s11_spark_ui, _values("job_id, stage_id, n_tasks", (1, 2, 5), (1, 3, 1))),
    "s16_server_tasks": (s16_server_tasks, _values("src, dst, rel, confidence", ("Load", "Report", "TRIGGERS", 0.9))),
    "s21_sense_objects": (s21_sense_objects, _values("object, dataset, attribute", ("o1", "Parcels", "Weight"), ("o1", "Parcels", "ParcelID"), ("o2", "Courier", "CourierName"), ("o2", "ByCourier", "CourierName"))),
    "s27_unresolved_io": (s27_unresolved_io, _values("line, unresolved_source", (2, "env"), (3, "secret"), (4, "runtime"), (5, "dynamic"))),
    "c2_call_cycles": (c2_call_cycles, _values("id", ("a",), ("b",), ("c",))),
    "c12_variable_links": (c12_variable_links, _values("src, dst", ("vB", "vA"), ("vC", "vB"), ("vC", "vA"))),
    "c13_binary_inheritance": (c13_binary_inheritance, _values("name, origin, depth", ("T3", "c.qvw", 0), ("T2", "b.qvw", 1), ("T1", "a.qvw", 2))),
    "l11_temp_views": (l11_temp_views, _values("path, name", ("etl_job.py", "s3a://lake/prod/shipments/"), ("etl_job.py", "prod.dim.carriers"), ("etl_job.py", "daily"))),
    "l12_custom_sql": (l12_custom_sql, _values("name", ("OPS.MAIN.COSTS",), ("OPS.MAIN.TRIPS",))),
    "l13_traced_columns": (l13_traced_columns, _values('"column", "table", source', ("van", "main.costs", "van"), ("van", "main.fees", "van"), ("rate", "main.costs", "cost"), ("rate", "main.fees", "fee"), ("rate", "main.trips", "km"), ("newest", "main.fees", "day"), ("one", None, None))),
}
