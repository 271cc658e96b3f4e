"""Runtime logs: Delta commit logs as schema changes, Spark event logs as executions, jobs, stages and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import schema_changes

_COMMIT = "commitInfo struct<timestamp: long, operation: string>, metaData struct<schemaString: string>"
_FIELDS = "fields array<struct<name: string, type: string, nullable: boolean>>"


def delta_schema_events(lines: DataFrame) -> DataFrame:
    """Schema changes between commits, from log lines (path, value); also the commit's time and the creation.

    (table_fqn, version, kind, column, from_type, to_type, from_nullable, to_nullable, timestamp_ms)
    """
    parts = lines.select(
        F.regexp_extract("path", r"([^/]+)/_delta_log/", 1).alias("table_fqn"),
        F.regexp_extract("path", r"_delta_log/0*(\d+)\.json$", 1).alias("v"),
        F.from_json("value", _COMMIT).alias("c"),
    )
    parts = parts.filter("v <> ''").withColumn("version", F.col("v").cast("int"))
    per = parts.groupBy("table_fqn", "version").agg(F.max("c.commitInfo.timestamp").alias("timestamp_ms"), F.max("c.metaData.schemaString").alias("schema"))
    fields = F.transform(F.from_json("schema", _FIELDS)["fields"], lambda f: F.struct(f["name"], F.struct(f["type"].alias("type"), f["nullable"].alias("nullable"))))
    versions = per.filter("schema IS NOT NULL").withColumn("columns", F.map_from_entries(fields))
    changes = schema_changes(versions.select("table_fqn", "version", "columns")).join(per.select("table_fqn", "version", "timestamp_ms"), ["table_fqn", "version"])
    first = F.row_number().over(Window.partitionBy("table_fqn").orderBy("version"))
    created = versions.withColumn("n", first).filter("n = 1")
    none = F.lit(None)
    made = created.select("table_fqn", "version", F.lit("table_created").alias("kind"), none.cast("string").alias("column"), none.cast("string").alias("from_type"), none.cast("string").alias("to_type"), none.cast("boolean").alias("from_nullable"), none.cast("boolean").alias("to_nullable"), "timestamp_ms")
    return made.unionByName(changes.select(*made.columns))


_EVENT = """Event string, executionId long, description string, time long, physicalPlanDescription string, rules array<struct<ruleName: string, detail: string>>,
`Job ID` int, `Stage Infos` array<struct<`Stage ID`: int, `Stage Name`: string, `Number of Tasks`: int, `Parent IDs`: array<int>>>, `Submission Time` long, `Completion Time` long,
Properties map<string, string>, `Stage Info` struct<`Stage ID`: int, `Stage Name`: string, `Number of Tasks`: int>"""


def event_log(lines: DataFrame) -> dict[str, DataFrame]:
    """executions, jobs, stages, rules and diagnostics of event log lines (path, value); malformed lines are diagnostics."""
    rows = lines.filter(F.trim("value") != "").select("path", "value", F.from_json("value", _EVENT).alias("e"))
    good = rows.filter("e.Event IS NOT NULL").select("path", "e.*").withColumn("kind", F.regexp_extract("Event", r"(\w+)$", 1))
    begun = good.filter("kind = 'SparkListenerSQLExecutionStart'").select("path", "executionId", "description", F.col("time").alias("started"), F.col("physicalPlanDescription").alias("plan"))
    ended = good.filter("kind = 'SparkListenerSQLExecutionEnd'").select("path", "executionId", F.col("time").alias("ended"))
    executions = begun.join(ended, ["path", "executionId"], "left").withColumn("duration_ms", F.col("ended") - F.col("started"))
    jobs = good.filter("kind = 'SparkListenerJobStart'")
    stages = jobs.select("path", F.col("Job ID").alias("job_id"), F.explode("Stage Infos").alias("s"))
    return {
        "executions": executions,
        "jobs": jobs.select("path", F.col("Job ID").alias("job_id"), F.try_element_at("Properties", F.lit("spark.sql.execution.id")).cast("long").alias("executionId")),
        "stages": stages.select("path", "job_id", F.col("s.`Stage ID`").alias("stage_id"), F.col("s.`Stage Name`").alias("stage_name"), F.col("s.`Number of Tasks`").alias("n_tasks"), F.col("s.`Parent IDs`").alias("parents")),
        "rules": good.filter("rules IS NOT NULL").select("path", "executionId", F.explode("rules").alias("r")).select("path", "executionId", "r.ruleName", "r.detail"),
        "diagnostics": rows.filter("e.Event IS NULL").select("path", F.lit("malformed_line").alias("code"), F.substring("value", 1, 200).alias("detail")),
    }


def correlate(planned: DataFrame, executions: DataFrame) -> DataFrame:
    """(path, block, executionId): SQL blocks and writes matched to executions by order, each execution once.

    planned: (path, block, kind 'sql' or 'write', line). Executions whose plan writes are matched to writes only.
    """
    writes = F.lower("plan").rlike(r"write|saveas|insert")
    kind = F.when(writes, "write").otherwise("sql")
    ran = executions.withColumn("kind", kind).withColumn("n", F.row_number().over(Window.partitionBy("path", "kind").orderBy("started", "executionId")))
    want = planned.withColumn("n", F.row_number().over(Window.partitionBy("path", "kind").orderBy("line", "block")))
    return want.join(ran.select("path", "kind", "n", "executionId"), ["path", "kind", "n"], "left").select("path", "block", "kind", "executionId")
