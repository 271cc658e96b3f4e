"""Runtime telemetry from a Spark history server's REST interface, as the same tables as an event log gives."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession

Transport = Callable[[str], str]


def fetch(url: str) -> str:
    with urlopen(url, timeout=30) as reply:
        return reply.read().decode()


def runtime(spark: SparkSession, base: str, app: str, transport: Transport = fetch) -> dict[str, DataFrame]:
    """executions, jobs and stages of an application. transport: URL to JSON text, for tests and proxies."""
    get = lambda what: json.loads(transport(f"{base.rstrip('/')}/api/v1/applications/{app}/{what}"))
    executions = [(app, x["id"], x.get("description"), x.get("duration"), x.get("planDescription"), x.get("status")) for x in get("sql")]
    jobs = [(app, x["jobId"], x.get("status"), x.get("stageIds", [])) for x in get("jobs")]
    stages = [(app, x["stageId"], x.get("name"), x.get("numTasks"), x.get("status")) for x in get("stages")]
    return {
        "executions": spark.createDataFrame(executions, "path string, executionId long, description string, duration_ms long, plan string, status string"),
        "jobs": spark.createDataFrame(jobs, "path string, job_id int, status string, stages array<int>"),
        "stages": spark.createDataFrame(stages, "path string, stage_id int, stage_name string, n_tasks int, status string"),
    }
