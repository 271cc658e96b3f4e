"""Queries over the scheduler mirror and the project catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jobs_with_schedule(jobs: DataFrame, schedules: DataFrame) -> DataFrame:
    return jobs.join(schedules, "schedule_id")


def runtime_window(jobs: DataFrame, schedules: DataFrame) -> DataFrame:
    return jobs_with_schedule(jobs, schedules).filter("start_time IS NOT NULL")


def in_window(start: Column, low: str | None, high: str | None, wrap: bool = False) -> Column:
    """HH:mm texts, both ends included. wrap: a window from evening to morning goes over midnight, else it is empty."""
    ok = F.lit(True)
    if low is not None and high is not None and wrap and low > high:
        return (start >= low) | (start <= high)
    if low is not None:
        ok = ok & (start >= low)
    if high is not None:
        ok = ok & (start <= high)
    return ok


def search_jobs(jobs: DataFrame, low: str | None = None, high: str | None = None, path: str | None = None, workstation: str | None = None, limit: int = 500, wrap: bool = False) -> DataFrame:
    """Jobs by inclusive time window, part of the script's path without case, and workstation."""
    out = jobs
    if low is not None or high is not None:
        out = out.filter(in_window(F.col("start_time"), low, high, wrap))
    if path is not None:
        out = out.filter(F.col("script_path").ilike(f"%{path}%"))
    if workstation is not None:
        out = out.filter(F.col("workstation") == workstation)
    return out.orderBy(F.asc_nulls_last("start_time"), "job_id").limit(min(max(1, limit), 2000))


def export_jobs(jobs: DataFrame, low: str | None = None, high: str | None = None, schedule: object | None = None) -> DataFrame:
    """Jobs for a spreadsheet: the window is half-open."""
    out = jobs
    if low is not None:
        out = out.filter(F.col("start_time") >= low)
    if high is not None:
        out = out.filter(F.col("start_time") < high)
    if schedule is not None:
        out = out.filter(F.col("schedule_id") == schedule)
    return out.orderBy("schedule_id", F.asc_nulls_last("start_time"), "job_id")


def project_list(projects: DataFrame, files: DataFrame, sources: list[str]) -> DataFrame:
    """Projects with their number of files, in all and by source, the newest first."""
    joined = projects.join(files, "project_id", "left")
    by = [F.count_if(F.col("source") == s).alias(f"n_{s}") for s in sources]
    return joined.groupBy("project_id", "project_name", "created").agg(F.count("file_id").alias("n_files"), *by).orderBy(F.desc("created"), "project_id")


def project_detail(files: DataFrame) -> DataFrame:
    """(project_id, source, files): files by source in the order they were added."""
    ordered = F.sort_array(F.collect_list(F.struct("added", "file_id")))
    return files.groupBy("project_id", "source").agg(ordered.alias("x")).select("project_id", "source", F.col("x.file_id").alias("files"))


def get_or_create(projects: DataFrame, names: DataFrame) -> DataFrame:
    """Names (trimmed) that no project has yet, once each."""
    wanted = names.select(F.trim("project_name").alias("project_name")).filter("project_name <> ''").distinct()
    return wanted.join(projects.select(F.trim("project_name").alias("project_name")), "project_name", "left_anti")


def attach_files(attached: DataFrame, new: DataFrame) -> DataFrame:
    """Files of projects, new ones added once."""
    key = ["project_id", "file_id"]
    return attached.unionByName(new.dropDuplicates(key).join(attached.select(*key), key, "left_anti"))


def status_rollup(results: DataFrame, unit: str, ok: Column) -> DataFrame:
    """(unit, status, n): ok if all parts are, failed if none is, else partial."""
    good = F.count_if(ok)
    n = F.count(F.lit(1))
    return results.groupBy(unit).agg(F.when(good == n, "ok").when(good == 0, "failed").otherwise("partial").alias("status"), n.alias("n"))
