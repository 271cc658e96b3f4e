"""The graph and the scheduler mirror as Parquet. A graph's folder holds versions, of which readers see the last whole one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import guarded_edges, merge_edges, upsert

#: The empty file that makes a version whole.
READY = "_READY"


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions at path, in order."""
    fs, folder = _folder(spark, path)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    held = fs.globStatus(jvm.Path(folder, f"v*/{READY}")) or []
    return sorted(int(m[1]) for x in held if (m := re.fullmatch(r"v(\d+)", x.getPath().getParent().getName())))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    last = f"{path}/v{versions(spark, path)[-1]}"
    return spark.read.parquet(f"{last}/nodes"), spark.read.parquet(f"{last}/edges")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A new version: nodes sorted by id; edges by relation, in a folder each, so that a traversal reads only what it walks.

    Edges are dealt by ranges of relation and source, so that a relation with most edges is many tasks. Readers see the
    version once both are written; the one before it stays, for who still reads it, and older ones go.
    """
    spark = nodes.sparkSession
    fs, folder = _folder(spark, path)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    held = versions(spark, path)
    to = f"{path}/v{(held[-1] if held else 0) + 1}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes.sortWithinPartitions("id").write.mode("overwrite").parquet(f"{to}/nodes")
    edges.repartitionByRange(parts, "rel", "src").sortWithinPartitions("rel", "src").write.mode("overwrite").partitionBy("rel").parquet(f"{to}/edges")
    fs.create(jvm.Path(to, READY), True).close()
    for old in held[:-1]:
        fs.delete(jvm.Path(folder, f"v{old}"), True)


def merge_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Upsert a graph into the one at path, as a new version; doing it twice changes nothing."""
    old_nodes, old_edges = read_graph(spark, path)
    columns = ["id", *[c for c in old_nodes.columns if c != "id"]]
    merged = upsert(old_nodes.select(columns), nodes.select(columns), ["id"])
    all_edges = merge_edges(old_edges.select("src", "dst", "rel", "key").unionByName(edges.select("src", "dst", "rel", "key")))
    write_graph(merged, guarded_edges(all_edges, merged).select("src", "dst", "rel", "key"), path)


def scheduler_mirror(parsed: DataFrame) -> dict[str, DataFrame]:
    """The relational tables of parsed scheduler rows."""
    from ..sources import tws
    from ..sources.artifacts import entities

    depends, _ = tws.dependencies(parsed)
    schedules = entities(parsed, "schedule", tws.SCHEDULE).drop("path").dropDuplicates(["id"])
    jobs = entities(parsed, "job", tws.JOB).drop("path").dropDuplicates(["id"])
    needs = entities(parsed, "needs", "job_id string, resource string, quantity int").filter("job_id IS NOT NULL")
    opens = entities(parsed, "opens", "job_id string, file string").filter("job_id IS NOT NULL")
    ids = jobs.select("id")
    return {
        "schedules": schedules,
        "jobs": jobs,
        "job_dependencies": depends.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("job_id"), F.col("dst").alias("depends_on")).distinct(),
        "schedule_dependencies": depends.join(schedules.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("schedule_id"), F.col("dst").alias("depends_on")).distinct(),
        "resources": needs.select("resource").distinct(),
        "job_resources": needs.groupBy("job_id", "resource").agg(F.max("quantity").alias("quantity")),
        "file_watchers": opens.select("file").distinct(),
        "job_file_dependencies": opens.select("job_id", "file").distinct(),
    }


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def dump_stages(parsed: DataFrame, path: str) -> None:
    """Entity rows for inspection: one folder of JSON lines per kind."""
    parts = int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed.select("kind", "path", "payload").repartitionByRange(parts, "kind", "path").write.mode("overwrite").partitionBy("kind").json(path)
