"""Cutting lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests, a laptop) is a folder of our own set: on a
    cluster each machine would write to its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("this cluster's session names no shared folder; set spark.checkpoint.dir")
        named = "/tmp/checkpoints/strandline"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut lineage by writing df as a Parquet table in the shared folder and reading that back.

    A lost executor then costs a re-read, not a recomputation of everything before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline/{label}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


@contextmanager
def scoped_views(spark: SparkSession, views: dict[str, DataFrame]) -> Iterator[None]:
    """Temporary views for the SQL that is analysed inside; the session's own of these names come back after it."""
    held = {v.name for v in spark.catalog.listTables() if v.isTemporary}
    before = {name: spark.table(name) for name in views if name in held}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        yield
    finally:
        for name in views:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that written() returned. Only for tables that nothing lazy will read any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
