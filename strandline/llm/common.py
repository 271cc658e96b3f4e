"""Helpers shared by the training-data operators: the shared working folder, written tables and sizes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, shared_dir, written

__all__ = ["WS", "discard", "lower_ascii", "shared_dir", "shuffle_parts", "table", "text_batches", "written"]

#: White space of the word and text contracts: the six ASCII characters, nothing else.
WS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(col):
    """A-Z to a-z, every other character as it is (lower() would also change letters beyond ASCII)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of one Arrow batch of texts.
BATCH = 512


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Hold Arrow batches to BATCH rows for the jobs run inside, and give the session its own setting back.

    Spark's 10,000 rows are many where a row holds a whole text. What is evaluated later, by the caller, has the
    session's batches, which Spark bounds by their bytes.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH:
        spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)
