"""Artefacts: files as rows (path, content), their kind, and parsers run over them in Python workers.

A parser is a plain function from (path, text) to rows (kind, payload); rows come back as (path, kind, payload JSON),
so that one plan serves all parsers and each consumer picks the kinds and schemas it wants.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Artefact kinds by extension.
KINDS = {"py": "pyspark", "sql": "sparksql", "ipynb": "notebook", "dbc": "archive", "qvs": "qlik", "qvw": "qlik_binary", "qvf": "qlik_app", "qvd": "qvd", "twb": "tableau", "twbx": "tableau_archive", "txt": "composer", "dump": "composer", "xml": "xml", "json": "json", "sh": "shell"}

ENTITY = "path string, kind string, payload string"
Parser = Callable[[str, str], Iterable[tuple[str, dict]]]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("content"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files, as bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def artifact_kind(path: Column, content: Column) -> Column:
    """Kind by extension, settled by the head of the text where an extension has several meanings."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    named = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[ext]
    head = F.substring(content, 1, 4000)
    return (
        F.when((ext == "py") & head.rlike(r"(?m)^# Databricks notebook source"), "databricks")
        .when((ext == "py") & head.rlike(r"\bDAG\s*\("), "airflow")
        .when((ext == "xml") & head.rlike(r"<(scheduleDefinitions|jobstream)\b"), "scheduler_xml")
        .when((ext == "txt") & ~head.rlike(r"(?mi)^\s*(SCHEDULE|CPUNAME|JOBS|RESOURCE|CALENDAR|PROMPT|EVENTRULE|\$JOBS)\b"), "unknown")
        .when((ext == "json") & head.rlike(r'"task_key"'), "workflow")
        .otherwise(F.coalesce(named, F.lit("unknown")))
    )


def parse(artifacts: DataFrame, parser: Parser) -> DataFrame:
    """(path, kind, payload) of artefacts (path, content). A parser's failure becomes a diagnostic, never an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, kind, json.dumps(payload, sort_keys=True, default=str)) for kind, payload in parser(path, content or "")]
                except Exception as e:
                    rows.append((path, "diagnostic", json.dumps({"level": "error", "code": type(e).__name__, "detail": str(e)[:500]})))
            yield pd.DataFrame(rows, columns=["path", "kind", "payload"])

    return artifacts.select("path", "content").mapInPandas(run, ENTITY)


def entities(parsed: DataFrame, kind: str, schema: str) -> DataFrame:
    """Rows of one kind, their payload by a schema, with the path."""
    return parsed.filter(F.col("kind") == kind).select("path", F.from_json("payload", schema).alias("x")).select("path", "x.*")
