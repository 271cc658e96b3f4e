"""Notebooks as rows of cells: Jupyter JSON, Databricks sources, and archives of notebooks."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CELLS = "metadata struct<language_info: struct<name: string>>, cells array<struct<cell_type: string, source: string, execution_count: int>>"
CELL = "path string, index int, language string, source string, execution_count int"


def _joined(source: Column) -> Column:
    """Cell sources come as one string or as a list of lines; a list arrives here as its JSON text."""
    lines = F.from_json(source, "array<string>")
    return F.when(source.rlike(r"^\s*\[") & lines.isNotNull(), F.array_join(lines, "")).otherwise(source)


def jupyter_cells(artifacts: DataFrame) -> DataFrame:
    """(path, index, language, source, execution_count) of code cells; a cell magic sets the language, line magics go."""
    nb = artifacts.select("path", F.from_json("content", _CELLS).alias("nb"))
    cells = nb.select("path", F.coalesce("nb.metadata.language_info.name", F.lit("python")).alias("base"), F.posexplode("nb.cells").alias("index", "cell"))
    cells = cells.filter("cell.cell_type = 'code'").withColumn("text", _joined(F.col("cell.source")))
    magic = F.regexp_extract("text", r"^\s*%%(\w+)", 1)
    body = F.regexp_replace(F.regexp_replace("text", r"^\s*%%\w+[^\n]*\n?", ""), r"(?m)^\s*[%!][^\n]*$", "")
    return cells.select("path", "index", F.when(magic != "", F.lower(magic)).otherwise(F.col("base")).alias("language"), body.alias("source"), F.col("cell.execution_count").alias("execution_count"))


def databricks_cells(artifacts: DataFrame) -> DataFrame:
    """The same of sources with `# COMMAND ---` and `# MAGIC` lines."""
    body = F.regexp_replace("content", r"^# Databricks notebook source[^\n]*\n", "")
    cells = artifacts.select("path", F.posexplode(F.split(body, r"(?m)^# COMMAND -+[^\n]*\n?")).alias("index", "raw")).filter(F.trim("raw") != "")
    is_magic = F.trim("raw").rlike(r"^# MAGIC")
    plain = F.regexp_replace("raw", r"(?m)^# MAGIC ?", "")
    language = F.lower(F.regexp_extract(plain, r"^\s*%(\w+)", 1))
    named = F.when(~is_magic, "python").when(language.isin("sql", "python", "scala", "r", "md", "sh", "run", "fs"), language).otherwise("python")
    text = F.when(is_magic & ~language.isin("run"), F.regexp_replace(plain, r"^\s*%\w+[ \t]*\n?", "")).otherwise(plain)
    return cells.select("path", "index", named.alias("language"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("source"), F.lit(None).cast("int").alias("execution_count"))


def archive_cells(files: DataFrame) -> DataFrame:
    """The same of zip archives of notebook JSON (path, content bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for entry in z.namelist():
                        try:
                            nb = json.loads(z.read(entry))
                        except ValueError:
                            continue
                        base = nb.get("language", "python")
                        for k, c in enumerate(nb.get("commands", nb.get("cells", []))):
                            text = c.get("command", c.get("source", ""))
                            text = "".join(text) if isinstance(text, list) else text
                            m = re.match(r"\s*%(\w+)[ \t]*\n?", text)
                            rows.append((f"{path}!{entry}", k, m[1].lower() if m else base, text[m.end() :] if m else text, c.get("execution_count")))
            yield pd.DataFrame(rows, columns=["path", "index", "language", "source", "execution_count"]).astype({"execution_count": "Int64"})

    return files.select("path", "content").mapInPandas(run, CELL)


def out_of_order(cells: DataFrame) -> DataFrame:
    """(path, index, execution_count, before): cells that ran earlier than the cell above them."""
    before = F.lag("execution_count").over(Window.partitionBy("path").orderBy("index"))
    ran = cells.filter("execution_count IS NOT NULL").withColumn("before", before)
    return ran.filter("execution_count < before").select("path", "index", "execution_count", "before")


def notebook_calls(cells: DataFrame) -> DataFrame:
    """(path, target): notebooks that a notebook runs."""
    runs = F.regexp_extract_all("source", F.lit(r"(?m)^\s*%run\s+[\"']?([^\s\"']+)"), 1)
    calls = F.regexp_extract_all("source", F.lit(r"dbutils\.notebook\.run\(\s*[\"']([^\"']+)[\"']"), 1)
    return cells.select("path", F.explode(F.concat(runs, calls)).alias("target")).distinct()


def assembled(cells: DataFrame) -> DataFrame:
    """(path, content): each notebook's Python, SQL cells as spark.sql calls, in order."""
    quoted = F.concat(F.lit('spark.sql("""'), F.regexp_replace("source", r'"""', "'''"), F.lit('""")'))
    code = F.when(F.col("language").isin("python", "py", "pyspark"), F.col("source")).when(F.col("language") == "sql", quoted)
    rows = cells.withColumn("code", code).filter("code IS NOT NULL")
    ordered = F.sort_array(F.collect_list(F.struct("index", "code")))
    return rows.groupBy("path").agg(ordered.alias("x")).select("path", F.array_join(F.col("x.code"), "\n").alias("content"))
