"""OpenLineage run events of scripts, and text forms of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.artifacts import entities

PRODUCER = "strandline"
_SCHEMA = "https://openlineage.io/spec/1-0-5/OpenLineage.json#/definitions/RunEvent"
_COLUMNS = "https://openlineage.io/spec/facets/1-0-1/ColumnLineageDatasetFacet.json"


def namespace(target: Column) -> Column:
    """Of an address its scheme and container, of a table name the catalogue."""
    return F.when(target.rlike(r"^\w+://"), F.regexp_extract(target, r"^(\w+://[^/]*)", 1)).otherwise(F.lit("catalog"))


def run_events(parsed: DataFrame, event_time: str, event_type: str = "COMPLETE") -> DataFrame:
    """(path, event): one event JSON per script: datasets once each by name, a column facet, and a run id that only
    the script and the time decide."""
    io = "frame int, target string"
    sets = lambda kind: entities(parsed, kind, io).filter("target IS NOT NULL").select("path", F.struct(namespace(F.col("target")).alias("namespace"), F.col("target").alias("name")).alias("d")).distinct()
    inputs = sets("read").groupBy("path").agg(F.sort_array(F.collect_set("d")).alias("inputs"))
    outputs = sets("write").groupBy("path").agg(F.sort_array(F.collect_set("d")).alias("outputs"))
    derived = entities(parsed, "derivation", "frame int, `column` string, sources array<string>").filter(F.size("sources") > 0)
    columns = derived.groupBy("path", "column").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    columns = columns.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("column", "sources"))).alias("columns"))
    rows = parsed.select("path").distinct().join(inputs, "path", "left").join(outputs, "path", "left").join(columns, "path", "left")
    none = F.array().cast("array<struct<namespace:string,name:string>>")
    first = F.get("inputs", 0)
    fields = F.map_from_entries(
        F.transform("columns", lambda c: F.struct(c["column"], F.struct(F.transform(c["sources"], lambda s: F.struct(first["namespace"].alias("namespace"), first["name"].alias("name"), s.alias("field"))).alias("inputFields"))))
    )
    facet = F.when(F.col("columns").isNotNull() & first.isNotNull(), F.struct(F.struct(F.lit(PRODUCER).alias("_producer"), F.lit(_COLUMNS).alias("_schemaURL"), fields.alias("fields")).alias("columnLineage")))
    digest = F.sha2(F.concat_ws("|", "path", F.lit(event_time)), 256)
    run_id = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(F.lit("8"), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    event = F.struct(
        F.lit(event_type).alias("eventType"),
        F.lit(event_time).alias("eventTime"),
        F.struct(run_id.alias("runId")).alias("run"),
        F.struct(F.lit("scripts").alias("namespace"), F.col("path").alias("name")).alias("job"),
        F.coalesce("inputs", none).alias("inputs"),
        F.transform(F.coalesce("outputs", none), lambda d: F.struct(d["namespace"].alias("namespace"), d["name"].alias("name"), facet.alias("facets"))).alias("outputs"),
        F.lit(PRODUCER).alias("producer"),
        F.lit(_SCHEMA).alias("schemaURL"),
    )
    return rows.select("path", F.to_json(event).alias("event"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): a DOT drawing, one statement a row between the braces."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    boxes = nodes.select(F.concat(quoted(F.col("id")), F.lit(" [label="), quoted(F.concat_ws(": ", "label", "name")), F.lit("];")).alias("line"))
    arrows = edges.select(F.concat(quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(" [label="), quoted(F.col("rel")), F.lit("];")).alias("line"))
    return boxes.unionByName(arrows)
