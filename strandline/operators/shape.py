"""Shaping a graph for display: folding attributes, capping fan-out, indexing lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Parts of a hub's children that are ranked apart.
SALTS = 64


def fold_attributes(nodes: DataFrame, edges: DataFrame, owner_rels: list[str], label: str = "Attribute", keep_labels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with col_count and columns, edges): attributes fold into their owners, edges keep two visible ends."""
    fields = nodes.filter(F.col("label") == label)
    owned = edges.filter(F.col("rel").isin(owner_rels)).join(fields.select(F.col("id").alias("dst"), "name"), "dst")
    folded = owned.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("col_count"), F.sort_array(F.collect_set("name")).alias("columns"))
    shown = nodes.filter(F.col("label") != label)
    if keep_labels is not None:
        shown = shown.filter(F.col("label").isin(keep_labels))
    out = shown.join(folded, "id", "left").withColumn("col_count", F.coalesce("col_count", F.lit(0)))
    ids = shown.select("id")
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return out, left


def cap_fanout(edges: DataFrame, labels: DataFrame, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """(summaries, edges): per source and child label, most - 1 children stay and the rest go into a summary node.

    A child is hidden only if exactly one summary claims it and no kept edge shows it. Edges to hidden children go
    to the summary; loops and duplicates go.
    """
    kids = edges.join(labels.select(F.col("id").alias("dst"), F.col("label").alias("child_label")), "dst")
    # Only groups over the limit matter, and their size is known from a plain count first. The first most - 1 of a hub
    # are found among the first of each of its SALTS parts, so no task ranks all children of a hub.
    sizes = kids.groupBy("src", "child_label").agg(F.count_distinct("dst").alias("size")).filter(F.col("size") > most)
    over = kids.select("src", "child_label", "dst").distinct().join(sizes, ["src", "child_label"])
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("dst"))
    salted = over.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)))
    first = salted.withColumn("rank", rank("src", "child_label", "salt")).filter(F.col("rank") < most)
    first = first.withColumn("rank", rank("src", "child_label")).filter(F.col("rank") < most)
    spill = over.join(first.select("src", "child_label", "dst"), ["src", "child_label", "dst"], "left_anti").withColumn("summary", F.concat_ws("::", F.lit("summary"), "src", "child_label"))
    claims = spill.groupBy("dst").agg(F.count_distinct("summary").alias("claims"), F.min("summary").alias("summary"))
    kept = kids.join(spill.select("src", "dst"), ["src", "dst"], "left_anti").select("dst").distinct()
    hidden = claims.filter("claims = 1").join(kept, "dst", "left_anti").select(F.col("dst").alias("id"), "summary")
    summaries = hidden.groupBy(F.col("summary").alias("id")).agg(F.count(F.lit(1)).alias("n_hidden"))
    a, b = hidden.select(F.col("id").alias("src"), F.col("summary").alias("sa")), hidden.select(F.col("id").alias("dst"), F.col("summary").alias("sb"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left")
    moved = moved.select(F.coalesce("sa", "src").alias("src"), F.coalesce("sb", "dst").alias("dst"), "rel").filter("src <> dst").distinct()
    return summaries, moved


def line_index(ranges: DataFrame) -> DataFrame:
    """(path, line, ids): nodes per line, from (path, id, line_start, line_end); a missing end is the start."""
    end = F.greatest(F.coalesce("line_end", "line_start"), "line_start")
    rows = ranges.filter("line_start IS NOT NULL").select("path", "id", F.explode(F.sequence("line_start", end)).alias("line"))
    return rows.groupBy("path", "line").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def plain_values(df: DataFrame) -> DataFrame:
    """Temporal columns as ISO text, all others as they are."""
    out = {}
    for name, kind in df.dtypes:
        if kind.startswith("timestamp"):
            out[name] = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "date":
            out[name] = F.date_format(name, "yyyy-MM-dd")
    return df.withColumns(out) if out else df
