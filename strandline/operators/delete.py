"""Deletions that keep what others still use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import reach_from_each


def doomed(nodes: DataFrame, edges: DataFrame, roots: DataFrame, rels: list[str], shared_labels: list[str], max_depth: int = 6) -> DataFrame:
    """(root, id): what each root contains, itself included, shared labels left out."""
    found = reach_from_each(edges.filter(F.col("rel").isin(rels)), roots, max_depth, "out")
    shared = nodes.filter(F.col("label").isin(shared_labels)).select("id")
    inner = found.filter("depth > 0").join(shared, "id", "left_anti").select("root", "id")
    return inner.unionByName(found.filter("depth = 0").select("root", "id")).distinct()


def delete_exclusive(nodes: DataFrame, edges: DataFrame, roots: DataFrame, rels: list[str], shared_labels: list[str], max_depth: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes left, edges left, (root, n_deleted))."""
    gone = doomed(nodes, edges, roots, rels, shared_labels, max_depth)
    ids = gone.select("id").distinct()
    left_nodes = nodes.join(ids, "id", "left_anti")
    left_edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left_nodes, left_edges, gone.groupBy("root").agg(F.count(F.lit(1)).alias("n_deleted"))


def only_owned(edges: DataFrame, owners: DataFrame, owner_rels: list[str]) -> DataFrame:
    """(id): things owned by the given owners and by nobody else."""
    held = edges.filter(F.col("rel").isin(owner_rels)).select("src", "dst").distinct()
    inside = held.join(owners.select(F.col("id").alias("src"), F.lit(1).alias("ours")), "src", "left")
    return inside.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count("ours").alias("ours")).filter("ours > 0 AND n = ours").select("id")
