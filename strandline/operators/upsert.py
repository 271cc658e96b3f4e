"""Idempotent merges of node, edge and table rows.

All are keyed joins or keyed aggregations: running one twice gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a column of an old and a new row merge.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "last": lambda old, new: F.coalesce(new, old),
    "first": lambda old, new: F.coalesce(old, new),
    "fill": lambda old, new: F.coalesce(old, new),
    "and": lambda old, new: F.coalesce(old, F.lit(True)) & F.coalesce(new, F.lit(True)),
    "or": lambda old, new: F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)),
    "append": lambda old, new: F.concat(F.array_except(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))), F.coalesce(new, F.array().cast("array<string>"))),
    "nonempty": lambda old, new: F.when(F.coalesce(old, F.lit("")) != "", old).otherwise(new),
}


def upsert(old: DataFrame, new: DataFrame, key: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """Rows of both, one per key: a full outer join; columns merge by RULES, `last` where none is named."""
    rules = rules or {}
    columns = [c for c in old.columns if c not in key]
    o = old.select(*key, *[F.col(c).alias(f"__o_{c}") for c in columns])
    n = new.select(*key, *[F.col(c).alias(f"__n_{c}") for c in columns])
    merged = [RULES[rules.get(c, "last")](F.col(f"__o_{c}"), F.col(f"__n_{c}")).alias(c) for c in columns]
    return o.join(n, key, "full").select(*key, *merged)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of old, and those of new whose key is not there."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the (ascending) order: a partial aggregate, so a hot key needs no task of its own."""
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__row"))
    return first.select("__row.*")


def merge_edges(edges: DataFrame, key: str = "key") -> DataFrame:
    """One edge per ends, relation and discriminator."""
    return edges.dropDuplicates(["src", "dst", "rel", key])


def guarded_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def cascade(children: DataFrame, parents_gone: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is not gone."""
    return children.join(parents_gone.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def violations(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n): keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def allowed(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """rows, checked by the plan itself: a value out of the list raises an error when it is met."""
    ok = F.col(column).isin(names)
    return rows.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} not allowed: "), F.coalesce(F.col(column), F.lit("null"))))))


def conflicts(rows: DataFrame, key: str, order: str, fields: list[str], source: str) -> DataFrame:
    """(key, first source, later source, fields): later definitions that differ from the first, and where."""
    first = first_wins(rows, [key], [F.col(order), F.col(source)])
    f = first.select(key, F.col(source).alias("first_source"), *[F.col(c).alias(f"__f_{c}") for c in fields])
    both = rows.join(f, key).filter(F.col(source) != F.col("first_source"))
    differ = F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"__f_{c}")), F.lit(c)) for c in fields])
    out = both.select(key, "first_source", F.col(source).alias("later_source"), differ.alias("fields"))
    return out.filter("fields <> ''").distinct()


def commonality(members: DataFrame, key: str, source: str) -> DataFrame:
    """(key, n_sources, sources, common): in which sources an entity is."""
    out = members.groupBy(key).agg(F.count_distinct(source).alias("n_sources"), F.sort_array(F.collect_set(source)).alias("sources"))
    return out.withColumn("common", F.col("n_sources") >= 2)


def disjoint_edges(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst, src_source, dst_source): edges between entities that share no source, with the first of each."""
    a = sources.select(F.col("id").alias("src"), F.col("sources").alias("sa"))
    b = sources.select(F.col("id").alias("dst"), F.col("sources").alias("sb"))
    both = edges.select("src", "dst").join(a, "src").join(b, "dst")
    return both.filter(F.size(F.array_intersect("sa", "sb")) == 0).select("src", "dst", F.array_min("sa").alias("src_source"), F.array_min("sb").alias("dst_source"))
