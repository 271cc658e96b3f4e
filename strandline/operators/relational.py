"""Relational operators that Spark has no single name for: keep, scoped and positional joins, level of detail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_keys(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in set(b.columns)]


def natural_join(a: DataFrame, b: DataFrame, how: str = "outer", allow_product: bool = False) -> DataFrame:
    """Join on all shared names. Without any the result is every pair, which the caller has to allow."""
    keys = natural_keys(a, b)
    if not keys and not allow_product:
        raise ValueError(f"no shared names among {a.columns} and {b.columns}: the join would be a product")
    return a.join(b, keys, how) if keys else a.crossJoin(b)


def keep(a: DataFrame, b: DataFrame, side: str = "inner") -> tuple[DataFrame, DataFrame]:
    """Reduce tables by each other without merging them: left reduces b, right reduces a, inner both."""
    keys = natural_keys(a, b)
    ra = a.join(b.select(*keys).distinct(), keys, "left_semi") if side in ("inner", "right") else a
    rb = b.join(a.select(*keys).distinct(), keys, "left_semi") if side in ("inner", "left") else b
    return ra, rb


def concatenate(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, columns by name, missing ones null."""
    return a.unionByName(b, allowMissingColumns=True)


def apply_map(df: DataFrame, mapping: DataFrame, column: str, new: str, default: Column | None = None) -> DataFrame:
    """new: the mapping's value (key, value; the first key counts) of a column, else the default, else the column itself."""
    once = mapping.groupBy("key").agg(F.min("value").alias("value"))
    out = df.join(once, df[column] == once["key"], "left")
    return out.withColumn(new, F.coalesce("value", default if default is not None else F.col(column))).drop("key", "value")


def scoped_resolve(refs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved) of references (ref_id, workstation, stream, job, external).

    An internal reference is to a job of its own (workstation, stream), an external one names all three. There is no
    falling back from one to the other.
    """
    keys = ["workstation", "stream", "job"]
    found = refs.join(targets.select(*keys, "target_id"), keys)
    return found.select("ref_id", "external", "target_id"), refs.join(targets.select(*keys), keys, "left_anti")


def unique_name_join(refs: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    """References joined to targets whose name is unique."""
    unique = targets.groupBy(name).agg(F.count(F.lit(1)).alias("__n"), F.min("target_id").alias("target_id")).filter("__n = 1").drop("__n")
    return refs.join(unique, name)


def positional_join(a: DataFrame, b: DataFrame, group: list[str], order_a: list[Column], order_b: list[Column]) -> DataFrame:
    """The n-th row of a with the n-th row of b, within groups."""
    ra = a.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order_a)))
    rb = b.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order_b)))
    return ra.join(rb, [*group, "position"])


def broadcast_if_small(small: DataFrame, rows: int = 100_000) -> DataFrame:
    """small with a broadcast hint if a count shows at most that many rows, else as it is."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def include_lod(df: DataFrame, view: list[str], dims: list[str], inner: Column, outer: Callable[[str], Column], name: str) -> DataFrame:
    """{INCLUDE dims : inner} in a view of dimensions `view`: inner per view and dims, then outer of that per view."""
    finer = df.groupBy(*dict.fromkeys([*view, *dims])).agg(inner.alias("__inner"))
    return finer.groupBy(*view).agg(outer("__inner").alias(name))


def exclude_lod(df: DataFrame, view: list[str], dims: list[str], agg: Column, name: str) -> DataFrame:
    """{EXCLUDE dims : agg} in a view: the aggregate over the view's other dimensions, at each of its members."""
    left = [c for c in view if c not in dims]
    members = df.select(*view).distinct()
    if not left:
        return members.join(F.broadcast(df.agg(agg.alias(name))), how="cross")  # one row
    return members.join(df.groupBy(*left).agg(agg.alias(name)), left, "left").select(*view, name)


def fixed_lod(df: DataFrame, dims: list[str], agg: Column, name: str) -> DataFrame:
    """{FIXED dims : agg}: the aggregate joined back to every row."""
    return df.join(df.groupBy(*dims).agg(agg.alias(name)), dims, "left")


def synthetic_keys(fields: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n, fields): dataset pairs that share `least` field names or more, from (dataset, field)."""
    f = fields.select("dataset", F.lower("field").alias("field")).distinct()
    pairs = f.select(F.col("dataset").alias("a"), "field").join(f.select(F.col("dataset").alias("b"), "field"), "field").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("field")).alias("fields")).filter(F.col("n") >= least)


def dag_signature(edges: DataFrame, group: str, src: str, dst: str) -> DataFrame:
    """(group, signature): 16 hex digits of SHA-256 over the sorted edge list."""
    listed = F.array_join(F.sort_array(F.collect_set(F.concat_ws(">", F.col(src).cast("string"), F.col(dst).cast("string")))), ";")
    return edges.groupBy(group).agg(F.substring(F.sha2(listed, 256), 1, 16).alias("signature"))


def schema_changes(versions: DataFrame) -> DataFrame:
    """(table_fqn, version, kind, column, from_type, to_type, from_nullable, to_nullable) from column rows.

    versions: (table_fqn, version, columns map<string, struct<type, nullable>>). One row per change between a
    version and the one before it; the first version only creates.
    """
    w = Window.partitionBy("table_fqn").orderBy("version")
    v = versions.withColumn("before", F.lag("columns").over(w)).filter("before IS NOT NULL")
    names = F.array_distinct(F.concat(F.map_keys("before"), F.map_keys("columns")))
    rows = v.withColumn("column", F.explode(names)).withColumn("o", F.col("before")[F.col("column")]).withColumn("n", F.col("columns")[F.col("column")])
    kind = (
        F.when(F.col("o").isNull(), "column_added")
        .when(F.col("n").isNull(), "column_dropped")
        .when(F.col("o.type") != F.col("n.type"), "type_changed")
        .when(F.col("o.nullable") != F.col("n.nullable"), "nullability_changed")
    )
    out = rows.select("table_fqn", "version", kind.alias("kind"), "column", F.col("o.type").alias("from_type"), F.col("n.type").alias("to_type"), F.col("o.nullable").alias("from_nullable"), F.col("n.nullable").alias("to_nullable"))
    return out.filter("kind IS NOT NULL")
