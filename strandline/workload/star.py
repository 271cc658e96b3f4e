"""The star schema as a property graph: the common ground of the graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_id


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: label: (table, key columns, name expression)
NODES = {
    "region": ("region", ["r_regionkey"], "r_name"),
    "nation": ("nation", ["n_nationkey"], "n_name"),
    "customer": ("customer", ["c_custkey"], "c_name"),
    "orders": ("orders", ["o_orderkey"], "o_orderstatus"),
    "lineitem": ("lineitem", ["l_orderkey", "l_linenumber"], "l_returnflag"),
    "part": ("part", ["p_partkey"], "p_name"),
    "supplier": ("supplier", ["s_suppkey"], "s_name"),
}
#: (relation, table, source label, its key columns, target label, its key columns)
EDGES = [
    ("CONTAINS", "nation", "region", ["n_regionkey"], "nation", ["n_nationkey"]),
    ("CONTAINS", "customer", "nation", ["c_nationkey"], "customer", ["c_custkey"]),
    ("CONTAINS", "orders", "customer", ["o_custkey"], "orders", ["o_orderkey"]),
    ("CONTAINS", "lineitem", "orders", ["l_orderkey"], "lineitem", ["l_orderkey", "l_linenumber"]),
    ("USES", "lineitem", "lineitem", ["l_orderkey", "l_linenumber"], "part", ["l_partkey"]),
    ("USES", "lineitem", "lineitem", ["l_orderkey", "l_linenumber"], "supplier", ["l_suppkey"]),
]


def key(label: str, columns: list[str]):
    return canonical_id(F.lit(label), *[F.col(c) for c in columns])


def nodes(spark: SparkSession, d: str, labels: list[str] | None = None) -> DataFrame:
    """(id, label, labels, name, props) of the given labels."""
    out = None
    for label in labels or list(NODES):
        table, columns, name = NODES[label]
        part = t(spark, d, table).select(
            key(label, columns).alias("id"),
            F.lit(label).alias("label"),
            F.array(F.lit(label)).alias("labels"),
            F.col(name).alias("name"),
            F.create_map(F.lit("key"), F.concat_ws("::", *[F.col(c).cast("string") for c in columns])).alias("props"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark: SparkSession, d: str, tables: list[str] | None = None, rels: list[str] | None = None) -> DataFrame:
    """(src, dst, rel) out of the given tables."""
    out = None
    for rel, table, a, ak, b, bk in EDGES:
        if (tables and table not in tables) or (rels and rel not in rels):
            continue
        part = t(spark, d, table).select(key(a, ak).alias("src"), key(b, bk).alias("dst"), F.lit(rel).alias("rel"))
        out = part if out is None else out.unionByName(part)
    return out


def sql_id(label: str, columns: list[str]) -> str:
    return "substr(sha256(lower('" + label + "'" + "".join(f" || '::' || {c}::VARCHAR" for c in columns) + ")), 1, 16)"


def sql_nodes(labels: list[str] | None = None) -> str:
    parts = []
    for label in labels or list(NODES):
        table, columns, name = NODES[label]
        k = " || '::' || ".join(f"{c}::VARCHAR" for c in columns)
        parts.append(f"SELECT {sql_id(label, columns)} AS id, '{label}' AS label, {name} AS name, {k} AS key FROM {table}")
    return " UNION ALL ".join(parts)


def sql_edges(tables: list[str] | None = None, rels: list[str] | None = None) -> str:
    return " UNION ALL ".join(
        f"SELECT {sql_id(a, ak)} AS src, {sql_id(b, bk)} AS dst, '{rel}' AS rel FROM {table}" for rel, table, a, ak, b, bk in EDGES if not (tables and table not in tables) and not (rels and rel not in rels)
    )
