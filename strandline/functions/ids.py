"""Identity: every node is keyed by a truncated SHA-256 of one canonical string.

All four divergences of identity that are known from practice are settled here: ids are case-insensitive, a
table's parts have explicit defaults, connection classes have aliases and default ports, and every id has the
same width.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 16
SEP = "::"

#: Connection class aliases and default ports.
CLASS_ALIASES = {"postgresql": "postgres", "pg": "postgres", "mssql": "sqlserver", "sqlserver": "sqlserver", "mysql": "mysql", "mariadb": "mysql", "oracle": "oracle", "db2": "db2", "redshift": "redshift", "snowflake": "snowflake", "hive2": "hive", "hive": "hive", "teradata": "teradata"}
DEFAULT_PORTS = {"postgres": 5432, "sqlserver": 1433, "mysql": 3306, "oracle": 1521, "db2": 50000, "redshift": 5439, "snowflake": 443, "hive": 10000, "teradata": 1025, "kafka": 9092, "mongodb": 27017, "cassandra": 9042, "elasticsearch": 9200, "redis": 6379}


def make_id(*parts: object) -> str:
    """The id of a canonical string, in plain Python."""
    text = SEP.join("" if p is None else str(p).strip() for p in parts).lower()
    return hashlib.sha256(text.encode()).hexdigest()[:WIDTH]


def canonical_id(*parts: Column) -> Column:
    """The same as an expression; a null part counts as empty."""
    clean = [F.trim(F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return F.substring(F.sha2(F.lower(F.concat_ws(SEP, *clean)), 256), 1, WIDTH)


def canonical_fqn(fqn: Column, default_db: str = "", default_schema: str = "default") -> Column:
    """db.schema.name in lower case, quotes and brackets dropped, missing parts filled in."""
    parts = F.split(F.lower(F.regexp_replace(F.trim(fqn), r"[`\"\[\]]", "")), r"\.")
    n = F.size(parts)
    return (
        F.when(n >= 3, F.array_join(F.slice(parts, n - 2, 3), "."))
        .when(n == 2, F.concat(F.lit(default_db + "."), F.array_join(parts, ".")))
        .otherwise(F.concat(F.lit(f"{default_db}.{default_schema}."), F.array_join(parts, ".")))
    )


def table_id(fqn: Column, default_db: str = "", default_schema: str = "default") -> Column:
    return canonical_id(F.lit("table"), canonical_fqn(fqn, default_db, default_schema))


def connection_class(klass: Column) -> Column:
    """The class without its jdbc: prefix, by its usual name."""
    bare = F.regexp_replace(F.lower(F.trim(klass)), r"^jdbc:", "")
    names = F.create_map(*[F.lit(x) for pair in CLASS_ALIASES.items() for x in pair])
    return F.coalesce(names[bare], bare)


def connection_id(klass: Column, server: Column, dbname: Column, port: Column | None = None) -> Column:
    """One id per (class, server, port, database), defaults filled in, so that tools agree."""
    name = connection_class(klass)
    ports = F.create_map(*[F.lit(x) for k, v in DEFAULT_PORTS.items() for x in (k, str(v))])
    host = F.regexp_replace(F.lower(F.trim(server)), r"^(localhost|::1|0\.0\.0\.0)$", "127.0.0.1")
    given = F.lit(None).cast("string") if port is None else port.cast("string")
    return canonical_id(F.lit("connection"), name, host, F.coalesce(given, ports[name], F.lit("")), dbname)


def path_id(uri: Column) -> Column:
    """Id of a storage path: scheme aliases, double and trailing slashes settled."""
    plain = F.regexp_replace(F.trim(uri), r"^(s3a|s3n)://", "s3://")
    plain = F.regexp_replace(F.regexp_replace(plain, r"^(abfss|wasbs?|abfs)://", "abfs://"), r"(?<!:)/{2,}", "/")
    return canonical_id(F.lit("path"), F.regexp_replace(plain, r"/+$", ""))


def attribute_id(owner: Column, column: Column) -> Column:
    return canonical_id(F.lit("attribute"), owner, column)
