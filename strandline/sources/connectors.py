"""Data source connectors: which connection and dataset an I/O call means, from its format and options."""

from __future__ import annotations

import re
from dataclasses import dataclass
from ipaddress import ip_address
from urllib.parse import urlsplit

from ..functions.ids import CLASS_ALIASES, make_id
from ..functions.text import SECRET_KEYS

#: Storage schemes and their connection class.
SCHEMES = {"s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gcs", "gcs": "gcs", "abfs": "adls", "abfss": "adls", "wasb": "azure_blob", "wasbs": "azure_blob", "hdfs": "hdfs", "file": "local_fs", "dbfs": "dbfs", "http": "http", "https": "http", "ftp": "ftp", "sftp": "ftp"}
#: Format names that mean the same connector.
FORMATS = {"mongo": "mongodb", "com.mongodb.spark.sql.defaultsource": "mongodb", "org.apache.spark.sql.cassandra": "cassandra", "es": "elasticsearch", "org.elasticsearch.spark.sql": "elasticsearch", "net.snowflake.spark.snowflake": "snowflake", "com.google.cloud.spark.bigquery": "bigquery", "io.github.spark_redshift_community.spark.redshift": "redshift", "com.databricks.spark.redshift": "redshift", "org.apache.hudi": "hudi", "cloudfiles": "autoloader"}
PATH_FORMATS = {"parquet", "csv", "json", "orc", "avro", "text", "xml", "delta", "iceberg", "hudi", "autoloader", "binaryfile", "sequencefile"}
#: Ports of connection classes, where an address names none.
PORTS = {"postgresql": 5432, "postgres": 5432, "mysql": 3306, "mariadb": 3306, "oracle": 1521, "sqlserver": 1433, "db2": 50000, "redshift": 5439, "snowflake": 443, "hive2": 10000, "hive": 10000, "h2": 9092, "sqlite": 0, "clickhouse": 8123, "vertica": 5433, "teradata": 1025, "presto": 8080, "trino": 8080, "kafka": 9092, "mongodb": 27017, "cassandra": 9042, "elasticsearch": 9200, "redis": 6379, "hdfs": 8020}
#: Names of the options that say where a format's data is, the first that is set counts.
OPTIONS = {
    "query": ["dbtable", "query"],
    "brokers": ["kafka.bootstrap.servers", "bootstrap.servers"],
    "topics": ["subscribe", "topic", "assign", "subscribePattern"],
    "project": ["parentProject", "project"],
    "mongo_uri": ["spark.mongodb.read.connection.uri", "spark.mongodb.write.connection.uri", "spark.mongodb.input.uri", "spark.mongodb.output.uri", "connection.uri", "uri"],
    "cassandra_host": ["spark.cassandra.connection.host", "host"],
    "nodes": ["es.nodes", "nodes"],
    "index": ["es.resource", "resource"],
    "keys": ["table", "keys.pattern", "keys"],
}
#: Classes whose addresses name a container of an account: container@account.
ACCOUNTS = {"adls", "azure_blob"}


@dataclass
class Connection:
    klass: str
    server: str
    port: int | None
    database: str
    dataset: str
    resolved: bool
    has_credentials: bool

    @property
    def id(self) -> str:
        return make_id("connection", CLASS_ALIASES.get(self.klass, self.klass), self.server, "" if self.port is None else self.port, self.database)


def canonical_host(host: str | None) -> str:
    """A host's name in lower case; every address of the machine itself is localhost."""
    name = (host or "").strip().lower()
    try:
        address = ip_address(name)
    except ValueError:
        return name
    return "localhost" if address.is_loopback or address.is_unspecified else name


def first_host(hosts: str) -> tuple[str, int | None]:
    """The first host of a list in sorted order, and its port."""
    names = sorted({h.strip() for h in hosts.split(",") if h.strip()}, key=str.lower)
    if not names:
        return "", None
    m = re.fullmatch(r"(?:\w+://)?(?:[^@/]*@)?\[?([^\]/]+?)\]?(?::(\d+))?(?:/.*)?", names[0])
    return (canonical_host(m[1]), int(m[2]) if m and m[2] else None) if m else (canonical_host(names[0]), None)


def parse_jdbc(url: str) -> tuple[str, str, int | None, str]:
    """(class, host, port, database) of a JDBC address."""
    m = re.match(r"jdbc:([a-z0-9]+):(.*)", url.strip(), re.I | re.S)
    if not m:
        return "unknown", "", None, ""
    klass, rest = m[1].lower(), m[2]
    address = re.search(r"(?://|@)(?:[^@/;?]*@)?([^:/;?,]+)(?::(\d+))?(?:[/:]([^;?]+))?", rest)
    prop = re.search(r";\s*(?:databaseName|database)=([^;]+)", rest, re.I)
    host, port, db = (address[1], address[2], address[3] or "") if address else ("", None, "")
    return klass, canonical_host(host), int(port) if port else PORTS.get(klass), prop[1] if prop else db


def parse_path(uri: str) -> tuple[str, str, str]:
    """(class, container, path) of a storage address."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://?([^/?#]*)([^?#]*)", uri)
    if not m or ":" not in uri:
        return "local_fs", "", uri.rstrip("/") or "/"
    return SCHEMES.get(m[1].lower(), f"unknown:{m[1].lower()}"), m[2].lower(), m[3].rstrip("/") or "/"


def _pick(options: dict[str, str], *keys: str) -> str:
    lower = {k.lower(): v for k, v in options.items()}
    return next((str(lower[k.lower()]) for k in keys if lower.get(k.lower())), "")


def derive_connection(fmt: str | None, options: dict[str, str], path: str | None = None, table: str | None = None) -> Connection:
    """The connection that a read or write means. Unknown formats and missing addresses are kept, unresolved."""
    f = FORMATS.get((fmt or "").lower(), (fmt or "").lower())
    secret = any(re.sub(r"[.\-]", "_", k.lower()) in SECRET_KEYS or k.lower() in SECRET_KEYS for k, v in options.items() if v)
    make = lambda klass, server, port, db, dataset, ok=True: Connection(klass, server, port, db, dataset, bool(ok and (server or db or dataset)), secret)
    if f in ("jdbc", "redshift") and (url := _pick(options, "url")):
        klass, host, port, db = parse_jdbc(url)
        secret = secret or bool(re.search(r"//[^/@]*:[^/@]*@|[?&;](?:user|password)=", url, re.I))
        return make(klass, host, port, db, _pick(options, *OPTIONS["query"]) or (table or ""), bool(host))
    if f == "jdbc":
        return make("jdbc", "", None, "", _pick(options, *OPTIONS["query"]), False)
    if f == "kafka":
        host, port = first_host(_pick(options, *OPTIONS["brokers"]))
        return make("kafka", host, port or PORTS["kafka"], "", _pick(options, *OPTIONS["topics"]), bool(host))
    if f == "snowflake":
        return make("snowflake", canonical_host(_pick(options, "sfUrl")), 443, _pick(options, "sfDatabase"), _pick(options, *OPTIONS["query"]), bool(_pick(options, "sfUrl")))
    if f == "bigquery":
        return make("bigquery", "bigquery.googleapis.com", 443, _pick(options, *OPTIONS["project"]), _pick(options, "table") or (path or table or ""))
    if f == "mongodb":
        uri = _pick(options, *OPTIONS["mongo_uri"])
        parts = urlsplit(uri) if uri else None
        host, port = first_host(parts.netloc.rpartition("@")[2]) if parts else ("", None)
        return make("mongodb", host, port or PORTS["mongodb"], _pick(options, "database") or (parts.path.strip("/").split(".")[0] if parts else ""), _pick(options, "collection"), bool(host))
    if f == "cassandra":
        host, port = first_host(_pick(options, *OPTIONS["cassandra_host"]))
        return make("cassandra", host, port or PORTS["cassandra"], _pick(options, "keyspace"), _pick(options, "table"), bool(host))
    if f == "elasticsearch":
        host, port = first_host(_pick(options, *OPTIONS["nodes"]))
        return make("elasticsearch", host, port or PORTS["elasticsearch"], _pick(options, *OPTIONS["index"]) or (path or ""), _pick(options, *OPTIONS["index"]) or (path or ""), bool(host))
    if f == "redis":
        host = canonical_host(_pick(options, "host"))
        return make("redis", host, PORTS["redis"], "", _pick(options, *OPTIONS["keys"]), bool(host))
    if table and f not in PATH_FORMATS or f == "hive" or (table and not path):
        parts = (table or "").split(".")
        return make("hive", "metastore", None, ".".join(parts[:-1]) or "default", table or "")
    target = path or _pick(options, "path")
    if f in PATH_FORMATS or not f:
        if not target:
            return make(f or "unknown", "", None, "", "", False)
        klass, server, rest = parse_path(target)
        container = ""
        if klass in ACCOUNTS and "@" in server:
            container, _, server = server.partition("@")
        return make(klass, server, PORTS.get(klass), container, rest, not klass.startswith("unknown"))
    return make(f"unknown:{f}", "", None, "", target or "", False)
