"""Catalogue queries over the graph: listing, introspection, presets, file catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.guard import assert_read_only
from ..plans.storage import scoped_views
from .graph import combined, reach, trails

#: Labels that several tools share.
SHARED_LABELS = ["Table", "Attribute", "Connection", "Script"]
#: Label prefixes of each tool.
LABEL_PREFIXES = {"Tableau": "tableau", "Qlik": "qlikview", "Spark": "spark", "Tws": "tws"}
MAX_LIST = 500


def list_nodes(nodes: DataFrame, label: str | None = None, search: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Nodes by label and case-insensitive part of the name, in the order of ids; limit is held to 1..500."""
    if label is not None:
        nodes = nodes.filter(F.col("label") == label)
    if search:
        nodes = nodes.filter(F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(search.lower())))
    return nodes.orderBy("id").offset(max(0, offset)).limit(min(max(1, limit), MAX_LIST))


def schema_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): labels, relationship types, and property keys with how many carry them."""
    labels = nodes.select(F.explode("labels").alias("name")).groupBy("name").count().select(F.lit("label").alias("kind"), "name", F.col("count").alias("n"))
    rels = edges.groupBy("rel").count().select(F.lit("rel").alias("kind"), F.col("rel").alias("name"), F.col("count").alias("n"))
    keys = nodes.select(F.explode(F.map_keys("props")).alias("name")).groupBy("name").count().select(F.lit("property").alias("kind"), "name", F.col("count").alias("n"))
    return labels.unionByName(rels).unionByName(keys)


def adhoc(spark: SparkSession, query: str, views: dict[str, DataFrame], **params: object) -> DataFrame:
    """A read-only SQL query with named parameters over the given views."""
    assert_read_only(spark, query)
    with scoped_views(spark, views):
        return spark.sql(query, args=params or None)


def source_system(label: Column, labels: Column, props: Column) -> Column:
    """The property if there is one, else the tool by label prefix, else shared or unknown."""
    found = F.lit(None).cast("string")
    for prefix, tool in LABEL_PREFIXES.items():
        found = F.coalesce(found, F.when(F.array_join(labels, "\n").rlike(f"(?m)^{prefix}"), F.lit(tool)))
    shared = F.when(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in SHARED_LABELS])), F.lit("shared"))
    return F.coalesce(props["source_system"], found, shared, F.lit("unknown"))


def primary_label(labels: Column) -> Column:
    """The first label that is not shared, else the first."""
    own = F.filter(labels, lambda x: ~x.isin(SHARED_LABELS))
    return F.coalesce(F.get(own, 0), F.get(labels, 0))


def payload(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and edges of paths (column path: node ids)."""
    ids = paths.select(F.explode("path").alias("id")).distinct()
    steps = paths.select(F.explode(F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("a"), F.slice("path", 2, F.size("path")).alias("b"))).alias("s"))
    steps = steps.select(F.col("s.a").alias("a"), F.col("s.b").alias("b")).distinct()
    hit = edges.join(steps, ((F.col("src") == F.col("a")) & (F.col("dst") == F.col("b"))), "left_semi").unionByName(edges.join(steps, ((F.col("src") == F.col("b")) & (F.col("dst") == F.col("a"))), "left_semi"))
    return nodes.join(ids, "id", "left_semi").dropDuplicates(["id"]), hit.dropDuplicates(["src", "dst", "rel"])


def optional_hops(start: DataFrame, edges: DataFrame, hops: list[tuple[str, str, str, bool]]) -> DataFrame:
    """A chain of matches from start: hops are (from column, relation, new column, optional)."""
    out = start
    for at, rel, new, optional in hops:
        step = edges.filter(F.col("rel") == rel).select(F.col("src").alias(at), F.col("dst").alias(new))
        out = out.join(step, at, "left" if optional else "inner")
    return out


def both_exist(nodes: DataFrame, edges: DataFrame, rel_in: str, rel_out: str) -> DataFrame:
    """Nodes with an edge of one relation and an edge of the other (two semi-joins)."""
    a = edges.filter(F.col("rel") == rel_in).select(F.col("src").alias("id"))
    b = edges.filter(F.col("rel") == rel_out).select(F.col("dst").alias("id"))
    return nodes.join(a, "id", "left_semi").join(b, "id", "left_semi")


def unresolved(nodes: DataFrame, label: str = "Connection") -> DataFrame:
    return nodes.filter((F.col("label") == label) & (F.col("props")["resolved"] == "false"))


def connection_dataframes(edges: DataFrame, connection: str, downstream: bool = True, max_depth: int | None = None) -> DataFrame:
    """(id): dataframes that a connection feeds (or that feed it), with all that derive from them, at any depth."""
    if downstream:
        seeds = edges.filter((F.col("rel") == "PROVIDES_DATAFRAME") & (F.col("src") == connection)).select(F.col("dst").alias("id"))
    else:
        seeds = edges.filter((F.col("rel") == "WRITES_TO_CONNECTION") & (F.col("dst") == connection)).select(F.col("src").alias("id"))
    found = reach(edges, seeds, max_depth, "out" if downstream else "in", ["DERIVES_FROM_DATAFRAME"], include_seeds=True)
    return found.select("id").distinct()


def hits_connection(ir: DataFrame, connection: str, column: str = "reads") -> DataFrame:
    """(name): dataframes of an in-memory result whose list of connections has this one."""
    return ir.select("name", F.explode(column).alias("__c")).filter(F.col("__c") == connection).select("name").distinct()


def file_catalog(files: DataFrame, orphans: DataFrame, limit: int = 1000) -> DataFrame:
    """Files and what stands in for missing ones (orphans that no file contains), by name without case."""
    both = files.unionByName(orphans).distinct()
    return both.orderBy(F.lower(F.coalesce("name", "id")), "id").limit(limit)


def source_view(files: DataFrame, languages: dict[str, str], cap: int = 2 * 1024 * 1024) -> DataFrame:
    """(id, path, language, n_lines, truncated, text): texts cut at cap characters, language by extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in languages.items() for x in kv])[ext], F.lit("text"))
    text = F.coalesce("text", F.lit(""))
    return files.select("id", "path", named.alias("language"), F.size(F.split(text, "\n")).alias("n_lines"), (F.length(text) > cap).alias("truncated"), F.substring(text, 1, cap).alias("text"))


#: The relations that upstream and downstream lineage walks. Edges between connections and dataframes
#: are not among them: they would lead through a shared connection into every script that uses it.
LINEAGE_RELATIONS = [
    "CONTAINS_DATASOURCE", "CONTAINS_DASHBOARD", "CONTAINS_WORKSHEET", "CONTAINS_TABLE", "CONTAINS_CHART", "CONTAINS_SHEET", "CONTAINS_DATAFRAME", "CONTAINS_SCHEDULE", "CONTAINS_JOB", "CONTAINS_COMPONENT",
    "HAS_PARAMETER", "HAS_FIELD", "HAS_COLUMN", "USES_FIELD", "USES_PARAMETER", "USES_CONNECTION", "READS_TABLE", "WRITES_TABLE", "LOADS_FROM_TABLE", "LOADS_FROM_FILE",
    "DERIVES_FROM", "DERIVES_FROM_REF", "DERIVES_FROM_DATAFRAME", "FILTERS_BY", "SORTS_BY", "HAS_ZONE", "CONTROLS_PARAMETER", "FILTERS_VIA_ACTION", "SETS_PARAMETER", "HAS_GROUP", "HAS_SET", "HAS_BIN", "HAS_HIERARCHY", "HAS_LEVEL",
    "CONNECTS_VIA", "DISPLAYS_WORKSHEET", "JOINS_WITH", "CALLS_SCRIPT", "HAS_PARAMETER_SCOPE", "HAS_BLEND", "BLENDS_WITH", "DERIVES_FROM_CROSS_DS", "DERIVES_FROM_CTE_COLUMN",
    "EXECUTES", "INVOKES_FILE", "REQUIRES_RESOURCE", "WAITS_FOR_FILE", "WAITS_FOR_PROMPT", "RUNS_ON", "HOSTS_STREAM", "RECOVERS_WITH", "TRIGGERS", "SCHEDULED_BY", "DEPENDS_ON",
    "SOURCED_FROM", "HAS_ATTRIBUTE", "STORED_AS", "MAPS_TO", "JOINS", "REFERENCES_FK", "HAS_CONSTRAINT", "FEEDS_OBJECT",
]


def lineage_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("rel").isin(LINEAGE_RELATIONS))


#: Preset name to a function of (nodes, edges, parameters).
PRESETS: dict[str, Callable[..., DataFrame]] = {
    "lineage-upstream": lambda nodes, edges, id, depth=6, **_: trails(lineage_edges(edges), nodes.filter(matches(id)), depth, "out"),
    "lineage-downstream": lambda nodes, edges, id, depth=6, **_: trails(lineage_edges(edges), nodes.filter(matches(id)), depth, "in"),
    "combined": lambda nodes, edges, ids, depth=6, **_: combined(edges, nodes.filter(F.col("id").isin(ids)), depth),
    "spark-connections": lambda nodes, edges, **_: optional_hops(
        nodes.filter("label = 'SparkScript'").select(F.col("id").alias("script")), edges, [("script", "CONTAINS_DATAFRAME", "dataframe", False)]
    ).join(edges.filter("rel = 'PROVIDES_DATAFRAME'").select(F.col("dst").alias("dataframe"), F.col("src").alias("source")), "dataframe", "left").join(
        edges.filter("rel = 'WRITES_TO_CONNECTION'").select(F.col("src").alias("dataframe"), F.col("dst").alias("sink")), "dataframe", "left"
    ).orderBy("script", "dataframe", "source", "sink").limit(500),
    "spark-write-targets": lambda nodes, edges, **_: optional_hops(
        nodes.filter("label = 'SparkScript'").select(F.col("id").alias("script")),
        edges,
        [("script", "CONTAINS_DATAFRAME", "dataframe", False), ("dataframe", "WRITES_TABLE", "table", False), ("dataframe", "WRITES_TO_CONNECTION", "sink", True)],
    ),
    "tableau-physical-tables": lambda nodes, edges, **_: optional_hops(
        nodes.filter("label = 'TableauWorkbook'").select(F.col("id").alias("workbook")), edges, [("workbook", "CONTAINS_DATASOURCE", "datasource", False), ("datasource", "READS_TABLE", "table", False)]
    ),
    "qlikview-chart-lineage": lambda nodes, edges, **_: chart_lineage(nodes, edges),
    "cross-tool": lambda nodes, edges, **_: cross_tool(nodes, edges),
}


def matches(key: str) -> Column:
    """A node is meant by its id, its qualified name or its path."""
    return (F.col("id") == key) | (F.col("props")["fqn"] == key) | (F.col("props")["path"] == key)


def chart_lineage(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """(chart, attribute, source, table): fields a chart uses, what they derive from in 0..6 steps, and its table."""
    from .graph import reach_from_each

    used = nodes.filter("label = 'QlikChart'").select(F.col("id").alias("chart")).join(edges.filter("rel = 'USES_FIELD'").select(F.col("src").alias("chart"), F.col("dst").alias("attribute")), "chart")
    closed = reach_from_each(edges.filter("rel = 'DERIVES_FROM'"), used.select(F.col("attribute").alias("id")))
    owner = edges.filter("rel = 'HAS_COLUMN'").select(F.col("dst").alias("source"), F.col("src").alias("table"))
    found = used.join(closed.select(F.col("root").alias("attribute"), F.col("id").alias("source")), "attribute").join(owner, "source")
    return found.select("chart", "attribute", "source", "table").orderBy("chart", "attribute", "source", "table").limit(limit)


def cross_tool(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dashboard, worksheet, attribute, table, dataframe, script): from a dashboard to the script that fills its table."""
    hop = lambda rel, a, b: edges.filter(F.col("rel") == rel).select(F.col("src").alias(a), F.col("dst").alias(b)).distinct()
    chain = hop("DISPLAYS_WORKSHEET", "dashboard", "worksheet").join(hop("USES_FIELD", "worksheet", "attribute"), "worksheet")
    chain = chain.join(hop("HAS_COLUMN", "table", "attribute"), "attribute").join(hop("WRITES_TABLE", "dataframe", "table"), "table")
    chain = chain.join(hop("CONTAINS_DATAFRAME", "script", "dataframe"), "dataframe")
    return chain.select("dashboard", "worksheet", "attribute", "table", "dataframe", "script")


def list_presets() -> list[str]:
    return sorted(PRESETS)


def run_preset(name: str, nodes: DataFrame, edges: DataFrame, **params: object) -> DataFrame:
    """A preset by name; an unknown name raises KeyError."""
    if name not in PRESETS:
        raise KeyError(f"no preset named {name}; there are {', '.join(list_presets())}")
    return PRESETS[name](nodes, edges, **params)
