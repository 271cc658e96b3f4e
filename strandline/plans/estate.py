"""From parsed artefacts to one graph: nodes (id, label, labels, name, props) and edges (src, dst, rel, key).

Tables are keyed by canonical ids whatever tool names them, so lineage across tools is an equi-join. Jobs are tied
to the scripts they start by the base name of what their command line ends in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import attribute_id, canonical_id, table_id
from ..operators.upsert import guarded_edges, merge_edges
from ..sources import qlik, tableau, tws
from ..sources.artifacts import entities
from .storage import written

_IO = "frame int, target string, `table` string, location string, format string, connection string, klass string, server string, `database` string, mode string, via string, resolved boolean, has_credentials boolean, line int"


def _node(df: DataFrame, id: Column, label: str, name: Column, **props: Column) -> DataFrame:
    pairs = [x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]
    bag = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select(id.alias("id"), F.lit(label).alias("label"), F.array(F.lit(label)).alias("labels"), name.alias("name"), bag.alias("props"))


def _edge(df: DataFrame, src: Column, dst: Column, rel: str, key: Column | None = None) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), (F.coalesce(key, F.lit("")) if key is not None else F.lit("")).alias("key"))


def dataset_id(name: Column) -> Column:
    """Id of a table name or a storage address: addresses by their own text, names by their canonical form."""
    address = F.regexp_replace(F.lower(F.regexp_replace(name, r"^(s3a|s3n)://", "s3://")), r"/+$", "")
    return F.when(name.rlike(r"^[a-zA-Z0-9+.-]+://|^/|^[a-zA-Z]:"), canonical_id(F.lit("table"), address)).otherwise(table_id(name))


def basename(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]+)$", 1))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def spark_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of parsed PySpark sources."""
    frame_id = lambda c="frame": canonical_id(F.lit("dataframe"), F.col("path"), F.col(c))
    script = canonical_id(F.lit("script"), F.col("path"))
    frames = entities(parsed, "frame", "id int, name string, creation_order int, partial boolean, conditional boolean, line int")
    reads, writes = entities(parsed, "read", _IO).filter("target IS NOT NULL"), entities(parsed, "write", _IO).filter("target IS NOT NULL")
    links = entities(parsed, "edge", "src int, dst int")
    derived = entities(parsed, "derivation", "frame int, `column` string, sources array<string>, expr string, via string")
    carried = entities(parsed, "column_edge", "frame int, `column` string, src_frame int, src_column string")
    drawn = entities(parsed, "column_table", "frame int, `column` string, `table` string")
    stored = entities(parsed, "column_write", "frame int, `column` string, `table` string")
    own, up = attribute_id(frame_id(), F.col("column")), attribute_id(frame_id("src_frame"), F.col("src_column"))
    of_table = attribute_id(dataset_id(F.col("table")), F.col("column"))
    io = reads.unionByName(writes)
    nodes = [
        _node(parsed.select("path").distinct(), script, "SparkScript", basename(F.col("path")), path=F.col("path")),
        _node(frames, frame_id("id"), "DataFrame", F.coalesce("name", F.concat(F.lit("line "), F.col("line").cast("string"))), line=F.col("line"), partial=F.col("partial"), conditional=F.col("conditional"), named=F.col("name").isNotNull()),
        _node(io, dataset_id(F.col("target")), "Table", F.col("target"), fqn=F.lower("target")),
        _node(io, F.col("connection"), "Connection", F.concat_ws("/", "klass", "server", "database"), resolved=F.col("resolved"), has_credentials=F.col("has_credentials")),
        _node(derived, own, "Attribute", F.col("column"), via=F.col("via")),
        _node(carried, up, "Attribute", F.col("src_column")),
        *[_node(x, own, "Attribute", F.col("column")) for x in (carried, drawn, stored)],
        *[_node(x, of_table, "Attribute", F.col("column")) for x in (drawn, stored)],
    ]
    edges = [
        _edge(frames, script, frame_id("id"), "CONTAINS_DATAFRAME", F.col("creation_order").cast("string")),
        _edge(links, frame_id("src"), frame_id("dst"), "DERIVES_FROM_DATAFRAME"),
        _edge(reads, frame_id(), dataset_id(F.col("target")), "READS_TABLE"),
        _edge(writes, frame_id(), dataset_id(F.col("target")), "WRITES_TABLE", F.coalesce("mode", F.lit(""))),
        _edge(reads, F.col("connection"), frame_id(), "PROVIDES_DATAFRAME"),
        _edge(writes, frame_id(), F.col("connection"), "WRITES_TO_CONNECTION"),
        *[_edge(x, frame_id(), own, "HAS_FIELD") for x in (derived, carried, drawn, stored)],
        _edge(carried, frame_id("src_frame"), up, "HAS_FIELD"),
        *[_edge(x, dataset_id(F.col("table")), of_table, "HAS_COLUMN") for x in (drawn, stored)],
        # A column derives from what it is computed from; a written table's column from the frame's.
        _edge(carried, own, up, "DERIVES_FROM"),
        _edge(drawn, own, of_table, "DERIVES_FROM"),
        _edge(stored, of_table, own, "DERIVES_FROM"),
    ]
    return _settled(nodes), merge_edges(union_all(edges))


def scheduler_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of parsed scheduler definitions."""
    schedules, jobs = entities(parsed, "schedule", tws.SCHEDULE), entities(parsed, "job", tws.JOB)
    needs = entities(parsed, "needs", "job_id string, schedule_id string, resource string, quantity int").withColumn("src", F.coalesce("job_id", "schedule_id"))
    opens = entities(parsed, "opens", "job_id string, schedule_id string, workstation string, file string").withColumn("src", F.coalesce("job_id", "schedule_id"))
    command = jobs.filter("script IS NOT NULL")
    script_id = canonical_id(F.lit("script"), F.col("script"))
    depends, _ = tws.dependencies(parsed)
    station = lambda c: canonical_id(F.lit("workstation"), F.col(c))
    nodes = [
        _node(schedules, F.col("id"), "Schedule", F.col("name"), start_time=F.col("start_time"), workstation=F.col("workstation")),
        _node(jobs, F.col("id"), "Job", F.col("name"), script=F.col("script"), stream=F.col("stream")),
        _node(command, script_id, "Script", basename(F.regexp_extract("script", r"^(\S+)", 1)), path=F.col("script")),
        _node(jobs, station("runs_on"), "Workstation", F.col("runs_on")),
        _node(needs, canonical_id(F.lit("resource"), F.col("resource")), "Resource", F.col("resource")),
        _node(opens, canonical_id(F.lit("file"), F.col("file")), "FileWatcher", F.col("file")),
    ]
    edges = [
        _edge(jobs, F.col("schedule_id"), F.col("id"), "CONTAINS_JOB", F.col("order").cast("string")),
        _edge(command, F.col("id"), script_id, "EXECUTES"),
        _edge(jobs, F.col("id"), station("runs_on"), "RUNS_ON"),
        _edge(needs, F.col("src"), canonical_id(F.lit("resource"), F.col("resource")), "REQUIRES_RESOURCE", F.col("quantity").cast("string")),
        _edge(opens, F.col("src"), canonical_id(F.lit("file"), F.col("file")), "WAITS_FOR_FILE"),
        depends,
    ]
    return _settled(nodes), merge_edges(union_all(edges))


def workbook_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of parsed workbooks."""
    book = canonical_id(F.lit("workbook"), F.col("path"))
    part = lambda kind, c: canonical_id(F.lit(kind), F.col("path"), F.col(c))
    field = lambda ds, c: canonical_id(F.lit("attribute"), F.col("path"), F.col(ds), F.col(c))
    sources, tables = entities(parsed, "datasource", "name string, caption string"), entities(parsed, "table", "datasource string, `table` string")
    fields, sheets = entities(parsed, "field", tableau.FIELD), entities(parsed, "worksheet", "name string, datasources array<string>")
    shelves = entities(parsed, "shelf", "worksheet string, shelf string, datasource string, field string, aggregation string")
    zones = entities(parsed, "zone", "dashboard string, worksheet string").filter("worksheet IS NOT NULL")
    boards = entities(parsed, "dashboard", "name string")
    # Fields without a formula are columns of their datasource's tables.
    plain = fields.filter("formula IS NULL").withColumn("column", F.regexp_replace("name", r"^\[|\]$", ""))
    plain = plain.join(tables, ["path", "datasource"])
    of_table = attribute_id(dataset_id(F.col("table")), F.col("column"))
    shown = shelves.join(plain.select("path", "datasource", F.col("name").alias("field"), "table", "column"), ["path", "datasource", "field"])
    depends = tableau.field_dependencies(parsed)
    nodes = [
        _node(parsed.select("path").distinct(), book, "TableauWorkbook", basename(F.col("path")), path=F.col("path")),
        _node(sources, part("datasource", "name"), "TableauDatasource", F.coalesce("caption", "name")),
        _node(tables, dataset_id(F.col("table")), "Table", F.col("table"), fqn=F.lower("table")),
        _node(fields, field("datasource", "name"), "Attribute", F.coalesce("caption", "name"), formula=F.col("formula")),
        _node(plain, of_table, "Attribute", F.col("column")),
        _node(sheets, part("worksheet", "name"), "TableauWorksheet", F.col("name")),
        _node(boards, part("dashboard", "name"), "TableauDashboard", F.col("name")),
    ]
    edges = [
        _edge(sources, book, part("datasource", "name"), "CONTAINS_DATASOURCE"),
        _edge(tables, part("datasource", "datasource"), dataset_id(F.col("table")), "READS_TABLE"),
        _edge(fields, part("datasource", "datasource"), field("datasource", "name"), "HAS_COLUMN"),
        _edge(shelves, part("worksheet", "worksheet"), field("datasource", "field"), "USES_FIELD", F.col("shelf")),
        _edge(sheets.withColumn("ds", F.explode("datasources")), part("worksheet", "name"), part("datasource", "ds"), "READS_DATASOURCE"),
        _edge(zones, part("dashboard", "dashboard"), part("worksheet", "worksheet"), "DISPLAYS_WORKSHEET"),
        _edge(plain, dataset_id(F.col("table")), of_table, "HAS_COLUMN"),
        _edge(plain, field("datasource", "name"), of_table, "DERIVES_FROM"),
        _edge(shown, part("worksheet", "worksheet"), of_table, "USES_FIELD", F.col("shelf")),
        _edge(depends, field("datasource", "field"), field("datasource", "depends_on"), "DERIVES_FROM"),
    ]
    return _settled(nodes), merge_edges(union_all(edges))


def script_attribute(dataset: str = "dataset", name: str = "name") -> Column:
    """Id of a load script's attribute."""
    return canonical_id(F.lit("attribute"), F.col("path"), F.col(dataset), F.col(name))


def objects_graph(objects: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of app objects (app, qId, qType, qTitle, qData): charts, and the attributes of load scripts that they use."""
    chart = canonical_id(F.lit("chart"), F.col("object"))
    rows = objects.select(F.concat_ws("/", "app", "qId").alias("object"), F.coalesce(F.col("qTitle"), F.col("qId")).alias("title"), F.col("qType").alias("type"))
    fields = qlik.sense_fields(objects.withColumn("qId", F.concat_ws("/", "app", "qId"))).select("object", F.lower("field").alias("key")).distinct()
    attributes = entities(parsed, "attribute", "dataset string, name string").withColumn("key", F.lower("name"))
    used = fields.join(attributes, "key")
    nodes = [_node(rows, chart, "QlikChart", F.col("title"), type=F.col("type")), _node(used, script_attribute(), "Attribute", F.col("name"))]
    edges = [_edge(used, chart, script_attribute(), "USES_FIELD"), _edge(used, script_attribute(), chart, "FEEDS_OBJECT")]
    return _settled(nodes), merge_edges(union_all(edges))


def sql_graph(lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of SQL scripts, from rows of sql_lineage.lineage_frame()."""
    script = canonical_id(F.lit("script"), F.col("path"))
    targets = lineage.filter("kind = 'target'").select("path", F.col("target").alias("table"))
    sources = lineage.filter("kind = 'source'").select("path", F.col("name").alias("table"))
    derived = lineage.filter("kind = 'derivation' AND target IS NOT NULL").select("path", F.col("target").alias("table"), F.col("name").alias("column"), F.explode(F.split("sources", ",")).alias("source"), "via").filter("source <> ''")
    # Where a script reads one table, its columns are that table's; else a source column is the script's own.
    only = sources.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("table").alias("from")).filter("n = 1").select("path", "from")
    derived = derived.join(only, "path", "left").withColumn("source", F.element_at(F.split("source", r"\."), -1))
    of_table = attribute_id(dataset_id(F.col("table")), F.col("column"))
    known = F.col("from").isNotNull()
    base = F.when(known, attribute_id(dataset_id(F.col("from")), F.col("source"))).otherwise(attribute_id(script, F.col("source")))
    nodes = [
        _node(lineage.select("path").distinct(), script, "SqlScript", basename(F.col("path")), path=F.col("path")),
        _node(targets.unionByName(sources), dataset_id(F.col("table")), "Table", F.col("table"), fqn=F.lower("table")),
        _node(derived, of_table, "Attribute", F.col("column"), via=F.col("via")),
        _node(derived, base, "Attribute", F.col("source")),
    ]
    edges = [
        _edge(targets, script, dataset_id(F.col("table")), "WRITES_TABLE"),
        _edge(sources, script, dataset_id(F.col("table")), "READS_TABLE"),
        _edge(derived, dataset_id(F.col("table")), of_table, "HAS_COLUMN"),
        _edge(derived.filter(known), dataset_id(F.col("from")), base, "HAS_COLUMN"),
        _edge(derived.filter(~known), script, base, "HAS_FIELD"),
        _edge(derived, of_table, base, "DERIVES_FROM", F.col("via")),
    ]
    return _settled(nodes), merge_edges(union_all(edges))


def orchestration_graph(airflow: DataFrame | None = None, workflows: DataFrame | None = None, submits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Graph of parsed Airflow sources, workflow tasks (orchestration.workflow_tasks) and parsed spark-submit scripts.

    What a task starts is a Script by its command, so that stitched() ties it to the file.
    """
    nodes, edges = [], []
    flow = canonical_id(F.lit("orchestration"), F.col("path"))
    task = lambda c="task": canonical_id(F.lit("task"), F.col("path"), F.col(c))
    starts = canonical_id(F.lit("script"), F.col("target"))

    def started(rows: DataFrame, src: Column) -> None:
        rows = rows.filter("target IS NOT NULL")
        nodes.append(_node(rows, starts, "Script", basename(F.regexp_extract("target", r"(\S+)$", 1)), path=F.col("target")))
        edges.append(_edge(rows, src, starts, "EXECUTES"))

    if airflow is not None:
        dags = entities(airflow, "dag", "dag_id string, schedule string")
        tasks, needs = entities(airflow, "task", "task string, operator string, target string"), entities(airflow, "dependency", "task string, upstream string")
        nodes += [_node(dags, flow, "AirflowDag", F.coalesce("dag_id", "path"), schedule=F.col("schedule")), _node(tasks, task(), "AirflowTask", F.col("task"), operator=F.col("operator"))]
        edges += [_edge(tasks, flow, task(), "CONTAINS_JOB"), _edge(needs, task(), task("upstream"), "DEPENDS_ON")]
        started(tasks, task())
    if workflows is not None:
        needs = workflows.select("path", "task", F.explode("upstream").alias("before"))
        nodes += [_node(workflows, flow, "Workflow", F.col("workflow"), schedule=F.col("cron")), _node(workflows, task(), "WorkflowTask", F.col("task"), kind=F.col("kind"))]
        edges += [_edge(workflows, flow, task(), "CONTAINS_JOB"), _edge(needs, task(), task("before"), "DEPENDS_ON")]
        started(workflows, task())
    if submits is not None:
        rows = entities(submits, "submit", "application string, line int").withColumn("target", F.col("application"))
        nodes.append(_node(submits.select("path").distinct(), flow, "ShellScript", basename(F.col("path")), path=F.col("path")))
        started(rows, flow)
    return _settled(nodes), merge_edges(union_all(edges))


def runtime_graph(changes: DataFrame | None = None, executions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Graph of Delta schema changes (logs.delta_schema_events) and of executions (logs.event_log)."""
    nodes, edges = [], []
    if changes is not None:
        event = canonical_id(F.lit("schema_event"), F.col("table_fqn"), F.col("version").cast("string"), F.col("kind"), F.coalesce("column", F.lit("")))
        nodes += [_node(changes, dataset_id(F.col("table_fqn")), "Table", F.col("table_fqn"), fqn=F.lower("table_fqn")), _node(changes, event, "SchemaEvent", F.col("kind"), column=F.col("column"), version=F.col("version"), timestamp_ms=F.col("timestamp_ms"))]
        edges.append(_edge(changes, dataset_id(F.col("table_fqn")), event, "HAS_SCHEMA_EVENT", F.col("version").cast("string")))
    if executions is not None:
        run, log = canonical_id(F.lit("execution"), F.col("path"), F.col("executionId").cast("string")), canonical_id(F.lit("event_log"), F.col("path"))
        nodes += [_node(executions, log, "EventLog", basename(F.col("path")), path=F.col("path")), _node(executions, run, "SqlExecution", F.col("description"), duration_ms=F.col("duration_ms"))]
        edges.append(_edge(executions, log, run, "CONTAINS_EXECUTION"))
    return _settled(nodes), merge_edges(union_all(edges))


def script_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of parsed load scripts."""
    script = canonical_id(F.lit("qlik"), F.col("path"))
    own = lambda c: canonical_id(F.lit("dataset"), F.col("path"), F.col(c))
    sets = entities(parsed, "dataset", "name string, kind string, source_kind string, source string")
    attributes = entities(parsed, "attribute", "dataset string, name string")
    outside = sets.filter("source_kind <> 'resident' AND source <> ''")
    inside = sets.filter("source_kind = 'resident'")
    stores = entities(parsed, "store", "dataset string, file string")
    attribute = script_attribute()
    links = entities(parsed, "attribute_edge", "dataset string, name string, origin string, resident boolean, source string, rel string, confidence double, transform string")
    links = links.filter("origin IS NOT NULL AND origin <> ''")
    mapped = entities(parsed, "attribute_map", "dataset string, name string, mapping string")
    inner, outer = links.filter("resident"), links.filter("NOT resident")
    column = attribute_id(dataset_id(F.col("origin")), F.col("source"))
    nodes = [
        _node(parsed.select("path").distinct(), script, "QlikScript", basename(F.col("path")), path=F.col("path")),
        _node(sets, own("name"), "Dataset", F.col("name"), kind=F.col("kind")),
        _node(outside, dataset_id(F.col("source")), "Table", F.col("source"), fqn=F.lower("source")),
        _node(stores, dataset_id(F.col("file")), "Table", F.col("file"), fqn=F.lower("file")),
        _node(attributes, attribute, "Attribute", F.col("name")),
        _node(inner, script_attribute("origin", "source"), "Attribute", F.col("source")),
        _node(outer, dataset_id(F.col("origin")), "Table", F.col("origin"), fqn=F.lower("origin")),
        _node(outer, column, "Attribute", F.col("source")),
    ]
    edges = [
        _edge(outer, dataset_id(F.col("origin")), column, "HAS_COLUMN"),
        *[_edge(part.filter(F.col("rel") == rel), attribute, to, rel, F.col("transform")) for part, to in ((inner, script_attribute("origin", "source")), (outer, column)) for rel in ("DERIVES_FROM", "REFERENCES_FK")],
        _edge(mapped, attribute, own("mapping"), "MAPS_TO"),
        _edge(sets, script, own("name"), "CONTAINS_TABLE"),
        _edge(outside, own("name"), dataset_id(F.col("source")), "SOURCED_FROM"),
        _edge(inside, own("name"), own("source"), "DERIVES_FROM"),
        _edge(attributes, own("dataset"), attribute, "HAS_ATTRIBUTE"),
        _edge(stores, own("dataset"), dataset_id(F.col("file")), "STORED_AS"),
    ]
    return _settled(nodes), merge_edges(union_all(edges))


def _settled(parts: list[DataFrame]) -> DataFrame:
    """One row per id: of several the least label, name and labels, and the props of which there are most, ties by their text."""
    rows = union_all(parts).filter("id IS NOT NULL")
    fullest = F.struct(F.size("props").alias("n"), F.to_json("props").alias("text"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "name", "labels")).alias("x"), F.max_by("props", fullest).alias("props"))
    return rows.select("id", "x.label", "x.labels", "x.name", "props")


def stitched(nodes: DataFrame) -> DataFrame:
    """INVOKES_FILE edges: scripts that jobs run, to the files their command lines name, by base name."""
    commands = nodes.filter("label = 'Script'").select(F.col("id").alias("src"), F.explode(F.array_distinct(F.split(F.trim(F.col("props")["path"]), r"\s+"))).alias("token"))
    commands = commands.withColumn("base", basename(F.col("token"))).filter(F.col("base").rlike(r"\.\w+$"))
    files = nodes.filter(F.col("label").isin("SparkScript", "SqlScript", "QlikScript", "TableauWorkbook")).select(F.col("id").alias("dst"), F.lower("name").alias("base"))
    return commands.join(files, "base").select("src", "dst", F.lit("INVOKES_FILE").alias("rel"), F.lit("").alias("key")).distinct()


def combine(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One graph of several, stitched; edges need both ends. Both are written: questions join the edges many times."""
    nodes = written(_settled([n for n, _ in graphs]), "nodes")
    edges = written(union_all([e for _, e in graphs]), "edges")
    edges = merge_edges(edges.unionByName(stitched(nodes)))
    return nodes, written(guarded_edges(edges, nodes).select("src", "dst", "rel", "key"), "edges")


def answer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dashboard, table, script, job, schedule, start_time): who fills what a dashboard shows, and when."""
    hop = lambda rel, a, b: edges.filter(F.col("rel") == rel).select(F.col("src").alias(a), F.col("dst").alias(b))
    name = lambda label, c: nodes.filter(F.col("label") == label).select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    chain = hop("DISPLAYS_WORKSHEET", "dashboard", "worksheet").join(hop("READS_DATASOURCE", "worksheet", "datasource"), "worksheet").join(hop("READS_TABLE", "datasource", "table"), "datasource")
    chain = chain.join(hop("WRITES_TABLE", "dataframe", "table"), "table").join(hop("CONTAINS_DATAFRAME", "file", "dataframe"), "dataframe")
    chain = chain.join(hop("INVOKES_FILE", "script", "file"), "file").join(hop("EXECUTES", "job", "script"), "script").join(hop("CONTAINS_JOB", "schedule", "job"), "job")
    start = nodes.filter("label = 'Schedule'").select(F.col("id").alias("schedule"), F.col("name").alias("schedule_name"), F.col("props")["start_time"].alias("start_time"))
    out = chain.join(name("TableauDashboard", "dashboard"), "dashboard").join(name("Table", "table"), "table").join(name("SparkScript", "file"), "file").join(name("Job", "job"), "job").join(start, "schedule")
    return out.select(F.col("dashboard_name").alias("dashboard"), F.lower("table_name").alias("table"), F.col("file_name").alias("script"), F.col("job_name").alias("job"), F.col("schedule_name").alias("schedule"), "start_time").distinct()
