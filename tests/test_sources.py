"""Parsers on texts of their own, robustness, and streaming against batch."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from strandline.plans.sql_lineage import extract_lineage, rewrite_qualify, split_statements
from strandline.sinks import tables
from strandline.sources import notebooks, qlik, tws
from strandline.sources.artifacts import entities, parse, read_texts
from strandline.sources.connectors import derive_connection
from strandline.sources.pyspark_ast import parse_pyspark
from strandline.streaming import events as streaming


def _kinds(rows, kind):
    return [p for k, p in rows if k == kind]


def test_pyspark_inlines_functions_and_folds_strings():
    rows = parse_pyspark("x", "ENV = 'a'\ndef load(n, fmt='parquet'):\n    return spark.read.format(fmt).load(f's3://{ENV}/{n}')\ndf = load('orders')\ndf.write.saveAsTable('t.%s' % ENV)\n")
    assert _kinds(rows, "read")[0]["target"] == "s3://a/orders"
    assert _kinds(rows, "write")[0]["target"] == "t.a"


def test_pyspark_refuses_recursion_and_tells_dynamic_code():
    rows = parse_pyspark("x", "def f(d):\n    return f(d)\nx = f(spark.table('a'))\neval('1')\n")
    assert {d["code"] for d in _kinds(rows, "diagnostic")} >= {"recursion", "runtime_dynamic"}


def test_pyspark_loop_is_partial_and_syntax_error_is_told():
    rows = parse_pyspark("x", "for n in names():\n    spark.table('a').write.saveAsTable('b')\n")
    assert all(f["partial"] for f in _kinds(rows, "frame"))
    assert parse_pyspark("x", "def (")[0][1]["code"] == "syntax_error"


def test_pyspark_class_methods_views_and_temp_view_reads():
    rows = parse_pyspark("x", "class Job:\n    def go(self, d):\n        return d.filter('x')\nj = Job()\na = j.go(spark.table('s.a'))\na.createOrReplaceTempView('v')\nb = spark.table('v')\n")
    assert [r["target"] for r in _kinds(rows, "read")] == ["s.a"] and _kinds(rows, "view")[0]["name"] == "v"


def test_connections_settle_hosts_and_ports():
    a = derive_connection("jdbc", {"url": "jdbc:postgresql://localhost/db", "dbtable": "t"})
    b = derive_connection("jdbc", {"url": "jdbc:postgresql://127.0.0.1:5432/db", "dbtable": "u"})
    assert a.id == b.id
    assert not derive_connection("jdbc", {}).resolved
    assert derive_connection("kafka", {"kafka.bootstrap.servers": "b:9092,a:9092", "subscribe": "t"}).server == "a"


def test_sql_statements_and_qualify(spark):
    assert split_statements("SELECT ';' ; -- a;b\nSELECT 2;") == ["SELECT ';'", "SELECT 2"]
    assert "QUALIFY" not in rewrite_qualify("SELECT a FROM t QUALIFY row_number() OVER (ORDER BY a) = 1")
    found = extract_lineage(spark, "INSERT INTO a SELECT x FROM b; INSERT INTO c SELECT x FROM a", parity=True)
    assert found.targets == ["a", "c"] and found.sources == ["b"]
    assert extract_lineage(spark, "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT n FROM r").sources == []


def test_composer_never_takes_malformed_for_good():
    rows = tws.parse_scheduler("x", "SCHEDULE A#B\n:\n  J\n    SCRIPTNAME \"x\"\n    @@@ what is this @@@\nEND\n")
    assert _kinds(rows, "diagnostic")[0]["level"] == "error" and len(_kinds(rows, "job")) == 1
    assert _kinds(tws.parse_scheduler("x", "CPUNAME A\nEND\n"), "workstation")[0]["name"] == "A"


def test_scheduler_xml_export_shape():
    rows = tws.parse_scheduler("x", "<scheduleDefinitions><schedule><workstation>W</workstation><name>S</name><startTime>05:30</startTime><jobs><job><name>A</name></job><job><name>B</name><follows><dependency><job>A</job></dependency></follows></job></jobs></schedule></scheduleDefinitions>")
    assert _kinds(rows, "schedule")[0]["start_time"] == "05:30" and _kinds(rows, "follows")[0]["job"] == "A"


def test_load_script_includes_macros_and_guards():
    files = {"lib/a.qvs": "SET x = 1;\n$(Include=lib/b.qvs);", "lib/b.qvs": "$(Include=lib/a.qvs);"}
    rows = qlik.parse_load_script("m", "$(Include=lib/a.qvs);\n$(Must_Include=none.qvs);\nT: LOAD a$(x) FROM [f.qvd] (qvd);", files)
    assert {d["code"] for d in _kinds(rows, "diagnostic")} >= {"include_cycle", "include_missing"}
    assert [a["name"] for a in _kinds(rows, "attribute")] == ["a1"]


def test_load_script_inline_and_star():
    rows = qlik.parse_load_script("m", "A: LOAD * INLINE [p, q\n1, 2];\nB: LOAD * RESIDENT A;")
    assert [(a["dataset"], a["name"]) for a in _kinds(rows, "attribute")] == [("A", "p"), ("A", "q"), ("B", "p"), ("B", "q")]


def test_archive_of_notebooks(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("n.python", json.dumps({"language": "python", "commands": [{"command": "x = 1"}, {"command": "%sql SELECT 1"}]}))
    cells = notebooks.archive_cells(spark.createDataFrame([("a.dbc", bytearray(held.getvalue()))], "path string, content binary"))
    assert [(c.language, c.source) for c in cells.orderBy("index").collect()] == [("python", "x = 1"), ("sql", "SELECT 1")]
    assert "spark.sql" in notebooks.assembled(cells).first().content


def test_parser_failure_is_a_diagnostic(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<broken")
    rows = parse(read_texts(spark, str(tmp_path)), tws.parse_scheduler)
    assert entities(rows, "diagnostic", "level string, code string").first().code == "ParseError"


def test_graph_written_twice_is_the_same(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "T", "x"), ("b", "T", "y")], "id string, label string, name string")
    edges = spark.createDataFrame([("a", "b", "R", "")], "src string, dst string, rel string, key string")
    path = str(tmp_path / "g")
    tables.write_graph(nodes, edges, path)
    for _ in range(2):
        tables.merge_graph(spark, nodes, edges, path)
    n, e = tables.read_graph(spark, path)
    assert n.count() == 2 and e.count() == 1


def test_scheduler_mirror(spark):
    rows = parse(spark.createDataFrame([("x", "SCHEDULE W#S\n:\n A\n NEEDS 2 W#R\n B\n FOLLOWS A\nEND\n")], "path string, content string"), tws.parse_scheduler)
    mirror = tables.scheduler_mirror(rows)
    assert mirror["jobs"].count() == 2 and mirror["job_dependencies"].count() == 1 and mirror["job_resources"].first().quantity == 2


def test_stream_of_available_files_gives_what_batch_gives(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    source = streaming.read_stream(spark, folder, events)
    streaming.run_available(streaming.first_seen(source.withColumn("ts", F.col("ts")), ["event_id"], "3650 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == events.dropDuplicates(["event_id"]).count()
    counts = streaming.windowed_counts(source, late="3650 days")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, streaming.windowed_counts(events).collect()))


def test_ingest_is_incremental(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "a.txt").write_text("SCHEDULE W#S\n:\n A\nEND\n")
    for n in (1, 2):
        streaming.ingest_artifacts(spark, str(folder), tws.parse_scheduler, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert spark.read.parquet(str(tmp_path / "out")).filter("kind = 'job'").count() == n
        (folder / f"b{n}.txt").write_text(f"SCHEDULE W#T{n}\n:\n B\nEND\n")


def test_scripts_inside_an_sqlite_app():
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE props (id INTEGER, content TEXT)")
    db.execute("INSERT INTO props VALUES (1, ?)", (json.dumps({"qScript": "SET a = 1;\nT: LOAD x FROM [f.csv];"}),))
    db.execute("INSERT INTO props VALUES (2, 'nothing here')")
    db.commit()
    found = qlik.app_scripts(db.serialize())
    assert len(found) == 1 and found[0].startswith("SET a")


def test_connection_store_takes_the_first_kind_that_has_it():
    stores = {"c/Ops.dconn": "provider=x;server=a", "settings.ini": "[ops]\nserver=b\n[other]\nserver=c\n"}
    assert qlik.connection_store(stores, "OPS")["string"] == "provider=x;server=a"
    assert qlik.connection_store(stores, "other")["string"] == "server=c"
    assert qlik.connection_store(stores, "none") is None


def test_compound_file_streams():
    """A smallest compound file: one FAT sector, one directory sector, one stream of a sector, and no mini stream."""
    import struct

    script = ("LOAD a FROM b; SQL SELECT c FROM d; STORE t INTO u; SET x = 1; " * 80).encode()
    script = script[: 512 * (len(script) // 512)]
    n = len(script) // 512
    header = bytearray(512)
    header[:8] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    struct.pack_into("<HHHHH", header, 24, 0x3E, 3, 0xFFFE, 9, 6)
    struct.pack_into("<I", header, 44, 1)
    struct.pack_into("<I", header, 48, 1)
    struct.pack_into("<I", header, 56, 4096)
    struct.pack_into("<II", header, 60, 0xFFFFFFFE, 0)
    struct.pack_into("<II", header, 68, 0xFFFFFFFE, 0)
    struct.pack_into("<109I", header, 76, 0, *[0xFFFFFFFF] * 108)
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 2 + n), 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))

    def entry(name: str, kind: int, start: int, size: int) -> bytes:
        e = bytearray(128)
        raw = name.encode("utf-16-le") + b"\0\0"
        e[: len(raw)] = raw
        struct.pack_into("<H", e, 64, len(raw))
        e[66] = kind
        struct.pack_into("<I", e, 116, start)
        struct.pack_into("<Q", e, 120, size)
        return bytes(e)

    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Script", 2, 2, len(script)) + bytes(256)
    content = bytes(header) + struct.pack("<128I", *fat) + directory + script
    assert qlik.compound_streams(content)["Script"] == script
    assert qlik.script_of_binary(content).startswith("LOAD a FROM b")


def test_stage_dump_has_a_folder_per_kind(spark, tmp_path):
    rows = parse(spark.createDataFrame([("x", "SCHEDULE W#S\n:\n A\nEND\n")], "path string, content string"), tws.parse_scheduler)
    tables.dump_stages(rows, str(tmp_path / "d"))
    back = spark.read.json(str(tmp_path / "d"))
    assert {r.kind for r in back.select("kind").distinct().collect()} == {"workstation", "schedule", "job"}
    tables.export_json(back, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == back.count()


def test_qualify_is_cut_at_the_select_list():
    sql = rewrite_qualify("WITH c AS (SELECT a, b FROM t) SELECT a, extract(year FROM b) AS y, 'FROM QUALIFY' AS z FROM c WHERE a > 0 QUALIFY row_number() OVER (PARTITION BY y ORDER BY a) = 1 ORDER BY a")
    assert sql == "WITH c AS (SELECT a, b FROM t) SELECT * EXCEPT (__qualify) FROM (SELECT a, extract(year FROM b) AS y, 'FROM QUALIFY' AS z, (row_number() OVER (PARTITION BY y ORDER BY a) = 1) AS __qualify FROM c WHERE a > 0) WHERE __qualify ORDER BY a"
    assert rewrite_qualify("SELECT 'QUALIFY' FROM t") == "SELECT 'QUALIFY' FROM t"


def test_columns_are_followed_through_frames():
    from strandline.sources.pyspark_ast import parse_pyspark

    text = "a = spark.table('raw.a')\nb = spark.table('raw.b')\nc = a.filter(a.x > 0).withColumn('y', F.col('x') * 2)\nd = c.join(b, 'id').withColumn('z', F.col('y') + F.col('w'))\nd.write.saveAsTable('mart.d')\n"
    rows = parse_pyspark("j.py", text)
    tables = {(x["column"], x["table"]) for k, x in rows if k == "column_table"}
    assert ("x", "raw.a") in tables and ("x", "raw.b") not in tables
    assert {("y", "mart.d"), ("z", "mart.d")} <= {(x["column"], x["table"]) for k, x in rows if k == "column_write"}
    steps = {(x["column"], x["src_column"]) for k, x in rows if k == "column_edge"}
    assert {("z", "y"), ("z", "w"), ("y", "x")} <= steps


def test_constraints_by_signal():
    from strandline.sources.qlik import constraints

    rows = [x for k, x in constraints({"A": ["AID", "City", "Zip"], "B": ["BKey", "City", "Zip"], "C": ["AID"]}, [("C", "A")], {"A": ["AID"]}) if k == "constraint"]
    found = {(x["dataset"], x["kind"], ",".join(x["columns"]), x["confidence"]) for x in rows}
    assert {("A", "unique", "AID", 0.7), ("C", "foreign_key", "AID", 0.6), ("A", "foreign_key", "City", 0.5), ("A", "synthetic_key", "City,Zip", 0.55), ("B", "primary_key", "BKey", 0.4)} <= found


def test_containers_of_accounts_and_hosts():
    from strandline.sources.connectors import canonical_host, derive_connection

    c = derive_connection("parquet", {}, "abfss://raw@lake.dfs.core.windows.net/a/b/")
    assert (c.klass, c.server, c.database, c.dataset) == ("adls", "lake.dfs.core.windows.net", "raw", "/a/b")
    assert [canonical_host(h) for h in ("LOCALHOST", "127.0.0.1", "::1", "0.0.0.0", " DB1 ", None)] == ["localhost"] * 4 + ["db1", ""]


def test_a_new_version_of_a_graph_is_seen_once_it_is_whole(spark, tmp_path):
    path = str(tmp_path / "g")
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    edges = spark.createDataFrame([("a", "b", "R", "")], "src string, dst string, rel string, key string")
    for _ in range(3):
        tables.write_graph(nodes, edges, path)
    assert tables.versions(spark, path) == [2, 3]
    (tmp_path / "g" / "v4" / "nodes").mkdir(parents=True)  # a writer that died
    assert tables.versions(spark, path) == [2, 3] and tables.read_graph(spark, path)[0].count() == 2
