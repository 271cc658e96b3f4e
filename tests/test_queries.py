"""Every query of the workload against its SQL twin, on the smallest tables."""

from __future__ import annotations

import pytest

from strandline import workload
from tests.compare import duck_rows, spark_rows

QUERIES, ORACLES = workload.queries(), workload.oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = spark_rows(df)
    if name not in ORACLES:
        assert df.columns
        return
    columns, want = duck_rows(duck, ORACLES[name])
    assert sorted(df.columns) == columns
    assert got == want
    # An empty answer proves nothing; at this size all suppliers have money.
    assert got or name == "g16_unresolved"


def test_source_view_cuts_at_two_mebi_characters_only(spark, tmp_path):
    cap = 2 * 1024 * 1024
    rows = [(1, "http://a/x.html?q", "y" * 5000 + "\nend"), (2, "http://a/y.sql", "z" * cap), (3, "http://a/z", "z" * cap + "\nlost"), (4, "http://a/n.py", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.id: r for r in QUERIES["g33_source_view_full"](spark, str(tmp_path)).collect()}
    assert {k: r.truncated for k, r in got.items()} == {1: False, 2: False, 3: True, 4: False}
    assert got[1].text == rows[0][2] and got[2].text == rows[1][2] and got[3].text == "z" * cap and got[4].text == ""
    assert [got[k].language for k in (1, 2, 3, 4)] == ["html", "sql", "text", "python"] and got[3].n_lines == 2


def test_qualify_takes_the_first_of_equal_lines_in_the_order_of_files_and_rows(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    # Equal lines lie far apart, and the file that is read last is the largest: Spark opens that one first.
    for k, rows in enumerate((3_000, 6_000, 12_000)):
        at = range(rows)
        columns = {"l_orderkey": [i % 500 for i in at], "l_linenumber": pa.array([i % 3 for i in at], pa.int32()), "l_quantity": [float(1_000_000 * k + (i * 7919) % rows) for i in at]}
        pq.write_table(pa.table(columns), folder / f"part-{k}.parquet", row_group_size=1_000)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    try:
        got = spark_rows(QUERIES["w6_qualify"](spark, str(tmp_path)))
    finally:
        spark.conf.set(key, before)
    assert len(got) == 500 and got == duck_rows(con, ORACLES["w6_qualify"])[1]


def test_payload_has_every_path_of_a_nation_with_many_customers(spark, tmp_path):
    import duckdb

    tables = {
        "region": "SELECT 0::BIGINT AS r_regionkey, 'R' AS r_name",
        "nation": "SELECT 0::BIGINT AS n_nationkey, 'N' AS n_name, 0::BIGINT AS n_regionkey",
        "customer": "SELECT range AS c_custkey, 'C' || range AS c_name, 0::BIGINT AS c_nationkey FROM range(700)",
        "orders": "SELECT range AS o_orderkey, 'O' AS o_orderstatus, range % 3 AS o_custkey FROM range(9)",
    }
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path / name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}.parquet'")
    got = spark_rows(QUERIES["g18_dedupe_payload"](spark, str(tmp_path)))
    # 700 customers, nation, region and three orders; an edge to each but the region's own end.
    assert len(got) == 705 + 704 and got == duck_rows(con, ORACLES["g18_dedupe_payload"])[1]


def test_entry_runs(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
