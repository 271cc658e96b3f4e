"""Scalar functions over artefact texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.functions import ids, text


def _one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [("0530", "05:30"), ("5:30", "05:30"), ("2400", None), ("1260", None), ("x", None), (None, None)])
def test_clock_time(spark, raw, want):
    assert _one(spark, text.clock_time, raw) == want


def test_urls_lose_credentials(spark):
    assert _one(spark, text.scrubbed_url, "https://u:p@h/x?token=abc&b=1") == "https://h/x?token=***&b=1"
    assert _one(spark, text.has_credentials, {"sf.Password": "x"}, "map<string,string>") is False
    assert _one(spark, text.has_credentials, {"password": "x"}, "map<string,string>") is True
    assert _one(spark, text.scrubbed_options, {"password": "x", "url": "u"}, "map<string,string>") == {"url": "u"}


def test_ids_agree_with_python(spark):
    row = spark.createDataFrame([(" A ", "b")], "a string, b string").select(ids.canonical_id(F.col("a"), F.col("b")).alias("y")).first()
    assert row.y == ids.make_id("a", "B ")


def test_tables_are_one_whatever_their_spelling(spark):
    same = ["db.S.T", "`DB`.`s`.`t`", "[db].[s].[t]"]
    assert len({_one(spark, ids.table_id, x) for x in same}) == 1
    assert _one(spark, lambda c: ids.table_id(c, "db", "s"), "t") == _one(spark, ids.table_id, "db.s.t")


def test_connections_are_one_whatever_the_tool(spark):
    a = spark.range(1).select(ids.connection_id(F.lit("jdbc:postgresql"), F.lit("H"), F.lit("d"), F.lit(5432)).alias("y")).first().y
    b = spark.range(1).select(ids.connection_id(F.lit("postgres"), F.lit("h"), F.lit("d")).alias("y")).first().y
    assert a == b


def test_paths_are_one(spark):
    assert _one(spark, ids.path_id, "s3a://b/x//y/") == _one(spark, ids.path_id, "s3://b/x/y")


def test_bracket_escapes_and_literals(spark):
    assert _one(spark, text.bracket_refs, "[a]]b] + '[no]' + [c]") == ["a]b", "c"]
