"""Written tables."""

from __future__ import annotations

import pytest

from strandline.plans.storage import discard, shared_dir, written


def test_written_table_is_read_back_and_discarded(spark):
    df = written(spark.range(5), "test")
    assert df.count() == 5 and df.written_at.startswith(shared_dir(spark))
    discard(df)
    with pytest.raises(Exception, match="(?i)not exist|no such|PATH"):
        spark.read.parquet(df.written_at)


def test_shared_dir_is_what_the_session_names(spark):
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
