from __future__ import annotations

import duckdb
import pytest

from strandline.catalog import collect
from tests.compare import assert_same

QUERIES, SQL = collect()
ODD = {"none": [0.0], "beside others": [0.0, 0.01, 3.0, 40.0, 500.0], "odd": [0.0, -0.0, -5.0, float("nan"), float("inf"), None, 7.0]}


@pytest.mark.parametrize("name", ODD)
def test_caps_of_clips_without_length(spark, tmp_path, name):
    """A duration of 0 has a rate beyond every cap and leaves one frame."""
    path = tmp_path / "events.parquet"
    rows = [(i, i, "view", v, '{"k": 3}') for i, v in enumerate(ODD[name])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").selectExpr("*", "timestamp_seconds(event_id) as ts").coalesce(1).write.parquet(str(path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    assert_same(QUERIES["fps_cap_stats"](spark, str(tmp_path)), con.sql(SQL["fps_cap_stats"]))
