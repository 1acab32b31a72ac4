"""Bounds of times whose seconds have fractions, beside the query's DuckDB SQL."""

import duckdb
import pytest

from threadloom.plans.queries import ORACLE, QUERIES

DAY = "2024-01-01 00:00:0"


@pytest.mark.parametrize(
    ("times", "seconds"),
    [
        ([f"{DAY}1.778549", f"{DAY}5.220708", None], (2, 5)),
        ([f"{DAY}1.5", f"{DAY}2.5"], (2, 2)),
        ([f"{DAY}1.499999", f"{DAY}8.500001"], (1, 9)),
        (["1969-12-31 23:59:57.5", "1969-12-31 23:59:58.7", "1969-12-31 23:59:58"], (-1704067202, -1704067201)),
        ([None], None),
    ],
)
def test_fractions(spark, tmp_path, times, seconds):
    at = f"{tmp_path}/events.parquet"
    spark.createDataFrame([(t,) for t in times], "ts string").selectExpr("CAST(ts AS timestamp_ntz) AS ts").coalesce(1).write.parquet(at)
    found = [tuple(r) for r in QUERIES["time_bounds"](spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/*.parquet'")
    assert found == db.execute(ORACLE["time_bounds"]).fetchall()
    present = sum(t is not None for t in times)
    low, high = (None, None) if seconds is None else (1704067200 + s for s in seconds)
    assert found == [("ts", low, high, present, len(times) - present)]
