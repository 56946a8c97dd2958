"""Every registered query against its SQL, over the given tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as driver
from gatetally.sources import gateway_lines

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    yield connection
    connection.close()


# The training-data queries, where that part is there, are tested with it.
OWN = [name for name in driver.queries() if name not in driver.LLM_QUERIES]


def test_every_query_has_sql():
    assert set(OWN) <= driver.oracle_sql().keys() <= driver.queries().keys()


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, tables, name):
    got = driver.queries()[name](spark, SF_DIR)
    result = tables.sql(driver.oracle_sql()[name])
    columns = sorted(result.columns)
    assert sorted(got.columns) == columns
    rows = sorted(tuple(row) for row in got.select(*columns).collect())
    expected = sorted(result.select(*(f'"{c}"' for c in columns)).fetchall())
    assert len(rows) > 0
    assert rows == expected


@pytest.mark.parametrize(
    "name", ["header_filter", "parse_gateway_logs", "window_counts", "all_reports", "watermark"]
)
def test_session_settings_play_no_part(spark, tables, name):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    session.conf.set("spark.sql.ansi.enabled", "false")
    got = driver.queries()[name](session, SF_DIR)
    result = tables.sql(driver.oracle_sql()[name])
    columns = sorted(result.columns)
    rows = sorted(tuple(row) for row in got.select(*columns).collect())
    assert rows == sorted(result.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", [n for n in driver.queries() if n.endswith(("_append", "_sink", "watermark"))])
def test_streamed_table_as_a_directory(spark, tables, folder, name):
    """The same table as several files in a directory."""
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    events.repartition(5).write.parquet(f"{folder}/events.parquet")
    got = driver.queries()[name](spark, folder)
    result = tables.sql(driver.oracle_sql()[name])
    columns = sorted(result.columns)
    rows = sorted(tuple(row) for row in got.select(*columns).collect())
    assert rows == sorted(result.select(*(f'"{c}"' for c in columns)).fetchall())


def test_watermark_of_no_records(spark, folder):
    spark.read.parquet(f"{SF_DIR}/events.parquet").limit(0).write.parquet(f"{folder}/events.parquet")
    assert driver.queries()["watermark"](spark, folder).collect() == []


def test_events_as_lines(spark):
    """Times without a zone become UTC text, cut to milliseconds, in any session zone."""
    times = {
        "2024-01-01 00:00:07": "2024-01-01T00:00:07.000",
        "2024-01-01 00:00:07.5": "2024-01-01T00:00:07.500",
        "2024-01-01 00:00:07.999999": "2024-01-01T00:00:07.999",
        "2018-03-11 02:30:00.25": "2018-03-11T02:30:00.250",
    }
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    events = session.createDataFrame([(t,) for t in times], "t string").selectExpr(
        "cast(t as timestamp_ntz) as ts", "11L as user_id", "'view' as event_type"
    )
    got = [row.value for row in gateway_lines(events).collect()]
    assert got == [f"{text}+0000,GA.VIEW,/users/11,svc-3" for text in times.values()]


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["report", "value"]
    assert result.count() > 0
