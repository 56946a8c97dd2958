"""The physical plans: one pass, one parse per line, counts before the shuffle, no Python."""

from __future__ import annotations

import re

import pytest

from fixtures import FIVE_MINUTES
from gatetally.operators import malformed_rows, parse_gateway_logs
from gatetally.plans import REPORTS, all_report_lines, report_lines, stream_lines
from gatetally.plans.records import table_records
from gatetally.sources import lines_from, read_lines


@pytest.fixture
def logs_path(spark, folder):
    lines_from(spark, FIVE_MINUTES).write.text(f"{folder}/logs")
    return f"{folder}/logs"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(text: str, name: str) -> int:
    return len(re.findall(rf"^[\s:+\-*()\d]*{name}\b", text, flags=re.MULTILINE))


def assert_lean(text: str, shuffles: int) -> None:
    assert nodes(text, "FileScan text") == 1
    assert nodes(text, "Exchange") == shuffles
    assert text.count("gettimestamp") == 1
    assert text.count("split(") == 1
    assert "Python" not in text and "Broadcast" not in text and "Sort" not in text
    assert "ReadSchema: struct<value:string>" in text


@pytest.mark.parametrize("mode", ["failfast", "quarantine"])
@pytest.mark.parametrize("report", REPORTS, ids=lambda r: r.name)
def test_report_plan(spark, logs_path, report, mode):
    logs = parse_gateway_logs(read_lines(spark, logs_path), mode)
    text = plan(report_lines(logs, report))
    assert_lean(text, shuffles=1)
    assert text.index("partial_count") > text.index("Exchange")
    assert "apiUrl" not in text
    # Spread by window and key, so that a key with much of the data isn't one task.
    assert re.search(r"hashpartitioning\(window#\d+, microservice#\d+", text)


@pytest.mark.parametrize("mode", ["failfast", "quarantine"])
def test_all_reports_plan(spark, logs_path, mode):
    logs = parse_gateway_logs(read_lines(spark, logs_path), mode)
    text = plan(all_report_lines(logs))
    assert_lean(text, shuffles=2)
    # Read bottom up: count, shuffle, fan out the counts, sum, shuffle.
    order = ["partial_count", "Generate explode(array(struct(key", "partial_sum"]
    positions = [text.index(step) for step in order]
    assert positions == sorted(positions, reverse=True)


@pytest.mark.parametrize("mode", ["failfast", "quarantine"])
def test_plan_of_all_reports_as_a_stream(spark, logs_path, mode):
    """As a stream has it: fan out, count, shuffle."""
    logs = parse_gateway_logs(read_lines(spark, logs_path), mode)
    text = plan(stream_lines(logs))
    assert_lean(text, shuffles=1)
    order = ["Exchange", "partial_count", "Generate explode(array(struct(key"]
    positions = [text.index(step) for step in order]
    assert positions == sorted(positions)


def test_malformed_rows_plan(spark, logs_path):
    text = plan(malformed_rows(read_lines(spark, logs_path)))
    assert_lean(text, shuffles=0)


def test_table_records_plan(spark, logs_path):
    """With or without malformed lines, the table takes one pass and one parse."""
    lines = read_lines(spark, logs_path)
    assert_lean(plan(table_records(lines, REPORTS, quarantine=False)), shuffles=0)
    text = plan(table_records(lines, REPORTS, quarantine=True))
    assert_lean(text, shuffles=0)
    assert "apiUrl" not in text


def shuffled_rows(df) -> list[int]:
    """Rows each shuffle wrote, from the plan that ran; without adaptive execution."""
    found, node = [], df._jdf.queryExecution().executedPlan()
    while node is not None:
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        node = node.children().apply(0) if node.children().nonEmpty() else None
    return found


def test_hot_key_shuffles_counts_only(spark, folder):
    """A third of the lines under one key: what is shuffled is a row per group and partition."""
    partitions, lines, services = 4, 12000, 6
    spark.range(lines, numPartitions=partitions).selectExpr(
        "concat('2018-03-12T17:26:', lpad(cast(id % 60 as string), 2, '0'), '.000-0700,GA.GET,/,',"
        " if(id % 3 = 0, 'hot', concat('svc-', id % 5))) as value"
    ).write.text(f"{folder}/logs")
    logs = parse_gateway_logs(read_lines(spark, f"{folder}/logs"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        single, joint = report_lines(logs, REPORTS[0]), all_report_lines(logs)
        counts = {row.value: int(row.value.rsplit(" ", 1)[1]) for row in single.collect()}
        assert sum(counts.values()) == lines
        assert max(counts.values()) == lines // 3
        assert shuffled_rows(single) == [partitions * services]
        assert len(joint.collect()) == 4 * services
        assert shuffled_rows(joint) == [4 * services, partitions * services]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
