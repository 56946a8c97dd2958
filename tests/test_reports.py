"""The reports and the batch job, end to end."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fixtures import FIVE_MINUTES, GOLDEN, HEADER, PER_MINUTE, line
from gatetally import __main__ as command
from gatetally.operators import parse_gateway_logs
from gatetally.plans import (
    REPORTS,
    Report,
    all_report_lines,
    report_counts,
    report_lines,
    report_named,
    run_batch,
)
from gatetally.sources import lines_from


def values(df):
    return sorted(row.value for row in df.collect())


@pytest.mark.parametrize("name", GOLDEN)
def test_batch_report(spark, name):
    lines, report, stream, more = GOLDEN[name]
    logs = parse_gateway_logs(lines_from(spark, lines))
    assert values(report_lines(logs, report_named(report))) == sorted(stream + more)


def test_report_counts_keep_keys_apart(spark):
    # As text both keys read a:b:c; they are not counted together.
    lines = [line("17:26:04", "b:c", service="a"), line("17:26:04", "c", service="a:b")]
    logs = parse_gateway_logs(lines_from(spark, lines))
    report = report_named("countOfAPIPerMinuteByHttpMethods")
    assert sorted((r.microservice, r.type, r.n) for r in report_counts(logs, report).collect()) == [
        ("a", "b:c", 1),
        ("a:b", "c", 1),
    ]
    assert len(values(report_lines(logs, report))) == 2
    joint = all_report_lines(logs).filter(F.col("report") == report.name)
    assert len(values(joint)) == 2


def test_all_reports_equal_single_reports(spark):
    logs = parse_gateway_logs(lines_from(spark, FIVE_MINUTES + PER_MINUTE))
    single = [(r.name, v) for r in REPORTS for v in values(report_lines(logs, r))]
    joint = [(row.report, row.value) for row in all_report_lines(logs).collect()]
    assert sorted(joint) == sorted(single)


def test_all_reports_with_windows_that_do_not_nest(spark):
    reports = (
        Report("a", ("type",), "90 seconds"),
        Report("b", ("apiUrl", "type"), "1 minute"),
        Report("c", (), "1 hour"),
    )
    logs = parse_gateway_logs(lines_from(spark, FIVE_MINUTES))
    single = [(r.name, v) for r in reports for v in values(report_lines(logs, r))]
    joint = [(row.report, row.value) for row in all_report_lines(logs, reports).collect()]
    assert sorted(joint) == sorted(single)


def test_unknown_report():
    with pytest.raises(ValueError, match="no report named"):
        report_named("calls")


def test_batch_job(spark, folder):
    lines_from(spark, FIVE_MINUTES).write.text(f"{folder}/logs")
    run_batch(spark, f"{folder}/logs", f"{folder}/out")
    logs = parse_gateway_logs(lines_from(spark, FIVE_MINUTES))
    for report in REPORTS:
        written = values(spark.read.text(f"{folder}/out/{report.name}"))
        assert written == values(report_lines(logs, report))
    with pytest.raises(FileExistsError):
        run_batch(spark, f"{folder}/logs", f"{folder}/out")
    # The intermediate tables are gone.
    root = spark.conf.get("spark.checkpoint.dir")
    assert [x for x in os.listdir(root) if x.startswith(("reports-", "records-"))] == []


def test_batch_job_checks_all_targets_first(spark, folder):
    lines_from(spark, FIVE_MINUTES).write.text(f"{folder}/logs")
    for taken in (f"{folder}/out/{REPORTS[1].name}", f"{folder}/bad"):
        os.makedirs(taken)
        with pytest.raises(FileExistsError, match=taken):
            run_batch(spark, f"{folder}/logs", f"{folder}/out", f"{folder}/bad")
        assert not os.path.exists(f"{folder}/out/{REPORTS[0].name}")
        os.rmdir(taken)
    run_batch(spark, f"{folder}/logs", f"{folder}/out", f"{folder}/bad", wholetext=False)


def test_batch_job_with_malformed_lines(spark, folder):
    lines_from(spark, [*PER_MINUTE, "", "short,line"]).write.text(f"{folder}/logs")
    with pytest.raises(PySparkException, match="Malformed gateway log line"):
        run_batch(spark, f"{folder}/logs", f"{folder}/failed")
    run_batch(spark, f"{folder}/logs", f"{folder}/out", quarantine=f"{folder}/bad")
    assert values(spark.read.text(f"{folder}/bad")) == ["", "short,line"]
    _, report, stream, more = GOLDEN["per_minute"]
    assert values(spark.read.text(f"{folder}/out/{report}")) == sorted(stream + more)


def test_no_data_lines(spark, folder):
    lines_from(spark, [HEADER]).write.text(f"{folder}/logs")
    run_batch(spark, f"{folder}/logs", f"{folder}/out")
    for report in REPORTS:
        assert values(spark.read.text(f"{folder}/out/{report.name}")) == []


def test_command_line(spark, folder):
    lines_from(spark, PER_MINUTE).write.text(f"{folder}/logs")
    command.main(["batch", f"{folder}/logs", f"{folder}/batch"])
    command.main(
        ["stream", f"{folder}/logs", f"{folder}/stream", "--checkpoints", f"{folder}/c", "--once"]
    )
    _, report, stream, more = GOLDEN["per_minute"]
    assert values(spark.read.text(f"{folder}/batch/{report}")) == sorted(stream + more)
    streamed = spark.read.text(f"{folder}/stream/1-minute").filter(f"report = '{report}'")
    assert values(streamed.select("value")) == sorted(stream)
    with pytest.raises(SystemExit):
        command.main(["stream", f"{folder}/logs", f"{folder}/stream"])
