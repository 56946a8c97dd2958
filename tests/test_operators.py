"""The operators one by one, on small frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fixtures import CUSTOMERS, FILTER_INPUT, HEADER, LOGS, SERVICE, TWO_WINDOWS, instant, line
from gatetally.constants import GATEWAY_LOG, ONE_MINUTE
from gatetally.operators import (
    aggregate_by_window,
    count_by_window,
    drop_headers,
    malformed_rows,
    parse_gateway_logs,
    with_event_time,
)
from gatetally.sources import lines_from, logs_from, read_lines

BAD_LINES = {
    "blank": "",
    "separators": ",,,,",
    "three_fields": f"{line('17:26:04').rsplit(',', 1)[0]}",
    "empty_last_field": f"{line('17:26:04').rsplit(',', 1)[0]},",
    "no_time": f",GA.GET,{CUSTOMERS},{SERVICE}",
    "month_13": "2018-13-12T17:26:04.000-0700,a,b,m",
    "february_30": "2018-02-30T17:26:04.000-0700,a,b,m",
    "trailing_text": "2018-03-12T17:26:04.000-0700x,a,b,m",
    "leading_blank": " 2018-03-12T17:26:04.000-0700,a,b,m",
    "zulu": "2018-03-12T17:26:04.000Z,a,b,m",
    "colon_in_offset": "2018-03-12T17:26:04.000-07:00,a,b,m",
    "no_millis": "2018-03-12T17:26:04-0700,a,b,m",
    "text": "not a log line",
    "tenths": "2018-03-12T17:26:04.5-0700,a,b,m",
    "hundredths": "2018-03-12T17:26:04.05-0700,a,b,m",
    "four_digits": "2018-03-12T17:26:04.0005-0700,a,b,m",
    "five_digit_year": "+12018-03-12T17:26:04.000-0700,a,b,m",
    "five_digit_year_in_28": "+12018-03-12T17:26:04.0-0700,a,b,m",
}


def values(df):
    return [row.value for row in df.collect()]


def records(df):
    millis = F.unix_millis("timestamp").alias("ms")
    return [tuple(row) for row in df.select(millis, "apiUrl", "type", "microservice").collect()]


def test_header_is_dropped_and_data_kept(spark):
    assert values(drop_headers(lines_from(spark, FILTER_INPUT))) == FILTER_INPUT[1:]


def test_marker_counts_anywhere_and_by_case(spark):
    in_url = line("17:26:04", url="/v1/run_time/")
    upper = line("17:26:04", url="/v1/_TIME/")
    assert values(drop_headers(lines_from(spark, [in_url, upper, HEADER]))) == [upper]
    assert values(drop_headers(lines_from(spark, [in_url, upper]), marker="_TIME")) == [in_url]


def test_header_filter_keeps_null_lines_for_the_parser(spark):
    lines = lines_from(spark, [None, HEADER])
    assert values(drop_headers(lines)) == [None]
    assert values(malformed_rows(lines)) == [None]
    with pytest.raises(PySparkException, match="Malformed gateway log line: null"):
        parse_gateway_logs(lines).collect()


@pytest.mark.parametrize("mode", ["failfast", "quarantine"])
def test_parse(spark, mode):
    logs = parse_gateway_logs(lines_from(spark, [line("17:26:04")]), mode)
    assert [f.name for f in logs.schema] == [f.name for f in GATEWAY_LOG]
    assert [f.dataType for f in logs.schema] == [f.dataType for f in GATEWAY_LOG]
    assert records(logs) == [(1520900764000, CUSTOMERS, "GA.GET", SERVICE)]


@pytest.mark.parametrize("mode", ["failfast", "quarantine"])
def test_parse_drops_headers_by_itself(spark, mode):
    logs = parse_gateway_logs(lines_from(spark, FILTER_INPUT), mode)
    assert len(records(logs)) == 1
    # A filter on the parsed time is merged with the header filter; the header must not raise.
    assert logs.filter(F.col("timestamp") > F.timestamp_seconds(F.lit(1))).count() == 1


@pytest.mark.parametrize("mode", ["failfast", "quarantine"])
def test_fields(spark, mode):
    time = line("17:26:04").split(",")[0]
    lines = [
        f"{time},,,m",
        f"{time},a,b,m,x",
        f"{time},a,b,m,,,",
        f"{time},a,b,,x",
        f"{time},a,b, m ",
        f'{time},"a,b",c',
    ]
    ms = 1520900764000
    assert records(parse_gateway_logs(lines_from(spark, lines), mode)) == [
        (ms, "", "", "m"),
        (ms, "b", "a", "m"),
        (ms, "b", "a", "m"),
        (ms, "b", "a", ""),
        (ms, "b", "a", " m "),
        (ms, 'b"', '"a', "c"),
    ]


@pytest.mark.parametrize("name", BAD_LINES)
def test_malformed_line_fails(spark, name):
    logs = parse_gateway_logs(lines_from(spark, [line("17:26:04"), BAD_LINES[name]]))
    counts = count_by_window(with_event_time(logs), ONE_MINUTE, ["microservice"])
    with pytest.raises(PySparkException, match="Malformed gateway log line: "):
        counts.collect()


@pytest.mark.parametrize("name", ["blank", "three_fields", "month_13"])
def test_malformed_line_fails_whatever_is_used(spark, name):
    logs = parse_gateway_logs(lines_from(spark, [line("17:26:04"), BAD_LINES[name]]))
    for used in (logs, logs.select("microservice"), logs.groupBy("microservice").count()):
        with pytest.raises(PySparkException, match="Malformed gateway log line: "):
            used.count()


def test_legacy_time_parser_is_refused(spark):
    setting = "spark.sql.legacy.timeParserPolicy"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "LEGACY")
        with pytest.raises(ValueError, match="LEGACY"):
            parse_gateway_logs(lines_from(spark, [line("17:26:04")]))
    finally:
        spark.conf.set(setting, before)


def test_malformed_lines_are_set_apart(spark):
    lines = lines_from(spark, [HEADER, line("17:26:04"), *BAD_LINES.values(), line("17:26:05")])
    assert sorted(values(malformed_rows(lines))) == sorted(BAD_LINES.values())
    logs = parse_gateway_logs(lines, mode="quarantine")
    assert [row[0] for row in records(logs)] == [1520900764000, 1520900765000]
    counts = count_by_window(logs, ONE_MINUTE, ["microservice"])
    assert [row.n for row in counts.collect()] == [2]


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="mode must be one of"):
        parse_gateway_logs(lines_from(spark, []), mode="skip")


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Kathmandu"])
def test_results_do_not_depend_on_session_settings(spark, zone, ansi):
    # 02:30 on 2018-03-11 doesn't exist in Los Angeles.
    lines = [line("17:26:04"), "2018-03-11T02:30:00.250+0000,a,b,m", "not a log line"]
    before = {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled")}
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        frame = lines_from(spark, lines)
        logs = parse_gateway_logs(frame, mode="quarantine")
        assert [row[0] for row in records(logs)] == [1520900764000, 1520735400250]
        assert values(malformed_rows(frame)) == ["not a log line"]
        counts = count_by_window(logs, ONE_MINUTE, ["microservice"])
        ends = counts.select(F.unix_millis("window_end").alias("end")).collect()
        assert sorted(row.end for row in ends) == [1520735460000, 1520900820000]
        with pytest.raises(PySparkException, match="Malformed gateway log line: not a log line"):
            parse_gateway_logs(frame).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_records_given_in_the_program(spark):
    rows = [(instant("17:26:04"), CUSTOMERS, "GA.GET", SERVICE)]
    logs = logs_from(spark, rows)
    assert records(logs) == [(1520900764000, CUSTOMERS, "GA.GET", SERVICE)]
    assert records(with_event_time(logs)) == records(logs)
    with pytest.raises(PySparkException):
        logs_from(spark, [(instant("17:26:04"), CUSTOMERS, "GA.GET", None)])


def test_window_counts(spark):
    rows = [
        (instant("17:26:00"), LOGS, "GA.POST", "a"),
        (instant("17:26:59.999"), LOGS, "GA.GET", "a"),
        (instant("17:27:00"), LOGS, "GA.GET", "a"),
        (instant("17:26:30"), LOGS, "GA.GET", "b"),
    ]
    counts = count_by_window(logs_from(spark, rows), ONE_MINUTE, ["microservice"])
    assert counts.columns == ["microservice", "window_start", "window_end", "n"]
    got = counts.select(
        "microservice", F.unix_millis("window_start"), F.unix_millis("window_end"), "n"
    ).collect()
    assert sorted(tuple(row) for row in got) == [
        ("a", 1520900760000, 1520900820000, 2),
        ("a", 1520900820000, 1520900880000, 1),
        ("b", 1520900760000, 1520900820000, 1),
    ]


def test_windows_before_the_epoch(spark):
    rows = [(dt.datetime(1969, 12, 31, 23, 59, 59, 999000, dt.timezone.utc), "u", "t", "m")]
    counts = count_by_window(logs_from(spark, rows), ONE_MINUTE, ["microservice"])
    assert counts.select(F.unix_millis("window_end").alias("end")).first().end == 0


def test_any_aggregate_over_a_window(spark):
    logs = parse_gateway_logs(lines_from(spark, TWO_WINDOWS))
    got = aggregate_by_window(
        logs, "5 minutes", ["microservice"], F.max("timestamp").alias("last"), F.count("*").alias("n")
    )
    assert got.columns == ["microservice", "last", "n", "window_start", "window_end"]
    row = got.select(F.unix_millis("last").alias("last"), "n").collect()
    assert [tuple(r) for r in row] == [(1520900982000, 2)]


def test_text_files(spark, folder):
    lines_from(spark, FILTER_INPUT + [""]).coalesce(1).write.text(f"{folder}/day=1")
    lines_from(spark, TWO_WINDOWS).coalesce(1).write.option("compression", "gzip").text(
        f"{folder}/day=2"
    )
    lines = read_lines(spark, folder)
    assert lines.columns == ["value"]
    assert sorted(values(lines)) == sorted(FILTER_INPUT + [""] + TWO_WINDOWS)
