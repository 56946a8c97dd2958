"""The four reports over parsed logs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatetally.constants import (
    COUNT_PER_5_MINUTES,
    COUNT_PER_5_MINUTES_BY_METHOD,
    COUNT_PER_MINUTE,
    COUNT_PER_MINUTE_BY_METHOD,
    FIVE_MINUTES,
    ONE_MINUTE,
    WATERMARK_DELAY,
)
from gatetally.functions import report_line
from gatetally.operators import count_by_window, with_event_time


@dataclass(frozen=True)
class Report:
    """A count of calls per key and tumbling window."""

    name: str
    keys: tuple[str, ...]
    duration: str


BY_SERVICE = ("microservice",)
BY_SERVICE_AND_METHOD = ("microservice", "type")

REPORTS = (
    Report(COUNT_PER_MINUTE, BY_SERVICE, ONE_MINUTE),
    Report(COUNT_PER_5_MINUTES, BY_SERVICE, FIVE_MINUTES),
    Report(COUNT_PER_MINUTE_BY_METHOD, BY_SERVICE_AND_METHOD, ONE_MINUTE),
    Report(COUNT_PER_5_MINUTES_BY_METHOD, BY_SERVICE_AND_METHOD, FIVE_MINUTES),
)


def report_named(name: str, reports: Sequence[Report] = REPORTS) -> Report:
    """The report of that name."""
    for report in reports:
        if report.name == name:
            return report
    raise ValueError(f"no report named {name!r}")


def report_counts(logs: DataFrame, report: Report, delay: str = WATERMARK_DELAY) -> DataFrame:
    """Counts of one report: (keys..., window_start, window_end, n).

    On a static frame every window is returned. On a stream in append mode a window is returned
    once, when the watermark has passed its end.
    """
    return count_by_window(with_event_time(logs, delay=delay), report.duration, report.keys)


def format_lines(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts as report lines, in one column ``value``."""
    return counts.select(report_line(keys, F.col("window_end"), F.col("n")).alias("value"))


def report_lines(logs: DataFrame, report: Report, delay: str = WATERMARK_DELAY) -> DataFrame:
    """Lines of one report, in one column ``value``."""
    return format_lines(report_counts(logs, report, delay), report.keys)


def durations_of(reports: Sequence[Report] = REPORTS) -> list[str]:
    """The window lengths of the reports, each once."""
    return list(dict.fromkeys(report.duration for report in reports))


def _report_key(report: Report, keys: Sequence[str], types: dict[str, str]) -> Column:
    """The report's name and its keys, and null for the keys of other reports, as one struct."""
    own = (F.col(key) if key in report.keys else F.lit(None).cast(types[key]) for key in keys)
    named = (column.alias(key) for column, key in zip(own, keys, strict=True))
    return F.struct(F.lit(report.name).alias("report"), *named)


def _line_of(reports: Sequence[Report]) -> Column:
    """The line of whichever report a row of counts belongs to."""
    return F.coalesce(
        *(
            F.when(
                F.col("report") == report.name,
                report_line(report.keys, F.col("window_end"), F.col("n")),
            )
            for report in reports
        )
    )


def _window_ends(logs: DataFrame, durations: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """``logs`` with the end of each record's window of every length, and the columns' names by length."""
    ends = {duration: f"window_end_{i}" for i, duration in enumerate(durations)}
    for duration, end in ends.items():
        logs = logs.withColumn(end, F.window("timestamp", duration)["end"])
    return logs, ends


def _report_rows(reports: Sequence[Report], keys: Sequence[str], types: dict[str, str], ends: dict[str, str]) -> Column:
    """A row per report: its key and the end of its window."""
    rows = (
        F.struct(
            _report_key(report, keys, types).alias("key"),
            F.col(ends[report.duration]).alias("window_end"),
        )
        for report in reports
    )
    return F.explode(F.array(*rows)).alias("row")


def stream_lines(
    logs: DataFrame, reports: Sequence[Report] = REPORTS, delay: str = WATERMARK_DELAY
) -> DataFrame:
    """Lines of several reports, whatever their windows, out of one aggregation: (report, value).

    Each record becomes a row per report, with the end of the report's window, and these are counted by
    report, window end and keys together: before the shuffle, so that what fans out are the rows of one
    partition and not what is sent. A stream thus reads and parses its text once, has one watermark and
    one state, and commits all reports together.

    The window ends come out of a generator, where Spark loses track of the event time. They take over the
    mark that ``withWatermark`` sets on it, so a window is written, and a record late, by the window's end.
    """
    keys = list(dict.fromkeys(key for report in reports for key in report.keys))
    types = dict(logs.select(*keys).dtypes)
    timed, ends = _window_ends(with_event_time(logs, delay=delay), durations_of(reports))
    mark = timed.schema["timestamp"].metadata
    fanned = timed.select(_report_rows(reports, keys, types, ends)).select(
        "row.key.*", F.col("row.window_end").alias("window_end", metadata=mark)
    )
    counts = fanned.groupBy("report", "window_end", *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("report", _line_of(reports).alias("value"))


def all_report_lines(logs: DataFrame, reports: Sequence[Report] = REPORTS) -> DataFrame:
    """Lines of several reports from one pass over a static frame: (report, value).

    The rows are counted once by every window and every key of the reports together. Each of these
    counts then goes to the report rows it belongs to, and those are summed. The logs are read,
    parsed and shuffled once however many reports there are; what is fanned out are counts.
    """
    if logs.isStreaming:
        raise ValueError("a stream counts once for all reports; use stream_lines")
    keys = list(dict.fromkeys(key for report in reports for key in report.keys))
    types = dict(logs.select(*keys).dtypes)
    logs, ends = _window_ends(logs, durations_of(reports))
    counts = logs.groupBy(*ends.values(), *keys).agg(F.count(F.lit(1)).alias("n"))

    return (
        counts.select(_report_rows(reports, keys, types, ends), "n")
        .groupBy("row.key.report", "row.window_end", *(f"row.key.{key}" for key in keys))
        .agg(F.sum("n").alias("n"))
        .select("report", _line_of(reports).alias("value"))
    )
