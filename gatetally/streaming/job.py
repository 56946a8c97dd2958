"""The unbounded job: a directory that receives log files in, the four reports out."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gatetally.operators import malformed_rows, parse_gateway_logs
from gatetally.plans.reports import REPORTS, Report, durations_of, stream_lines
from gatetally.sinks import start_text
from gatetally.sinks.streams import CONTINUOUS, Trigger
from gatetally.sources import read_lines
from gatetally.workspace import path_exists

#: Names of the queries, and of their checkpoints.
REPORT_LINES, MALFORMED = "reports", "malformed"


def start_reports(
    logs: DataFrame,
    output: str,
    checkpoints: str,
    reports: Sequence[Report] = REPORTS,
    trigger: Trigger = CONTINUOUS,
    files: int | None = None,
    retention: str | None = None,
) -> StreamingQuery:
    """Start the one query that writes all reports of a stream of records.

    Its lines go to ``<output>/report=<report name>``: a query has one sink, and the sink keeps the
    account of what is written in one directory; ``retention`` bounds that account. With
    ``spark.scheduler.mode=FAIR`` the query gets a pool of its own.

    A micro-batch writes a file per report and state partition that has finished windows, or, where
    ``files`` is given, from that many tasks at most; only the finished counts are shuffled for it.
    """
    context = logs.sparkSession.sparkContext
    lines = stream_lines(logs, reports)
    if files is not None:
        lines = lines.repartition(files, F.xxhash64("value"))
    context.setLocalProperty("spark.scheduler.pool", REPORT_LINES)
    try:
        return start_text(
            lines, output, f"{checkpoints}/{REPORT_LINES}", trigger, REPORT_LINES, ["report"], retention
        )
    finally:
        context.setLocalProperty("spark.scheduler.pool", None)


def stop_all(queries: Iterable[StreamingQuery]) -> None:
    """Stop queries; their checkpoints let them go on later."""
    for query in queries:
        query.stop()


def await_all(queries: Iterable[StreamingQuery]) -> None:
    """Wait until all queries have ended; when one fails, stop the others and raise its error."""
    running = list(queries)
    try:
        while running:
            for query in list(running):
                if query.awaitTermination(1):
                    running.remove(query)
    finally:
        stop_all(running)


def refuse_other_layout(spark: SparkSession, checkpoints: str, reports: Sequence[Report]) -> None:
    """Raise if the checkpoints are those of a job that had a query per report or window length.

    Its queries knew which lines they had read; from checkpoints without that, all would be read and
    counted again.
    """
    lengths = (duration.replace(" ", "-") for duration in durations_of(reports))
    for name in ("records", "parse", *lengths, *(report.name for report in reports)):
        if path_exists(spark, f"{checkpoints}/{name}"):
            raise ValueError(
                f"{checkpoints}/{name} is of a job with other queries; start with new checkpoints and"
                " output, or run what is left with the version that wrote it"
            )


def run_stream(
    spark: SparkSession,
    source: str,
    output: str,
    checkpoints: str,
    reports: Sequence[Report] = REPORTS,
    quarantine: str | None = None,
    trigger: Trigger = CONTINUOUS,
    files: int | None = None,
    archive: str | None = None,
    retention: str | None = None,
    **options: str | int | bool,
) -> None:
    """Report on the files that arrive under ``source``, until stopped or, with
    ``AVAILABLE_NOW``, until all that is there has been read.

    Malformed lines fail the job, unless ``quarantine`` names a directory to write them to; a query of
    its own does that. ``files`` limits the tasks that write per micro-batch. ``options`` go to the file
    source of every query, so a limit of files per micro-batch holds for all of them.

    For a job that runs for long: ``archive`` names a directory that files are moved to when their
    micro-batch is done, so that ``source`` doesn't grow and its listing stays short. That takes a single
    reader, so not together with ``quarantine``. ``retention`` ("7d") bounds the sinks' accounts.
    """
    if archive is not None and quarantine is not None:
        raise ValueError("with a quarantine two queries read the files, so none of them may move files away")
    refuse_other_layout(spark, checkpoints, reports)
    if quarantine is None and path_exists(spark, f"{checkpoints}/{MALFORMED}"):
        warnings.warn(
            f"malformed lines were set apart before ({checkpoints}/{MALFORMED}); of files that only the reports"
            " have read they are written when the quarantine is back",
            stacklevel=2,
        )
    if archive is not None:
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive}
    lines = read_lines(spark, source, streaming=True, **options)
    queries = []
    try:
        if quarantine is not None:
            malformed, checkpoint = malformed_rows(lines), f"{checkpoints}/{MALFORMED}"
            queries.append(
                start_text(malformed, quarantine, checkpoint, trigger, MALFORMED, retention=retention)
            )
        logs = parse_gateway_logs(lines, "failfast" if quarantine is None else "quarantine")
        queries.append(start_reports(logs, output, checkpoints, reports, trigger, files, retention))
    except BaseException:
        stop_all(queries)
        raise
    await_all(queries)
