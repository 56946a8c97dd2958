"""The bounded job: a directory of log files in, four report directories out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatetally.operators import parse_gateway_logs
from gatetally.plans.records import malformed_records, readable_records, table_records
from gatetally.plans.reports import REPORTS, Report, all_report_lines
from gatetally.sinks import write_text
from gatetally.sources import read_lines
from gatetally.workspace import delete_folder, path_exists, shared_folder


def refuse_existing(spark: SparkSession, paths: Iterable[str]) -> None:
    """Raise if one of the directories that are to be written is there already."""
    for path in paths:
        if path_exists(spark, path):
            raise FileExistsError(f"{path} exists already; nothing was read or written")


def write_reports(
    logs: DataFrame, output: str, reports: Sequence[Report] = REPORTS, mode: str = "error"
) -> None:
    """Write each report's lines as text to ``<output>/<report name>``.

    In mode ``error`` all of these are checked before anything is read. All reports are computed in
    one pass and kept as a table in the shared folder, so losing an executor while one of them is
    written doesn't bring the pass over the logs back. The table is deleted when all are written;
    after a failure it stays behind, and so do the reports written until then.
    """
    spark = logs.sparkSession
    if mode == "error":
        refuse_existing(spark, (f"{output}/{report.name}" for report in reports))
    table = shared_folder(spark, "reports")
    all_report_lines(logs, reports).write.partitionBy("report").parquet(table)
    lines = spark.read.schema("value string, report string").parquet(table)
    for report in reports:
        of_report = lines.filter(F.col("report") == report.name).select("value")
        write_text(of_report, f"{output}/{report.name}", mode)
    delete_folder(spark, table)


def run_batch(
    spark: SparkSession,
    source: str,
    output: str,
    quarantine: str | None = None,
    mode: str = "error",
    **options: str | int | bool,
) -> None:
    """Report on all lines under ``source``; every window is written, also the last ones.

    Malformed lines fail the job, unless ``quarantine`` names a directory to write them to. The
    text is read once either way: with ``quarantine`` the parsed records go to a table in the
    shared folder first, which is deleted when the reports are written. ``options`` go to the file
    source. In mode ``error`` no output directory may exist; all are checked before anything is read.
    """
    if mode == "error":
        outputs = [f"{output}/{report.name}" for report in REPORTS]
        refuse_existing(spark, outputs if quarantine is None else [*outputs, quarantine])
    lines = read_lines(spark, source, **options)
    if quarantine is None:
        logs = parse_gateway_logs(lines)
    else:
        records = table_records(lines, REPORTS, quarantine=True)
        path = shared_folder(spark, "records")
        records.write.parquet(path)
        table = spark.read.schema(records.schema).parquet(path)
        write_text(malformed_records(table), quarantine, mode)
        logs = readable_records(table)
    write_reports(logs, output, mode=mode)
    if quarantine is not None:
        delete_folder(spark, path)
