"""The four reports and the batch job that writes them."""

from gatetally.plans.batch import run_batch, write_reports
from gatetally.plans.records import malformed_records, readable_records, table_records
from gatetally.plans.reports import (
    REPORTS,
    Report,
    all_report_lines,
    durations_of,
    format_lines,
    report_counts,
    report_lines,
    report_named,
    stream_lines,
)

__all__ = [
    "REPORTS",
    "Report",
    "all_report_lines",
    "durations_of",
    "format_lines",
    "malformed_records",
    "readable_records",
    "report_counts",
    "report_lines",
    "report_named",
    "run_batch",
    "stream_lines",
    "table_records",
    "write_reports",
]
