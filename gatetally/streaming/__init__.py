"""The streaming job."""

from gatetally.streaming.job import await_all, run_stream, start_reports, stop_all
from gatetally.streaming.late import LateRows, count_late_rows

__all__ = [
    "LateRows",
    "await_all",
    "count_late_rows",
    "run_stream",
    "start_reports",
    "stop_all",
]
