"""DataFrame to DataFrame steps that serve batch and streaming frames alike."""

from gatetally.operators.filters import drop_headers
from gatetally.operators.parsing import malformed_rows, parse_gateway_logs, read_records
from gatetally.operators.window_functions import WindowFunction, apply_to_windows
from gatetally.operators.windows import aggregate_by_window, count_by_window, with_event_time

__all__ = [
    "WindowFunction",
    "aggregate_by_window",
    "apply_to_windows",
    "count_by_window",
    "drop_headers",
    "malformed_rows",
    "parse_gateway_logs",
    "read_records",
    "with_event_time",
]
