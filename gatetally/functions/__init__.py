"""Column expressions shared by the operators. All of them are Spark built-ins."""

from gatetally.functions.lines import field, is_header, line_fields, log_time
from gatetally.functions.report_text import epoch_millis, report_line

__all__ = ["epoch_millis", "field", "is_header", "line_fields", "log_time", "report_line"]
