"""Where lines and records come from."""

from gatetally.sources.events_table import gateway_lines, with_header
from gatetally.sources.lines import lines_from, logs_from, read_lines

__all__ = ["gateway_lines", "lines_from", "logs_from", "read_lines", "with_header"]
