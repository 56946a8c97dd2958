"""Expressions over one raw log line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatetally.constants import (
    FIELD_COUNT,
    FIELD_SEPARATOR,
    HEADER_MARKER,
    TIME_LENGTH,
    TIME_PATTERN,
)


def is_header(value: Column, marker: str = HEADER_MARKER) -> Column:
    """True where the marker occurs anywhere in the line, case-sensitively."""
    return value.contains(marker)


def line_fields(value: Column) -> Column:
    """Split a line at its separators; there is no quoting.

    Trailing separators make no fields. Past the fields that are read the line stays in one piece,
    so a line with very many separators costs no more than any other.
    """
    trimmed = F.rtrim(value, F.lit(FIELD_SEPARATOR))
    return F.split(trimmed, FIELD_SEPARATOR, FIELD_COUNT + 1)


def field(fields: Column, position: int) -> Column:
    """The field at a 0-based position, null where the line is shorter."""
    return F.try_element_at(fields, F.lit(position + 1))


def log_time(text: Column) -> Column:
    """Instant written in the log's time format, null where the text isn't in that format.

    The format has one length and a year of four digits. Spark's own reading also takes shorter
    fractions of a second, as tenths or hundredths, and longer years.
    """
    strict = (F.length(text) == TIME_LENGTH) & (F.substring(text, 5, 1) == "-")
    return F.when(strict, F.try_to_timestamp(text, F.lit(TIME_PATTERN)))
