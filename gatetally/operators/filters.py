"""Filters over raw lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatetally.constants import HEADER_MARKER
from gatetally.functions import is_header


def drop_headers(lines: DataFrame, marker: str = HEADER_MARKER) -> DataFrame:
    """Drop every line that holds the marker, also where it is part of the data.

    A null line holds no marker and is kept, so that parsing can report it.
    """
    value = F.col("value")
    return lines.filter(value.isNull() | ~is_header(value, marker))
