"""Expressions that turn a window count into a report line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatetally.constants import LINE_COUNT, LINE_KEY, LINE_KEY_SEPARATOR, LINE_WINDOW


def epoch_millis(instant: Column) -> Column:
    """Milliseconds since the epoch; the session time zone plays no part."""
    return F.unix_millis(instant)


def report_line(keys: Sequence[str], window_end: Column, count: Column) -> Column:
    """The text of one report row: its key, its window's end and its count."""
    return F.concat(
        F.lit(LINE_KEY),
        F.concat_ws(LINE_KEY_SEPARATOR, *keys),
        F.lit(LINE_WINDOW),
        epoch_millis(window_end).cast("string"),
        F.lit(LINE_COUNT),
        count.cast("string"),
    )
