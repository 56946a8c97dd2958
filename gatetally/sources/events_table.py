"""The ``events`` table written as gateway log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatetally.constants import FIELD_SEPARATOR, HEADER_LINE

SERVICES = 8


def _utc_text(ts: Column) -> Column:
    """A zone-less timestamp as log time text in UTC, cut to milliseconds.

    Casting to text is used, not ``date_format``, as the latter goes through the session time
    zone and would shift times that fall into that zone's daylight saving gap.
    """
    text = ts.cast("string")
    seconds = F.translate(F.substring(text, 1, 19), " ", "T")
    millis = F.rpad(F.substring(text, 21, 3), 3, "0")
    return F.concat(seconds, F.lit("."), millis, F.lit("+0000"))


def gateway_lines(events: DataFrame) -> DataFrame:
    """One log line per event; works on a static and on a streaming frame."""
    return events.select(
        F.concat_ws(
            FIELD_SEPARATOR,
            _utc_text(F.col("ts")),
            F.concat(F.lit("GA."), F.upper("event_type")),
            F.concat(F.lit("/users/"), F.col("user_id").cast("string")),
            F.concat(F.lit("svc-"), (F.col("user_id") % SERVICES).cast("string")),
        ).alias("value")
    )


def with_header(lines: DataFrame) -> DataFrame:
    """The lines of a static frame and one header line."""
    header = lines.sparkSession.range(1).select(F.lit(HEADER_LINE).alias("value"))
    return header.unionAll(lines)
