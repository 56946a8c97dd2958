"""Lines to records, with a check that no malformed line is lost silently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatetally.constants import (
    FIELD_COUNT,
    HEADER_MARKER,
    SERVICE_FIELD,
    TIME_FIELD,
    TYPE_FIELD,
    URL_FIELD,
)
from gatetally.functions import field, is_header, line_fields, log_time
from gatetally.operators.filters import drop_headers

MODES = ("failfast", "quarantine")
_TIME_PARSER = "spark.sql.legacy.timeParserPolicy"


def read_records(lines: DataFrame, marker: str = HEADER_MARKER) -> DataFrame:
    """(value, timestamp, apiUrl, type, microservice) of every line that is not a header.

    ``timestamp`` is null exactly where the line is malformed: where it has fewer than four fields
    or its time cannot be read. Spark's legacy time parser reads dates that don't exist, so a session
    that is set to it is refused.
    """
    if lines.sparkSession.conf.get(_TIME_PARSER).upper() == "LEGACY":
        raise ValueError(f"{_TIME_PARSER}=LEGACY reads malformed times; unset it")
    fields = F.col("fields")
    complete = F.size(fields) >= FIELD_COUNT
    return (
        drop_headers(lines, marker)
        .select("value", line_fields(F.col("value")).alias("fields"))
        .select(
            "value",
            F.when(complete, log_time(field(fields, TIME_FIELD))).alias("timestamp"),
            field(fields, URL_FIELD).alias("apiUrl"),
            field(fields, TYPE_FIELD).alias("type"),
            field(fields, SERVICE_FIELD).alias("microservice"),
        )
    )


def parse_gateway_logs(
    lines: DataFrame, mode: str = "failfast", marker: str = HEADER_MARKER
) -> DataFrame:
    """Parse lines into (timestamp, apiUrl, type, microservice); header lines are dropped.

    In mode ``failfast`` a malformed line fails the query, whichever columns it uses; in mode
    ``quarantine`` it is left out here and ``malformed_rows`` returns it.

    In both modes the event time comes out of a generator. Spark neither drops one whose output isn't
    used, nor pushes filters on its output below it: it copies an expression into every filter that it
    pushes below a projection, and windowing adds a not-null filter on the event time, so a plain
    nullable column would be parsed two or three times per line.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    records = read_records(lines, marker)
    timestamp, value = F.col("timestamp"), F.col("value")
    readable = F.when(timestamp.isNotNull(), F.array(timestamp))
    if mode == "failfast":
        # The order of filter conditions isn't guaranteed, so a header line may get here before it
        # is dropped; it must not raise.
        message = F.concat(F.lit("Malformed gateway log line: "), F.coalesce(value, F.lit("null")))
        malformed = ~F.coalesce(is_header(value, marker), F.lit(False))
        raised = F.when(malformed, F.array(F.raise_error(message).cast("timestamp")))
        readable = F.coalesce(readable, raised)
    return records.select(F.explode(readable).alias("timestamp"), "apiUrl", "type", "microservice")


def malformed_rows(lines: DataFrame, marker: str = HEADER_MARKER) -> DataFrame:
    """The lines that are neither headers nor readable records, as ``value``."""
    return read_records(lines, marker).select(
        F.explode(F.when(F.col("timestamp").isNull(), F.array("value"))).alias("value")
    )
