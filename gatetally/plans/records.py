"""Records as a table, for jobs that use them more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatetally.operators import parse_gateway_logs, read_records
from gatetally.plans.reports import Report


def table_records(lines: DataFrame, reports: Sequence[Report], quarantine: bool) -> DataFrame:
    """The columns the reports use, and with ``quarantine`` also the text of malformed lines.

    (timestamp, keys..., malformed): of the first and the last, one is null in every row. Without
    ``quarantine`` there is no column ``malformed``, and a malformed line fails the query.
    """
    columns = ["timestamp", *dict.fromkeys(key for report in reports for key in report.keys)]
    if not quarantine:
        return parse_gateway_logs(lines).select(columns)
    text = F.when(F.col("timestamp").isNull(), F.col("value")).alias("malformed")
    return read_records(lines).select(*columns, text)


def readable_records(table: DataFrame) -> DataFrame:
    """The records of such a table that can be counted."""
    return table.filter(F.col("timestamp").isNotNull())


def malformed_records(table: DataFrame) -> DataFrame:
    """The malformed lines of such a table, as ``value``."""
    return table.filter(F.col("timestamp").isNull()).select(F.col("malformed").alias("value"))
