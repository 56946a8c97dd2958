"""Line and record sources: a directory of text files, or rows given in the program."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from gatetally.constants import GATEWAY_LOG, LINES


def read_lines(
    spark: SparkSession, path: str, streaming: bool = False, **options: str | int | bool
) -> DataFrame:
    """One row per text line under ``path``, as a stream or as a bounded read.

    A streaming path is a directory that receives complete files. Each file is read once, so
    lines appended to a file that was already read are not seen. ``options`` go to Spark's file
    source, such as ``maxFilesPerTrigger``, ``maxBytesPerTrigger`` or ``maxFileAge``.
    """
    reader = spark.readStream if streaming else spark.read
    return reader.schema(LINES).options(**options).text(path).select("value")


def lines_from(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """A bounded frame of lines given in the program."""
    return spark.createDataFrame([(line,) for line in lines], LINES)


def logs_from(
    spark: SparkSession, rows: Iterable[tuple[dt.datetime, str, str, str]]
) -> DataFrame:
    """A bounded frame of records: (timestamp, apiUrl, type, microservice), none of them null."""
    return spark.createDataFrame(list(rows), GATEWAY_LOG)
