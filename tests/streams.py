"""Streams in tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row


def collect_stream(df: DataFrame) -> list[Row]:
    """Run a stream over what is there now and return its rows."""
    table = f"collected_{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode("append").format("memory").queryName(table)
    writer.trigger(availableNow=True).start().awaitTermination()
    try:
        return df.sparkSession.table(table).collect()
    finally:
        df.sparkSession.catalog.dropTempView(table)
