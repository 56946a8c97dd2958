"""Streaming sinks. All run in append mode: a row is written once and never changed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from gatetally.constants import RESCAN_INTERVAL

# Look for new files all the time, or read what is there and stop.
CONTINUOUS: Mapping[str, str | bool] = {"processingTime": RESCAN_INTERVAL}
AVAILABLE_NOW: Mapping[str, str | bool] = {"availableNow": True}

Trigger = Mapping[str, str | bool]


def _writer(
    df: DataFrame, checkpoint: str, trigger: Trigger, name: str | None
) -> DataStreamWriter:
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(**trigger)
    return writer.queryName(name) if name else writer


def start_text(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    trigger: Trigger = CONTINUOUS,
    name: str | None = None,
    by: Sequence[str] = (),
    retention: str | None = None,
) -> StreamingQuery:
    """Append lines as text files to the directory ``path``, each exactly once.

    Columns named in ``by`` go into the names of directories below it, ``<column>=<value>``. The sink
    keeps an account of its files in ``path``. With ``retention``, files of batches that are older leave
    it, so that it stops growing: they stay where they are, but a read of ``path`` as a whole no longer
    finds them.
    """
    writer = _writer(lines, checkpoint, trigger, name).format("text")
    if retention is not None:
        writer = writer.option("retention", retention)
    return (writer.partitionBy(*by) if by else writer).start(path)


def start_batches(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: Trigger = CONTINUOUS,
    name: str | None = None,
) -> StreamingQuery:
    """Hand each micro-batch and its number to the user's own ``write``.

    A batch can come again after a failure, with the same number and the same rows.
    """
    return _writer(df, checkpoint, trigger, name).foreachBatch(write).start()
