"""How many rows streams have dropped as late."""

from __future__ import annotations

import time
from collections import Counter
from threading import Lock

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import (
    QueryProgressEvent,
    QueryStartedEvent,
    QueryTerminatedEvent,
)


class LateRows(StreamingQueryListener):
    """The rows that each query has dropped as late since the listener was added, over all its runs.

    Spark counts them behind the first aggregation step, so several late log rows of one window and
    key in one partition count as one.
    """

    def __init__(self) -> None:
        self._rows: Counter[str] = Counter()
        self._ended: set[str] = set()
        self._lock = Lock()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        dropped = sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        with self._lock:
            self._rows[str(event.progress.id)] += dropped

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        with self._lock:
            self._ended.add(str(event.runId))

    def total(self, query: StreamingQuery, wait: float = 30) -> int:
        """Late rows of a query. Of one that has ended, all: its last events are waited for."""
        until = time.monotonic() + wait
        while not query.isActive and time.monotonic() < until:
            with self._lock:
                if str(query.runId) in self._ended:
                    break
            time.sleep(0.05)
        with self._lock:
            return self._rows[str(query.id)]


def count_late_rows(spark: SparkSession) -> LateRows:
    """A listener added to the session; ``spark.streams.removeListener`` takes it away again."""
    listener = LateRows()
    spark.streams.addListener(listener)
    return listener
