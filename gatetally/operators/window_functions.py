"""The user's own function over all rows of a window, in batch and on a stream.

The rows of a window are never gathered. Each part of the input makes a state of them, states are merged, and
what the window gives is made of the last one. Parts are made before the shuffle, so a key that holds much of
the data sends a state per window and part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructType

from gatetally.constants import WATERMARK_DELAY
from gatetally.operators.windows import with_event_time

State = tuple[Any, ...]
_END_MS, _END = "window_end_ms", "window_end"


@dataclass(frozen=True)
class WindowFunction:
    """What to do with the rows of a window, some at a time.

    ``state`` and ``result`` are schemas in Spark's DDL. ``start`` gives the state of no rows, ``add`` takes
    rows (a pandas frame) into a state, ``merge`` makes one state of two, in any order, and ``finish`` gives
    the window's rows, as many as it likes, as tuples of the result. They run on the executors, so the module
    that defines them has to be there.
    """

    state: str
    result: str
    start: Callable[[], State]
    add: Callable[[State, pd.DataFrame], State]
    merge: Callable[[State, State], State]
    finish: Callable[[State], Iterable[tuple]]


def _plain(value: Any) -> Any:
    """Arrays of a state as lists, which is what Spark's state store takes."""
    return value.tolist() if hasattr(value, "tolist") else value


def _states(part: pd.DataFrame, names: Sequence[str]) -> Iterator[State]:
    return zip(*(map(_plain, part[name]) for name in names), strict=True)


def _parts(keys: Sequence[str], function: WindowFunction, names: Sequence[str]) -> Callable:
    """A row with a state per key and window of each batch of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [
                (*(None if pd.isna(k) else k for k in key), *map(_plain, function.add(function.start(), rows)))
                for key, rows in frame.groupby([*keys, _END_MS], dropna=False, sort=False)
            ]
            yield pd.DataFrame(made, columns=[*keys, _END_MS, *names])

    return run


def _merged(function: WindowFunction, state: State | None, states: Iterable[State]) -> State:
    for other in states:
        state = other if state is None else function.merge(state, other)
    return state


class _Windows(StatefulProcessor):
    """A window's state until the watermark has passed its end; then its rows."""

    def __init__(self, keys: Sequence[str], function: WindowFunction, names: Sequence[str], results: Sequence[str]):
        self.keys, self.function, self.names, self.results = keys, function, names, results

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.function.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(map(_plain, self.state.get())) if self.state.exists() else None
        for frame in rows:
            if state is None and len(frame):
                self.handle.registerTimer(int(frame[_END_MS].iloc[0]))
            state = _merged(self.function, state, _states(frame, self.names))
        if state is not None:
            self.state.update(tuple(map(_plain, state)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs()
        rows = [(*key[:-1], end, *row) for row in self.function.finish(tuple(map(_plain, self.state.get())))]
        self.state.clear()
        yield pd.DataFrame(rows, columns=[*self.keys, _END_MS, *self.results])

    def close(self) -> None:
        pass


def apply_to_windows(
    df: DataFrame,
    duration: str,
    keys: Sequence[str],
    function: WindowFunction,
    columns: Sequence[str],
    column: str = "timestamp",
    delay: str = WATERMARK_DELAY,
) -> DataFrame:
    """(keys..., window_end, the function's result) for each key and tumbling window.

    The function gets the ``columns`` and ``window_end_ms``, the window's end in milliseconds since the
    epoch. Keys have to be text; a null is a key like others. On a static frame every window is given. On a
    stream in append mode a window is given once, when the watermark has reached its end, and rows that come
    later are dropped; the state is a row per open window and key, and needs the RocksDB state store.
    """
    for key in keys:
        if df.schema[key].dataType != StringType():
            raise ValueError(f"keys have to be text, and {key} is {df.schema[key].dataType.simpleString()}")
    names = StructType.fromDDL(function.state).names
    results = StructType.fromDDL(function.result).names
    timed = with_event_time(df, column, delay)
    end_ms = F.unix_millis(F.window(column, duration)["end"]).alias(_END_MS)
    key_types = "".join(f"`{key}` string, " for key in keys)
    parts = timed.select(*keys, end_ms, *columns).mapInPandas(
        _parts(keys, function, names), f"{key_types}{_END_MS} long, {function.state}"
    )
    shape = f"{key_types}{_END_MS} long, {function.result}"
    if df.isStreaming:
        # Python gives new columns; the window's end takes over the mark of the event time.
        mark = timed.schema[column].metadata
        end = F.timestamp_millis(_END_MS).alias(_END, metadata=mark)
        rows = parts.select("*", end).groupBy(*keys, _END).transformWithStateInPandas(
            _Windows(keys, function, names, results), shape, "Append", "EventTime"
        )
    else:

        def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            state = _merged(function, None, _states(frame, names))
            made = [(*(None if pd.isna(k) else k for k in key), *row) for row in function.finish(state)]
            return pd.DataFrame(made, columns=[*keys, _END_MS, *results])

        rows = parts.groupBy(*keys, _END_MS).applyInPandas(whole, shape)
    return rows.select(*keys, F.timestamp_millis(_END_MS).alias(_END), *results)
