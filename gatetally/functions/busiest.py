"""A window function that no aggregate column gives: the seconds of a window with the most calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

from gatetally.operators.window_functions import State, WindowFunction


def busiest_seconds(seconds: int) -> WindowFunction:
    """(second, calls) of each second of the window, from 0 on, that has as many calls as any.

    For windows of ``seconds``; rows have ``millis``, their time since the epoch. The state is a count per
    second, however many rows there are.
    """

    def start() -> State:
        return ([0] * seconds,)

    def add(state: State, rows: pd.DataFrame) -> State:
        place = seconds + (rows["millis"] - rows["window_end_ms"]) // 1000
        counts = place.value_counts()
        return ([n + int(counts.get(i, 0)) for i, n in enumerate(state[0])],)

    def merge(one: State, other: State) -> State:
        return ([a + b for a, b in zip(one[0], other[0], strict=True)],)

    def finish(state: State) -> Iterator[tuple]:
        most = max(state[0])
        return ((i, n) for i, n in enumerate(state[0]) if n == most)

    return WindowFunction("counts array<bigint>", "second int, calls bigint", start, add, merge, finish)
