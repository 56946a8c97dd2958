"""Finite automata over numpy arrays: transition functions composed by a parallel prefix scan.

Also greedy pair merging, which the tokenizers share.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Symbols per chunk of the scan, and symbols that are worked on at once.
CHUNK = 128
BLOCK = 1 << 21


def scan_states(symbols: np.ndarray, transitions: np.ndarray, start: int = 0) -> np.ndarray:
    """The state before each symbol. ``transitions[symbol, state]`` is the next state.

    Each chunk's map from states to states is found for all chunks at once; the maps, whose
    composition is associative, are composed by doubling; then all chunks run again at once, each
    from the state it really starts in.
    """
    states = np.empty(len(symbols), np.uint8)
    for at in range(0, len(symbols), BLOCK):
        part = symbols[at : at + BLOCK]
        states[at : at + BLOCK] = _scan_block(part, transitions, start)
        start = int(transitions[part[-1], states[at + len(part) - 1]])
    return states


def _scan_block(symbols: np.ndarray, transitions: np.ndarray, start: int) -> np.ndarray:
    n_states = transitions.shape[1]
    flat = transitions.astype(np.uint8).ravel()
    chunks = -(-len(symbols) // CHUNK)
    padded = np.zeros(chunks * CHUNK, np.uint16)
    padded[: len(symbols)] = symbols
    # Row j has the j-th symbol of every chunk, as an offset into the transitions.
    rows = np.ascontiguousarray((padded * n_states).reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(n_states, dtype=np.uint8)[:, None], (1, chunks))
    for row in rows:
        maps = flat[row + maps]
    step = 1
    while step < chunks:  # maps[:, i] becomes the map of chunks 0..i
        later = maps[maps[:, :-step], np.arange(step, chunks)]
        maps = np.concatenate((maps[:, :step], later), axis=1)
        step *= 2
    now = np.empty(chunks, np.uint8)
    now[0] = start
    now[1:] = maps[start, :-1]
    out = np.empty((CHUNK, chunks), np.uint8)
    for j, row in enumerate(rows):
        out[j] = now
        now = flat[row + now]
    return out.T.reshape(-1)[: len(symbols)]


def texts_of(column: pa.Array, rows: int = 500) -> Iterator:
    """The values of a batch's column, made into Python's own some rows at a time.

    Arrow keeps the memory of earlier batches for later ones; what isn't used goes back first, as the
    tasks of other operators run in the same process.
    """
    pa.default_memory_pool().release_unused()
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def blocks(texts: Iterable[str], size: int = BLOCK) -> Iterator[list[str]]:
    """``texts`` in runs of about ``size`` code points, so that arrays over a run stay small."""
    run, n = [], 0
    for text in texts:
        if run and n + len(text) > size:
            yield run
            run, n = [], 0
        run.append(text)
        n += len(text) + 1
    if run:
        yield run


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, a separator after each; where each text starts and ends."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    joined = "\n".join(texts) + "\n"
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), ends - lengths, ends


def merge_pairs(piece, ranks: dict) -> list:
    """``piece`` (str or bytes) cut into parts: the adjacent pair whose joined rank is least is joined
    first, the leftmost of equals, until none has a rank."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0: none does
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, k = heapq.heappop(heap)
        m = end[i]
        if not m or m >= n or end[m] != k:
            continue
        end[i], end[m] = k, 0
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        p = before[i]
        if p >= 0 and (r := ranks.get(piece[p:k])) is not None:
            heapq.heappush(heap, (r, p, k))
    parts, i = [], 0
    while i < n:
        parts.append(piece[i : end[i]])
        i = end[i]
    return parts


class Cache(dict):
    """Results of ``work`` by word, at most ``most`` of them. Long words aren't kept.

    When half of them are new, the older half is dropped; words that come up again count as new. A task's
    process serves other operators later, so the cache in use makes the one used before give up its words.
    """

    in_use: Cache | None = None

    def __init__(self, work, most: int = 200_000, longest: int = 48):
        super().__init__()
        self.work, self.half, self.longest, self.older = work, most // 2, longest, {}

    def __missing__(self, word):
        if Cache.in_use is not self:
            if Cache.in_use is not None:
                Cache.in_use.drop()
            Cache.in_use = self
        result = self.older.get(word)
        if result is None:
            result = self.work(word)
        if len(word) <= self.longest:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[word] = result
        return result

    def drop(self) -> None:
        self.clear()
        self.older = {}
