"""Words of many texts as numpy arrays: where they start and end, and hashes of words and word runs.

Texts are worked on as UTF-8 bytes. A run's hash is a polynomial over its parts, taken out of prefix
sums, so the hashes of all runs of one length cost one pass whatever the length. Equal runs have equal
hashes; unequal ones may meet, so these hashes sort candidates out and decide nothing alone.
"""

from __future__ import annotations

import numpy as np

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes that are hashed at once.
CHUNK = 1 << 20

#: What stands between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"


def byte_table(members: bytes) -> np.ndarray:
    """For each byte whether it is one of ``members``."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_IS_BLANK = byte_table(BLANKS)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of ``base`` and of its inverse, modulo 2^64."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        known = []
        for factor in (base, pow(base, -1, 1 << 64)):
            powers = np.full(size, factor, np.uint64)
            powers[0] = 1
            known.append(np.multiply.accumulate(powers))
        known = tuple(known)
        if n <= 4 * CHUNK:
            _POWERS[base] = known
    return known


def mixed(hashes: np.ndarray) -> np.ndarray:
    """The same numbers with every bit spread over all others."""
    hashes = hashes ^ (hashes >> np.uint64(33))
    hashes *= np.uint64(0xFF51AFD7ED558CCD)
    hashes ^= hashes >> np.uint64(33)
    hashes *= np.uint64(0xC4CEB9FE1A85EC53)
    hashes ^= hashes >> np.uint64(33)
    return hashes


def _runs(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def word_spans(data: np.ndarray, is_blank: np.ndarray = _IS_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` (bytes, a blank at the end) start and end."""
    inside = ~is_blank[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        turns = np.concatenate(([0], turns))
    return turns[::2], turns[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of each word, some of the bytes at a time. Another salt gives other powers."""
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        at = int(starts[i])
        values = data[at : int(ends[j - 1])].astype(np.uint64) + np.uint64(1)
        hashes[i:j] = _runs(values, _BYTE_BASE + 2 * salt, starts[i:j] - at, ends[i:j] - at)
        i = j
    return hashes


def run_hashes(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words that starts at one of ``starts``."""
    return _runs(words, _WORD_BASE + 2 * length, starts, starts + length)


def joined_bytes(texts: list[bytes], between: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each followed by ``between``; where each text ends."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + len(between)) - len(between)
    return np.frombuffer(between.join(texts) + between, np.uint8), ends


def has_bit(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bit at each of ``places`` is set."""
    places = places.astype(np.int64)
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def packed(places: np.ndarray, size: int) -> bytes:
    """``size`` bits, those at ``places`` set."""
    bits = np.zeros(size, bool)
    bits[places.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()
