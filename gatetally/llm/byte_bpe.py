"""Byte-level BPE encoding and decoding, with vectorised pre-tokenisation.

Each code point gets a class that already looks at what follows it. A transition function over eight
states, run by an associative scan, finds where the pieces of the split pattern begin, without a regular
expression. The slices feed pair merging, whose results are kept by word. Token offsets come from the
ids alone, and decoding gathers token bytes by them.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatetally.llm.common import free_name, text_or_empty
from gatetally.llm.scan import Cache, blocks, codepoints, merge_pairs, scan_states, texts_of

RANK_FILE = "byte_bpe_50k.tiktoken"

# Fixed values of the split pattern: its contractions, and the white space of regular expressions.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Symbols: letter, number, other; a space before something that isn't white, which joins it; white
#: before white or the end; other white before something else; an apostrophe before an ending of one
#: and of two letters; the end of a text.
_L, _N, _O, _JOIN, _WHITE, _LAST, _SHORT, _LONG, _END = range(9)
#: States: nothing that can be gone on with; in letters, numbers, others; after a joining space; in
#: white; one or two letters of an ending to come.
_FRESH, _IN_L, _IN_N, _IN_O, _JOINED, _IN_WHITE, _ONE_MORE, _TWO_MORE = range(8)


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece begins before the symbol; both by symbol and state."""
    after = np.zeros((9, 8), np.uint8)
    begins = np.ones((9, 8), bool)
    for symbol, state in ((_L, _IN_L), (_N, _IN_N), (_O, _IN_O), (_JOIN, _JOINED), (_WHITE, _IN_WHITE), (_SHORT, _ONE_MORE), (_LONG, _TWO_MORE)):
        after[symbol] = state
    for symbol, state in ((_L, _IN_L), (_N, _IN_N), (_O, _IN_O)):
        begins[symbol, [state, _JOINED]] = False
    begins[_WHITE, _IN_WHITE] = False
    # An ending's letters belong to it, and what follows is new.
    begins[_L, [_ONE_MORE, _TWO_MORE]] = False
    after[_L, _ONE_MORE], after[_L, _TWO_MORE] = _FRESH, _ONE_MORE
    # Inside a run of others, or joined to a space, an apostrophe is like any other.
    for symbol in (_SHORT, _LONG):
        begins[symbol, [_IN_O, _JOINED]] = False
        after[symbol, [_IN_O, _JOINED]] = _IN_O
    return after, begins


_NEXT, _BEGINS = _transducer()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    first = map(lambda c: unicodedata.category(chr(c))[0], range(sys.maxunicode + 1))
    kinds = np.fromiter(({"L": _L, "N": _N}.get(c, _O) for c in first), np.uint8, sys.maxunicode + 1)
    kinds[WHITE] = _WHITE
    return kinds


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    symbols = _classes()[points]
    symbols[ends] = _END
    solid = symbols != _WHITE
    solid[ends] = False
    last_white = np.flatnonzero(~solid[:-1] & solid[1:])
    last_white = last_white[symbols[last_white] == _WHITE]
    symbols[last_white] = np.where(points[last_white] == 32, _JOIN, _LAST)
    quotes = np.flatnonzero(points[:-1] == ord("'"))
    quotes = quotes[symbols[quotes] == _O]
    follow = points[quotes + 1]
    after = points[np.minimum(quotes + 2, len(points) - 1)]
    short = np.isin(follow, [ord(c) for c in SHORT_ENDINGS])
    pair = follow.astype(np.uint64) << np.uint64(32) | after
    long = np.isin(pair, np.array([ord(a) << 32 | ord(b) for a, b in LONG_ENDINGS], np.uint64))
    symbols[quotes[short]] = _SHORT
    symbols[quotes[long]] = _LONG
    return symbols


def pieces(texts: list[str]) -> list[list[str]]:
    """Each text's pieces under the split pattern of the rank files."""
    points, starts, ends = codepoints(texts)
    symbols = _symbols(points, ends)
    cuts = np.flatnonzero(_BEGINS[symbols, scan_states(symbols, _NEXT)])
    first, after = np.searchsorted(cuts, starts), np.searchsorted(cuts, ends)
    cut = []
    for i, text in enumerate(texts):
        at = (cuts[first[i] : after[i] + 1] - starts[i]).tolist()  # the last is the text's end
        cut.append([text[a:b] for a, b in zip(at, at[1:], strict=False)])
    return cut


class _Ragged:
    """Byte strings by id, joined for whole arrays of ids at once."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes end in the joined string."""
        return np.cumsum(self.lengths[ids])

    def joined(self, ids: np.ndarray) -> bytes:
        ends = self.offsets(ids)
        if not len(ids):
            return b""
        shift = self.starts[ids] - ends + self.lengths[ids]
        return self.bytes[np.arange(ends[-1]) + np.repeat(shift, self.lengths[ids])].tobytes()


class ByteBpe:
    """A rank file's encoder and decoder. Ids go as 16-bit numbers where the ranks allow it."""

    def __init__(self, rank_file: str):
        with open(rank_file, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values()) + 1
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        strings = [b""] * size
        for token, rank in self.ranks.items():
            strings[rank] = token
        self.tokens = _Ragged(strings)
        self.numerals = _Ragged([b"%d " % i for i in range(size)])
        self.words = Cache(self._merge)

    def _merge(self, word: str) -> bytes:
        piece = word.encode()
        whole = self.ranks.get(piece)
        ids = [whole] if whole is not None else [self.ranks[p] for p in merge_pairs(piece, self.ranks)]
        return np.array(ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), self.kind) for words in pieces(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens.joined(ids[i : i + 1_000_000]) for i in range(0, len(ids), 1_000_000))

    def digest(self, ids: np.ndarray) -> tuple[int, str, str]:
        """Number of ids; digests of their numerals joined by a space, and of what they decode to."""
        said, decoded = hashlib.sha256(), hashlib.sha256()
        for i in range(0, len(ids), 1_000_000):
            part = ids[i : i + 1_000_000]
            numerals = self.numerals.joined(part)
            said.update(numerals if i + len(part) < len(ids) else numerals[:-1])
            decoded.update(self.tokens.joined(part))
        return len(ids), said.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=2)
def byte_bpe(rank_file: str) -> ByteBpe:
    import public_tokenizers

    return ByteBpe(public_tokenizers.path(rank_file))


def encode(docs: DataFrame, text_col: str = "text", rank_file: str = RANK_FILE) -> DataFrame:
    """All rows and columns of ``docs`` with ``ids`` and ``ends``: tokens, and where in the text's
    UTF-8 bytes each ends.

    A null or empty text has no tokens. Rows that repeat a text are encoded each; a text may be of any
    length. An empty table gives an empty result. Columns of ``docs`` named like the two are replaced; others
    may have any names.
    """
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64()))])

    @F.arrow_udf("ids array<int>, ends array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        bpe = byte_bpe(rank_file)
        rows = [
            {"ids": ids.astype(np.int32), "ends": bpe.tokens.offsets(ids)}
            for part in blocks(texts_of(texts))
            for ids in bpe.encode(part)
        ]
        return pa.array(rows, kind)

    docs = docs.drop(*(c for c in ("ids", "ends") if c != text_col))
    name = free_name(docs, "coded")
    coded = docs.withColumn(name, run(text_or_empty(text_col)))
    return coded.select(*(F.col(f"`{c}`") for c in docs.columns), f"{name}.ids", f"{name}.ends")


def decode(coded: DataFrame, ids_col: str = "ids", rank_file: str = RANK_FILE) -> DataFrame:
    """All rows and columns with ``decoded``: the bytes of the ids. Null ids decode to no bytes.

    A column that is named so already is replaced. An empty table gives an empty result.
    """

    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        bpe = byte_bpe(rank_file)
        return pa.array([bpe.decode(np.array(x or [], bpe.kind)) for x in ids.to_pylist()], pa.binary())

    return coded.withColumn("decoded", run(F.col(ids_col)))


def encoding_digests(docs: DataFrame, text_col: str = "text", rank_file: str = RANK_FILE) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    As ``encode`` followed by ``decode``, without moving the ids out of the task that makes them. Nulls, empty
    and long texts and repeated rows are as there; an empty table gives an empty result. Columns named like the
    three are replaced.
    """
    names = ("n_tokens", "ids_sha256", "decoded_sha256")

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def run(texts: pa.Array) -> pa.Array:
        bpe = byte_bpe(rank_file)
        rows = [bpe.digest(ids) for part in blocks(texts_of(texts)) for ids in bpe.encode(part)]
        n, said, decoded = zip(*rows, strict=True) if rows else ((), (), ())
        columns = [pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())]
        return pa.StructArray.from_arrays(columns, names)

    docs = docs.drop(*(c for c in names if c != text_col))
    name = free_name(docs, "coded")
    coded = docs.withColumn(name, run(text_or_empty(text_col)))
    return coded.select(*(F.col(f"`{c}`") for c in docs.columns), *(f"{name}.{c}" for c in names))
