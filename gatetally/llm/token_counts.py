"""Token counts of whole texts by finite-state transducers compiled from a piece vocabulary.

The vocabulary's greedy merging never crosses the start of a run of spaces, nor a character that is
in no longer piece. A first transducer of three states marks those places and emits the tokens of
the lone characters on the way; the state maps of its chunks are composed by a prefix scan. A second
one counts the tokens of the segments between them: its transitions follow an automaton of all pieces,
carry the last piece of each prefix, and are annotated with the tokens that the prefix has so far.
What it finds for a segment is kept.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatetally.llm.common import text_or_empty
from gatetally.llm.scan import Cache, blocks, codepoints, merge_pairs, scan_states, texts_of

#: The mark that stands for a space.
SPACE = "▁"

_TEXT, _SPACE, _LONE, _END = range(4)
_FRESH, _IN_SPACES, _IN_WORD = range(3)
_NEXT = np.array(
    [
        [_IN_WORD, _IN_WORD, _IN_WORD],
        [_IN_SPACES, _IN_SPACES, _IN_SPACES],
        [_FRESH, _FRESH, _FRESH],
        [_FRESH, _FRESH, _FRESH],
    ],
    np.uint8,
)
#: Whether a segment starts before the symbol, by symbol and state.
_STARTS = np.array([[1, 0, 0], [1, 0, 1], [1, 1, 1], [1, 1, 1]], bool)


class Segments:
    """The second transducer: tokens of a segment that starts afresh."""

    def __init__(self, pieces: list[tuple[str, float]], extra: dict[str, int]):
        """``pieces`` with ranks, least first; ``extra``: single characters that cost several tokens."""
        self.ranks = dict(pieces)
        names = [*self.ranks, *(c for c in extra if c not in self.ranks)]
        self.names, self.cost = names, [1 if x in self.ranks else extra[x] for x in names]
        self.goto: list[dict[str, int]] = [{}]
        ends: list[int] = [-1]
        for k, name in enumerate(names):
            node = 0
            for ch in name:
                if ch not in self.goto[node]:
                    self.goto[node][ch] = len(self.goto)
                    self.goto.append({})
                    ends.append(-1)
                node = self.goto[node][ch]
            ends[node] = k
        # Breadth first: where to go on from a failed match, and all pieces that end at a node.
        self.fail = [0] * len(self.goto)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(self.goto)
        queue = [0]
        for node in queue:
            for ch, child in self.goto[node].items():
                back = self.fail[node]
                while back and ch not in self.goto[back]:
                    back = self.fail[back]
                self.fail[child] = self.goto[back].get(ch, 0) if node else 0
                own = ((len(names[ends[child]]), ends[child]),) if ends[child] >= 0 else ()
                self.ending[child] = own + self.ending[self.fail[child]]
                queue.append(child)
        self.adjacent: dict[int, bool] = {}

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging their joined text gives these two pieces again."""
        key = left << 20 | right
        known = self.adjacent.get(key)
        if known is None:
            pair = [self.names[left], self.names[right]]
            known = merge_pairs(pair[0] + pair[1], self.ranks) == pair
            if len(self.adjacent) > 1_000_000:
                self.adjacent.clear()
            self.adjacent[key] = known
        return known

    def count(self, segment: str) -> int:
        """Tokens of ``segment``. Each prefix has one last piece: the one that stays apart from the
        last piece of what is before it."""
        goto, fail, ending = self.goto, self.fail, self.ending
        node, last, tokens = 0, [-1], [0]
        for ch in segment:
            while node and ch not in goto[node]:
                node = fail[node]
            node = goto[node].get(ch, 0)
            for length, piece in ending[node]:
                before = last[-length]
                if before < 0 or self.stay_apart(before, piece):
                    tokens.append(tokens[-length] + self.cost[piece])
                    last.append(piece)
                    break
        return tokens[-1]


class Counter:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [
            (model.id_to_piece(i), -model.get_score(i))
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        known = {p for p, _ in pieces if len(p) == 1}
        joined = {c for p, _ in pieces if len(p) > 1 for c in p}
        # Characters outside the vocabulary cost a token for each of their bytes.
        self.cost = np.repeat(np.array([1, 2, 3, 4], np.uint8), [0x80, 0x780, 0xF800, 0x100000])
        self.cost[[ord(c) for c in known]] = 1
        self.kind = np.full(0x110000, _LONE, np.uint8)
        self.kind[[ord(c) for c in joined]] = _TEXT
        self.kind[[ord(" "), ord(SPACE)]] = _SPACE
        extra = {c: len(c.encode()) for c in joined}
        self.segments = Cache(Segments(pieces, extra).count)

    def counts(self, texts: Iterable[str]) -> np.ndarray:
        return np.concatenate([self._counts(run) for run in blocks(texts)] or [np.zeros(0, np.int64)])

    def _counts(self, texts: list[str]) -> np.ndarray:
        # A text that isn't empty gets a space before it.
        texts = [SPACE + x.replace(" ", SPACE) if x else x for x in texts]
        points, starts, ends = codepoints(texts)
        symbols = self.kind[points]
        symbols[ends] = _END
        states = scan_states(symbols, _NEXT)
        emitted = np.where(symbols == _LONE, self.cost[points], 0)
        totals = np.concatenate(([0], np.cumsum(emitted, dtype=np.int64)))
        totals = totals[ends] - totals[starts]
        cuts = np.flatnonzero(_STARTS[symbols, states])
        first = np.searchsorted(cuts, starts)
        after = np.searchsorted(cuts, ends)
        is_segment = symbols[cuts] < _LONE
        get = self.segments.__getitem__
        for i, text in enumerate(texts):
            if not text:
                continue
            at = cuts[first[i] : after[i] + 1] - starts[i]  # the last is the text's end
            whole = is_segment[first[i] : after[i]]
            begin, end = at[:-1][whole].tolist(), at[1:][whole].tolist()
            totals[i] += sum(map(get, [text[a:b] for a, b in zip(begin, end, strict=True)]))
        return totals


@lru_cache(maxsize=2)
def counter(model_file: str) -> Counter:
    return Counter(model_file)


def token_count(text: Column, model: str = "piece_bpe_32k.model") -> Column:
    """Tokens of each text under a public tokenizer's model, as its library gives them."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        import public_tokenizers

        return pa.array(counter(public_tokenizers.path(model)).counts(texts_of(texts)))

    return count(text)


def token_counts(docs: DataFrame, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Whole texts are counted, without begin, end or special tokens; special strings are plain text.
    A null or empty text has no tokens. Rows that repeat a text are counted each; a text may be of any
    length, as blocks of it are worked on in turn. An empty table gives an empty result. Columns of ``docs``
    named like the three are replaced; others may have any names.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    docs = docs.drop(*(c for c in added if c != text_col))
    text = text_or_empty(text_col)
    counted = docs.withColumn("n_bytes", F.octet_length(text).cast("bigint"))
    counted = counted.withColumn("n_tokens", token_count(text))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
