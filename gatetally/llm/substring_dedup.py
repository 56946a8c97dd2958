"""Substring dedup by level-wise doubling.

Windows of a few words that occur once rule out every longer window around them. So all windows of the
first length are counted by hash; only where two adjoining ones both repeat is the window of twice the
length counted; and so on, up to the length asked for, whose windows are made of two overlapping ones.
There the candidates that are left are compared by digests of their words, which decides.

What a level leaves behind is a bit filter of a bounded size, over the hashes that repeat. It never misses
a repeated window; where it takes a window for repeated that isn't, the last level finds out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatetally.llm.common import text_or_empty, written
from gatetally.llm.hashfilter import GATHERED, Gathered, HashFilter, Sizes, bucketed, filter_of
from gatetally.llm.scan import blocks, texts_of
from gatetally.llm.wordhash import joined_bytes, run_hashes, word_hashes, word_spans

WINDOW = 35
#: The first length is the window's, halved until it is at most this.
FIRST = 9
#: Bytes of text for each bit of a level's filter, up to the filter's bound.
BYTES_PER_BIT = 16
#: Bytes of a window's digest, which decides.
DIGEST = 12

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def lengths_to(window: int) -> list[int]:
    """The window lengths of the levels: each is at most twice the one before."""
    lengths = [window]
    while lengths[0] > FIRST:
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


class _Words:
    """The words of some texts, with hashes of windows at one length after the other."""

    def __init__(self, texts: list[str]):
        data, ends = joined_bytes([t.encode() for t in texts])
        starts, word_ends = word_spans(data)
        self.words = word_hashes(data, starts, word_ends)
        last = np.searchsorted(starts, ends)
        self.first = np.concatenate(([0], last[:-1]))
        self.counts = last - self.first
        self.text_end = np.repeat(last, self.counts)

    def candidates(self, lengths: list[int], filters: list[HashFilter]) -> np.ndarray:
        """Where windows of the last length start that no shorter length has ruled out."""
        at = np.arange(len(self.words))
        for i, length in enumerate(lengths):
            if i:
                repeated = np.zeros(len(self.words), bool)
                hashes = run_hashes(self.words, at, lengths[i - 1])
                repeated[at] = filters[i - 1].has(hashes)
                other = at + (length - lengths[i - 1])
                inside = other < len(self.words)
                at = at[inside][repeated[at[inside]] & repeated[other[inside]]]
            at = at[at + length <= self.text_end[at]]
        return at


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], _Words]]:
    """Ids, texts and words of the columns id and text, a block of text at a time."""
    for batch in batches:
        ids, done = batch.column(0), 0
        for texts in blocks(texts_of(batch.column(1))):
            yield ids.slice(done, len(texts)), texts, _Words(texts)
            done += len(texts)


def _hashes_by_bucket(lengths: list[int], filters: list[HashFilter], sizes: Sizes) -> Callable:
    """Hashes of candidate windows by bucket; one that is gathered twice or more is there twice."""

    def rows(gathered: Gathered, least: int) -> Iterator[pa.RecordBatch]:
        for _, hashes in gathered.taken(least):
            buckets, rests = bucketed(hashes, 2, sizes)
            shards, needs = (pa.repeat(pa.scalar(n), len(buckets)) for n in (0, 2))
            yield pa.RecordBatch.from_arrays([buckets, shards, needs, rests], ["bucket", "shard", "need", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered()
        for _, _, words in _words_of(batches):
            gathered.add(None, run_hashes(words.words, words.candidates(lengths, filters), lengths[-1]))
            yield from rows(gathered, GATHERED)
        yield from rows(gathered, 1)

    return run


def _level(texts: DataFrame, lengths: list[int], filters: list[HashFilter], sizes: Sizes) -> HashFilter:
    """The filter over the hashes of windows of the last length that occur more than once."""
    shape = "bucket long, shard long, need long, hashes binary"
    return filter_of(texts.mapInArrow(_hashes_by_bucket(lengths, filters, sizes), shape), sizes)


def _normalised(text: str) -> bytes:
    return b" ".join(text.encode().split())


def _runs(members: np.ndarray) -> list[dict[str, int]]:
    """Runs of set places, as (start, end)."""
    turns = np.flatnonzero(np.diff(np.concatenate(([0], members.view(np.int8), [0])))).tolist()
    return [{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)]


def _places(runs: list[dict[str, int]]) -> np.ndarray:
    return np.concatenate([np.arange(r["start"], r["end"]) for r in runs])


def _digests(text: str, places: np.ndarray, window: int) -> np.ndarray:
    """The digests of windows of a text whose words are joined by one space, a row of bytes each."""
    data = text.encode()
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))[places].tolist()
    ends = np.concatenate((spaces, [len(data)]))[places + window - 1].tolist()
    joined = b"".join([blake2b(data[a:b], digest_size=DIGEST).digest() for a, b in zip(starts, ends, strict=True)])
    return np.frombuffer(joined, np.uint8).reshape(-1, DIGEST)


def _numbers(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests as two numbers each."""
    digests = np.ascontiguousarray(digests)
    return np.ascontiguousarray(digests[:, :8]).view(np.uint64)[:, 0], np.ascontiguousarray(digests[:, 8:]).view(np.uint32)[:, 0]


def _candidate_rows(lengths: list[int], filters: list[HashFilter], id_type: pa.DataType) -> Callable:
    """Texts with candidates and the runs of these. ``block`` is a number of the block of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for ids, texts, words in _words_of(batches):
            at = words.candidates(lengths, filters)
            candidate = np.zeros(len(words.words), bool)
            candidate[at] = True
            # Texts without words start where the next one does; the last to start there has the words.
            rows = np.unique(np.searchsorted(words.first, at, "right") - 1).tolist()
            first = words.first.tolist()
            runs = [_runs(candidate[first[i] : first[i] + int(words.counts[i])]) for i in rows]
            kept = pa.array([_normalised(texts[i]).decode() for i in rows], pa.string())
            own = ids.take(pa.array(rows, pa.int64())).cast(id_type)
            numbers = pa.repeat(pa.scalar(block, pa.int64()), len(rows))
            yield pa.RecordBatch.from_arrays([numbers, own, kept, pa.array(runs, _SPANS)], ["block", "id", "words", "runs"])
            block += 1

    return run


def _digests_by_bucket(window: int, sizes: Sizes) -> Callable:
    """Digests of candidates by bucket and block; one that a batch has twice or more is there twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks_of = batch.column(0).to_numpy()
            found = [_digests(text, _places(runs), window) for text, runs in zip(texts_of(batch.column(1), 50), texts_of(batch.column(2), 50), strict=True)]
            if not found:
                continue
            block = np.repeat(blocks_of, [len(x) for x in found])
            digests = np.concatenate(found)
            high, low = _numbers(digests)
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            third = np.zeros(len(order), bool)
            third[2:] = (high[2:] == high[:-2]) & (low[2:] == low[:-2])
            order, bucket = order[~third], (high[~third] >> np.uint64(64 - sizes.buckets)).astype(np.int64)
            by_block = np.lexsort((block[order], bucket))
            order, bucket = order[by_block], bucket[by_block]
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[order[1:]] != block[order[:-1]])) + 1
            starts = np.concatenate(([0], cuts))
            parts = [digests[part].tobytes() for part in np.split(order, cuts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[starts]), pa.array(block[order[starts]]), pa.array(parts, pa.binary())], ["bucket", "block", "digests"]
            )

    return run


def _single(table: pa.Table) -> pa.Table:
    """Of a bucket's digests those that are there once only, by block."""
    parts = [np.frombuffer(part, np.uint8).reshape(-1, DIGEST) for part in table.column("digests").to_pylist()]
    which, digests = np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.concatenate(parts)
    high, low = _numbers(digests)
    order = np.lexsort((low, high))
    same = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
    single = order[~(np.concatenate(([False], same)) | np.concatenate((same, [False])))]
    single = single[np.argsort(which[single], kind="stable")]
    rows, starts = np.unique(which[single], return_index=True)
    found = [digests[part].tobytes() for part in np.split(single, starts[1:])] if len(rows) else []
    return pa.table([table.column("block").take(pa.array(rows)), pa.array(found, pa.binary())], ["block", "digests"])


def _straight_rows(lengths: list[int], filters: list[HashFilter], id_type: pa.DataType) -> Callable:
    """Texts without candidates: they are kept as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, words in _words_of(batches):
            rows = np.searchsorted(words.first, words.candidates(lengths, filters), "right") - 1
            straight = np.ones(len(texts), bool)
            straight[rows] = False
            keep = np.flatnonzero(straight)
            kept = [_normalised(texts[i]).decode() for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(keep)).cast(id_type), pa.array(words.counts[keep].astype(np.int64)), pa.array(kept, pa.string())],
                ["id", "n_words", "kept_text"],
            )

    return run


def _without(window: int, id_type: pa.DataType) -> Callable:
    """Texts without the words of their repeated windows, and what was removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, kept, spans = [], [], []
            for text, runs, single in zip(*(texts_of(batch.column(i), 50) for i in (1, 2, 3)), strict=True):
                places, words = _places(runs), text.split(" ")
                if single:
                    unique = {part[i : i + DIGEST] for part in single for i in range(0, len(part), DIGEST)}
                    digests = _digests(text, places, window).tobytes()
                    places = places[[digests[i : i + DIGEST] not in unique for i in range(0, len(digests), DIGEST)]]
                covered = np.zeros(len(words) + 1, np.int32)
                covered[places] += 1
                covered[places + window] -= 1
                gone = np.cumsum(covered[:-1]) > 0
                spans.append(_runs(gone))
                kept.append(" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]))
                n_words.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(id_type), pa.array(n_words, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, _SPANS)],
                ["id", "n_words", "kept_text", "removed"],
            )

    return run


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """A row per row of ``docs``: its id, ``n_words``, ``kept_text``, ``removed``.

    A word is removed when a window of ``window`` words around it has the same words as one that starts
    anywhere else, in the same text or another; all copies are removed. Windows are those of the whole
    input. ``removed`` has the word places taken out, as (start, end), ``kept_text`` the other words
    joined by one space. Words are runs without ASCII white space, otherwise unchanged. A null text is
    empty; texts shorter than the window stay. Ids may be null, repeated and of any type; rows that repeat
    a text repeat its windows. An empty table gives an empty result. Other columns play no part, whatever
    their names.

    The text is read once per level and once to let the texts without candidates through; only texts
    with candidates are shuffled. A passage that many texts share sends one hash per block of text.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_kind = texts.schema["id"].dataType
    id_type = texts.select("id").limit(0).toArrow().schema.field("id").type
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    sizes = Sizes(n_bytes, BYTES_PER_BIT)
    lengths, filters = lengths_to(window), []
    for i in range(1, len(lengths)):
        filters.append(_level(texts, lengths[:i], filters, sizes))

    kind, spans = id_kind.simpleString(), "array<struct<start: long, end: long>>"
    found = texts.mapInArrow(
        _candidate_rows(lengths, filters, id_type), f"block long, id {kind}, words string, runs {spans}"
    )
    found = written(found, "substring_candidates", "zstd")
    # What comes back are the candidates that are there once, the few that the filters have let through.
    digests = found.select("block", "words", "runs").mapInArrow(
        _digests_by_bucket(window, sizes), "bucket long, block long, digests binary"
    )
    single = digests.groupBy("bucket").applyInArrow(_single, "block long, digests binary")
    single = single.groupBy("block").agg(F.collect_list("digests").alias("single"))
    of_candidates = found.join(single, "block", "left").select("id", "words", "runs", "single")
    shape = f"id {kind}, n_words long, kept_text string"
    cut = of_candidates.mapInArrow(_without(window, id_type), f"{shape}, removed {spans}")
    straight = texts.mapInArrow(_straight_rows(lengths, filters, id_type), shape)
    straight = straight.select("*", F.from_json(F.lit("[]"), spans).alias("removed"))
    return straight.unionAll(cut).withColumnRenamed("id", id_col)
