"""Phrase collocation mining by SON partitioning.

The texts are dealt to a few shards. A phrase that reaches the support in a language reaches, in at least
one shard, the share of the support that is the shard's share of the language's words. So each shard is
mined completely at its own lowered support, level by level: words, then pairs of words that are both
frequent, then longer phrases all of whose pairs are. The phrases that any shard found are candidates, and
all of them are counted exactly over all shards.

A shard is a part of the data, not a task: its phrases are counted by hash in every block of text and added
up behind a shuffle. The candidates of a level go to the tasks as a bit filter of a bounded size.
Hashes that meet, there or in the counts, only make more candidates; the last count is by the phrases.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatetally.llm.common import text_or_empty, written
from gatetally.llm.hashfilter import GATHERED, Gathered, HashFilter, Sizes, bucketed, filter_of
from gatetally.llm.scan import blocks, texts_of
from gatetally.llm.wordhash import byte_table, joined_bytes, mixed, run_hashes, word_hashes, word_spans

SUPPORT = 30
LONGEST = 4
TOP = 2000
#: A candidate goes where a longer one has this percentage of its occurrences.
COVERED = 80
UNKNOWN = "und"
#: More shards lower the local support; at SUPPORT of them every phrase would be a candidate.
SHARDS = 4
#: Bytes of text for each bit of a level's filter, up to the filter's bound.
BYTES_PER_BIT = 16
#: Code points that are worked on at once.
BLOCK = 1 << 21
#: Parts that a language's candidates are ranked in before they are ranked together.
SALTS = 16
#: Up to so many pairs of shard and language are broadcast with their supports.
BROADCAST_SUPPORTS = 100_000

_LOWERED = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\n\x0b\x0c\r" + b"\t",
    b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ",
)
_IS_BLANK = byte_table(b" \n")


class _Pieces:
    """The words of texts of one language, with hashes of phrases that don't cross the end of a piece."""

    def __init__(self, lang: str, texts: list[str], salt: int = 0):
        self.bytes = b"\n".join([t.encode() for t in texts]).translate(_LOWERED) + b"\n"
        data, _ = joined_bytes([self.bytes])
        self.starts, self.ends = word_spans(data, _IS_BLANK)
        piece = np.cumsum(data == 10, dtype=np.int32)[self.starts] if len(self.starts) else np.zeros(0, np.int32)
        self.piece = piece
        of_lang = np.uint64(zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 % (1 << 64))
        self.words = mixed(word_hashes(data, self.starts, self.ends, salt) + of_lang)

    def places(self, length: int) -> np.ndarray:
        """Where phrases of ``length`` words start."""
        if length == 1:
            return np.arange(len(self.words))
        return np.flatnonzero(self.piece[length - 1 :] == self.piece[: 1 - length])

    def hashes(self, places: np.ndarray, length: int) -> np.ndarray:
        return self.words[places] if length == 1 else run_hashes(self.words, places, length)

    def possible(self, length: int, filters: list[HashFilter]) -> np.ndarray:
        """Places of phrases whose words and, of longer ones, pairs are all in the filters before."""
        places = self.places(length)
        if length == 1:
            return places
        part = min(length - 1, 2)
        inside = np.zeros(len(self.words), bool)
        at = self.places(part)
        inside[at] = filters[part - 1].has(self.hashes(at, part))
        good = inside[places]
        for i in range(1, length - part + 1):
            good &= inside[places + i]
        return places[good]


def _blocks_by_group(batches: Iterator[pa.RecordBatch], by_shard: bool) -> Iterator[tuple[int, str, list[str]]]:
    """Shard (or 0), language and texts, from columns of these."""
    for batch in batches:
        shards = batch.column(0).to_pylist() if by_shard else [0] * len(batch)
        groups = list(zip(shards, batch.column(1).to_pylist(), strict=True))
        done = 0
        for texts in blocks(texts_of(batch.column(2)), BLOCK):
            by_group: dict[tuple[int, str], list[str]] = {}
            for group, text in zip(groups[done : done + len(texts)], texts, strict=True):
                by_group.setdefault(group, []).append(text)
            done += len(texts)
            for (shard, lang), own in by_group.items():
                yield shard, lang, own


def _local_hashes(lengths: range, filters: list[HashFilter], support: int, sizes: Sizes) -> Callable:
    """Hashes of possible phrases by shard, language and bucket; with words, their number under a null bucket."""

    def rows(gathered: Gathered, least: int) -> Iterator[pa.RecordBatch]:
        for (shard, lang), hashes in gathered.taken(least):
            buckets, rests = bucketed(hashes, support, sizes)
            yield _row_batch(shard, lang, buckets, rests, pa.nulls(len(buckets), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n_words = Gathered(), Counter()
        for shard, lang, texts in _blocks_by_group(batches, True):
            pieces = _Pieces(lang, texts)
            for length in lengths:
                hashes = pieces.hashes(pieces.possible(length, filters), length)
                gathered.add((shard, lang), hashes)
                n_words[shard, lang] += len(hashes) if length == 1 else 0
            yield from rows(gathered, GATHERED)
        yield from rows(gathered, 1)
        for (shard, lang), n in n_words.items():
            yield _row_batch(shard, lang, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([n], pa.int64()))

    return run


def _row_batch(shard: int, lang: str, buckets: pa.Array, hashes: pa.Array, n: pa.Array) -> pa.RecordBatch:
    shards, langs = pa.repeat(pa.scalar(shard, pa.int64()), len(n)), pa.repeat(pa.scalar(lang, pa.string()), len(n))
    return pa.RecordBatch.from_arrays([shards, langs, buckets, hashes, n], ["shard", "lang", "bucket", "hashes", "n"])


def _phrase_counts(longest: int, filters: list[HashFilter]) -> Callable:
    """Occurrences in a block of every candidate: words joined by one space.

    Phrases are told apart by two hashes of different words' hashes, 128 bits together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lang, texts in _blocks_by_group(batches, False):
            pieces, again = _Pieces(lang, texts), _Pieces(lang, texts, salt=1)
            for length in range(1, longest + 1):
                places = pieces.places(length)
                hashes = pieces.hashes(places, length)
                good = filters[min(length, len(filters)) - 1].has(hashes)
                places, hashes = places[good], hashes[good]
                if not len(places):
                    continue
                order = np.argsort(hashes, kind="stable")
                places, hashes = places[order], hashes[order]
                other = again.hashes(places, length)
                first = np.ones(len(places), bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (other[1:] != other[:-1])
                cuts = np.flatnonzero(first)
                n = np.diff(np.concatenate((cuts, [len(places)])))
                at = places[cuts]
                phrases = [
                    b" ".join([w for w in pieces.bytes[a:b].split(b" ") if w])
                    for a, b in zip(pieces.starts[at].tolist(), pieces.ends[at + length - 1].tolist(), strict=True)
                ]
                size = len(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(length, pa.int32()), size),
                        pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()),
                    ],
                    ["lang", "length", "phrase", "n"],
                )

    return run


def phrase_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST
) -> tuple[DataFrame, DataFrame]:
    """(lang, length, phrase, f) of all phrases up to ``longest`` words with f >= ``support``, and (lang, n).

    f are all occurrences of a phrase inside pieces, overlapping ones too; n all words of a language.
    """
    text = text_or_empty(text_col)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    shard = F.pmod(F.xxhash64(text), F.lit(SHARDS))
    texts = docs.select(shard.alias("shard"), lang.alias("lang"), text.alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    sizes = Sizes(n_bytes, BYTES_PER_BIT)

    def local(lengths: range, filters: list[HashFilter]) -> DataFrame:
        run = _local_hashes(lengths, filters, support, sizes)
        return texts.mapInArrow(run, "shard long, lang string, bucket long, hashes binary, n long")

    words = written(local(range(1, 2), []), "collocation_words")
    of_shard = words.filter("n > 0").groupBy("shard", "lang").agg(F.sum("n").alias("words"))
    totals = of_shard.groupBy("lang").agg(F.sum("words").alias("n"))
    share = F.col("words").cast("decimal(20,0)") * support
    needs = of_shard.join(totals, "lang").withColumn("share", share)
    needs = needs.selectExpr("shard", "lang", "(share + n - 1) div n AS need")
    needs = written(needs, "collocation_supports")
    if needs.count() <= BROADCAST_SUPPORTS:
        needs = F.broadcast(needs)

    filters: list[HashFilter] = []
    for lengths in (range(1, 2), range(2, 3), range(3, longest + 1)):
        if lengths:
            hashes = words if lengths[0] == 1 else local(lengths, filters)
            hashes = hashes.filter("bucket is not null").join(needs, ["shard", "lang"])
            filters.append(filter_of(hashes.select("bucket", "shard", "need", "hashes"), sizes))

    exact = texts.mapInArrow(_phrase_counts(longest, filters), "lang string, length int, phrase string, n long")
    exact = exact.groupBy("lang", "length", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= support)
    return written(exact, "collocation_phrases"), totals


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST,
    top: int = TOP, covered: int = COVERED,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words.

    A-Z are lower-cased, texts are split at ``. , ; : ! ?`` and line ends into pieces and those at spaces
    and tabs into words; a phrase is a run of words inside a piece. Candidates have a >= ``support``. Of the
    cuts of a phrase in two, with l and r occurrences, the one with the least score
    ``floor(2000000 a / (l + r))`` counts, of equals the first. A candidate whose words lie inside a longer
    one that has at least ``covered`` percent of its occurrences is dropped. Order: score and a falling,
    phrase by its bytes. A null text is empty, a null language ``und``; rows that repeat each count. An empty
    table gives an empty result; other columns play no part, whatever their names.
    """
    phrases, totals = phrase_counts(docs, text_col, lang_col, support, longest)
    candidates = phrases.filter("length > 1").select("lang", "length", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def part(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cuts = F.transform(
        F.sequence(F.lit(1), F.col("length") - 1),
        lambda k: F.array(
            F.struct(k.alias("k"), F.lit(True).alias("left"), part(F.lit(1), k).alias("part")),
            F.struct(k.alias("k"), F.lit(False).alias("left"), part(k + 1, F.col("length") - k).alias("part")),
        ),
    )
    parts = candidates.select("lang", "phrase", "a", F.explode(F.flatten(cuts)).alias("c"))
    parts = parts.select("lang", "phrase", "a", "c.k", "c.left", "c.part")
    known = phrases.filter(F.col("length") < longest).select("lang", F.col("phrase").alias("part"), "f")
    cut = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    # a has up to 64 bits, so the product doesn't fit in them.
    cut = cut.withColumn("score", F.expr("(cast(a AS decimal(20,0)) * 2000000) div (l + r)"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))

    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("length") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("length") - m + 1), lambda i: part(i, m)),
        )
    )
    longer = candidates.filter("length > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest_a"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(
        f"longest_a IS NULL OR cast(longest_a AS decimal(20,0)) * 100 < cast(a AS decimal(20,0)) * {covered}"
    )
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    kept = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # The first of a language are among the first of each of its parts, so no task ranks all its phrases.
    in_part = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    ranked = kept.withColumn("rank", in_part).filter(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked.filter(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
