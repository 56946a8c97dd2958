"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of word n-grams. Documents with equal sets form a class, and only classes are compared.
MinHash signatures are cut into bands; classes that agree in a band are candidates. Their signatures are
compared piece by piece, and a pair is dropped once the posterior probability that its similarity reaches
the threshold is below a tolerance. The rest are verified exactly on their sets.

A bucket of many classes is split into blocks, and each pair of blocks is compared in one place. What comes
out is a row per class there, with its partners, never a row per pair. A pair that agrees in several bands
is compared in the first of them only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatetally.llm.common import WORD, null_safe, text_or_empty, written
from gatetally.llm.components import components
from gatetally.llm.scan import Cache, texts_of

N_WORDS = 5
THRESHOLD = 0.8
#: Bands of so many rows each: a pair at the threshold agrees in none with probability 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: A pair is dropped when the posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-6
#: Signature values compared at a time.
STEP = 32
#: Pairs compared at a time in a task.
PAIRS = 40_000
#: Classes per block of a bucket.
BLOCK = 512
#: Up to so many classes (their number, id and text hash) are broadcast; beyond it they are joined.
BROADCAST_IDS = 2_000_000

_WORDS = re.compile(WORD)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


_known = Cache(_word_hash)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, n_words: int = N_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct n-grams of words; case plays no part.

    A text of fewer words is one n-gram of all of them; one without words has none.
    """
    words = _WORDS.findall(text.lower())
    hashed = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    if not words:
        return hashed
    width = min(n_words, len(words))
    total = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        total = _mixed(total * _PRIME + hashed[i : len(words) - width + 1 + i])
    return np.unique(total)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    numbers = np.random.default_rng(20).integers(0, 1 << 32, (2, HASHES), dtype=np.uint64).astype(np.uint32)
    return numbers[0] | np.uint32(1), numbers[1]


_A, _B = _multipliers()


def signature(found: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of n-grams: the upper 16 bits of the least hash, ``HASHES`` of them."""
    least = np.full(HASHES, np.uint32(0xFFFFFFFF))
    high = (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 512):
        least = np.minimum(least, (high[i : i + 512, None] * _A + _B).min(axis=0))
    return (least >> np.uint32(16)).astype(np.uint16)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, rows by bands. Different bands have different keys for equal values."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        keys = _mixed(keys * _PRIME + parts[:, :, i] + np.uint64(1))
    return keys.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each compared prefix of the signature, the least number of equal values that may go on.

    With a uniform prior, after m equal of k the posterior probability of a similarity of ``threshold``
    or more is that of a binomial of k + 1 trials at ``threshold`` being at most m.
    """
    bounds = []
    for k in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while True:
            below += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if below >= tolerance:
                break
            m += 1
        bounds.append(m)
    return bounds


def _sketch(text: Column) -> Column:
    """digest of the set, its size, its signature and its band keys."""
    names = ("digest", "n", "signature", "keys")

    @F.arrow_udf("digest binary, n bigint, signature binary, keys array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        digests, sizes, signatures = [], [], []
        for t in texts_of(texts):
            found = shingles(t)
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            sizes.append(len(found))
            signatures.append(signature(found))
        keys = band_keys(np.stack(signatures)) if signatures else np.zeros((0, BANDS), np.int64)
        offsets = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
        columns = [
            pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
            pa.array([s.tobytes() for s in signatures], pa.binary()),
            pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))),
        ]
        return pa.StructArray.from_arrays(columns, names)

    return run(text)


def _shingle_bytes(text: Column) -> Column:
    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t).tobytes() for t in texts_of(texts)], pa.binary())

    return run(text)


def _whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows that come in order of ``by``, in frames that split no group; and where the groups start."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        frame = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
        starts = _group_starts(frame, by)
        rest = frame.iloc[starts[-1] :]
        if starts[-1]:
            yield frame.iloc[: starts[-1]], starts[:-1]
    if rest is not None:
        yield rest.reset_index(drop=True), np.zeros(1, np.int64)


def _group_starts(frame: pd.DataFrame, by: list[str]) -> np.ndarray:
    values = frame[by].to_numpy()
    return np.concatenate(([0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1))


def _pairs_of_groups(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs inside each group, ``PAIRS`` at a time."""
    for size in np.unique(sizes[sizes > 1]):
        a, b = np.triu_indices(size, 1)
        own = starts[sizes == size]
        at_once = max(1, PAIRS // len(a))
        for i in range(0, len(own), at_once):
            some = own[i : i + at_once, None]
            for j in range(0, len(a), PAIRS):
                yield (some + a[j : j + PAIRS]).ravel(), (some + b[j : j + PAIRS]).ravel()


TILE = ["key", "first", "second"]


def _prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates inside each tile that survive; a row per class in one, with its larger partners."""
    bounds = least_matches()
    for frame, starts in _whole_groups(batches, TILE):
        ids, n, block = (frame[c].to_numpy() for c in ("id", "n", "block"))
        within = frame["first"].to_numpy() == frame["second"].to_numpy()
        values = np.frombuffer(b"".join(frame["signature"]), np.uint16).reshape(-1, HASHES)
        keys, own_key = band_keys(values), frame["key"].to_numpy()
        sizes = np.diff(np.append(starts, len(frame)))
        found = []
        for a, b in _pairs_of_groups(starts, sizes):
            small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            # Across two blocks; or all pairs of one. The sizes alone may rule a pair out.
            go_on = (within[a] | (block[a] != block[b])) & (small >= THRESHOLD * large) & (ids[a] != ids[b])
            a, b = a[go_on], b[go_on]
            agree = keys[a] == keys[b]
            first = keys[a, agree.argmax(axis=1)] == own_key[a]
            a, b = a[first], b[first]
            equal = np.zeros(len(a), np.int64)
            for k, bound in enumerate(bounds):
                part = slice(k * STEP, (k + 1) * STEP)
                equal += (values[a, part] == values[b, part]).sum(axis=1)
                a, b, equal = (x[equal >= bound] for x in (a, b, equal))
            found.append(np.stack((a, b)))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        if not len(a):
            continue
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        rows = np.unique(np.concatenate((a, b)))
        cuts = np.searchsorted(a, rows[1:])
        out = frame.iloc[rows][[*TILE, "id"]].copy()
        out["partners"] = np.split(ids[b], cuts)
        yield out


def _links_in(ids: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair of rows (a, b) really reaches the threshold."""
    sizes = np.array([len(s) for s in sets])
    if len(a) < 64:
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])
    else:
        # Rows by n-grams that two rows have, multiplied some columns at a time.
        _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        common = seen[column] > 1
        row, column = row[common], np.unique(column[common], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        together = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            part = slice(*np.searchsorted(column, [at, at + width]))
            x = np.zeros((len(sets), width), np.float32)
            x[row[part], column[part] - at] = 1
            together += x @ x.T
        shared = together[a, b].astype(np.int64)
    # shared / union >= threshold, in whole numbers of hundredths.
    return shared * 100 >= round(THRESHOLD * 100) * (sizes[a] + sizes[b] - shared)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per class and tile: its links there, and the least class of those it is linked to there."""
    for frame, starts in _whole_groups(batches, TILE):
        out = []
        for begin, end in zip(starts, np.append(starts[1:], len(frame)), strict=True):
            part = frame.iloc[begin:end]
            ids = part["id"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
            partners = part["partners"].tolist()
            a = np.repeat(np.arange(len(ids)), [len(p) for p in partners])
            by_id = np.argsort(ids)
            b = by_id[np.searchsorted(ids, np.concatenate(partners), sorter=by_id)]
            linked = _links_in(ids, sets, a, b)
            a, b = a[linked], b[linked]
            label, before = ids.copy(), None
            while before is None or (before != label).any():
                before = label.copy()
                np.minimum.at(label, a, before[b])
                np.minimum.at(label, b, before[a])
            n = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
            out.append(pd.DataFrame({"id": ids, "n_links": n, "label": label})[n > 0])
        yield pd.concat(out)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, copy_id, n_copies, n_links, text_hash, stays: one row per row of ``docs``.

    ``copy_id`` is the least id with the same set of n-grams, ``n_copies`` the number of such rows.
    ``n_links`` is the number of other such classes whose similarity reaches the threshold, and
    ``class_id`` the least ``copy_id`` that is linked, directly or through others. ``stays`` is true for one row
    of all that are linked, of those with the least id; ``text_hash`` is the XXH64 of the text, by which rows
    that share an id are told apart.

    Classes are those of equal sets, whatever the ids: ids may be null (after all others), shared by several
    texts, repeated, and of any type that has an order. A null text equals an empty one. A text without words
    has no links and is a class of its own. Texts are taken whole. An empty table gives an empty result; other
    columns play no part.
    """
    docs = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    sketched = docs.select("id", "text_hash", _sketch(F.col("text")).alias("s")).select("id", "text_hash", "s.*")
    # A number of the row, which stands for its class from here on; it is fixed by being written.
    sketched = written(sketched.withColumn("nr", F.monotonically_increasing_id()), "ngram_sketches")
    best = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "nr")).alias("best")
    classes = sketched.filter("n > 0").groupBy("digest").agg(best, F.count("*").alias("n_copies"))
    classes = written(classes.select("digest", "best", "best.nr", "n_copies"), "ngram_classes")

    # Copies in other rows than the class's own go no further.
    several = classes.filter("n_copies > 1").select("digest", F.col("nr").alias("_own"))
    single = sketched.filter("n > 0").join(several, "digest", "left")
    reps = single.filter("_own is null or nr = _own").select("nr", "id", "text_hash", "n", "signature", "keys")
    reps = written(reps, "ngram_classes")

    members = reps.select("nr", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = members.join(buckets, "key").select("key", "nr", blocks.alias("blocks"))
    members = members.withColumn("block", F.pmod(F.xxhash64("nr"), F.col("blocks")).cast("int"))
    tiles = members.select("key", "nr", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select(
        "key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "nr"
    )
    tiles = tiles.join(reps.select("nr", "n", "signature"), "nr").withColumnRenamed("nr", "id")
    pruned = tiles.repartition(*TILE).sortWithinPartitions(*TILE, "id").mapInPandas(
        _prune, "key bigint, first int, second int, id bigint, partners array<bigint>"
    )
    pruned = written(pruned, "ngram_candidates")

    # The candidates' texts, by id and hash: rows that repeat both have one text, and one of them is taken.
    chosen = pruned.select(F.col("id").alias("nr")).distinct()
    n_chosen = chosen.count()
    chosen = chosen.join(reps.select("nr", "id", "text_hash"), "nr")
    chosen = F.broadcast(chosen) if n_chosen <= BROADCAST_IDS else chosen
    texts = null_safe(docs, chosen, ["id", "text_hash"]).dropDuplicates(["nr"])
    sets = texts.select(F.col("nr").alias("id"), _shingle_bytes(F.col("text")).alias("shingles"))
    verified = pruned.join(sets, "id").repartition(*TILE).sortWithinPartitions(*TILE, "id").mapInPandas(
        _verify, "id bigint, n_links bigint, label bigint"
    )
    verified = written(verified, "ngram_links")

    n_links = verified.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    joined = components(verified.select(F.col("id").alias("u"), F.col("label").alias("v")))
    linked = n_links.join(joined, "id", "left").withColumnRenamed("id", "nr")
    # Classes of one row without links need no join: only the others' tables are joined.
    linked = classes.join(linked, "nr", "left").filter("n_copies > 1 or n_links is not null")
    linked = written(linked.withColumn("component", F.coalesce("component", "nr")), "ngram_linked")
    firsts = linked.groupBy("component").agg(F.min("best").alias("first"))
    linked = linked.join(firsts, "component").select("digest", "best", "first", "n_copies", "n_links")
    result = sketched.select("id", "text_hash", "nr", "digest").join(linked, "digest", "left")
    alone = F.col("first").isNull()
    return result.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1).cast("bigint")).alias("n_copies"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        "text_hash", (alone | (F.col("nr") == F.col("first.nr"))).alias("stays"),
    )
