"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are the words of a text, the shapes of its words, pairs of neighbours of both, and pairs of the
same word a few places apart, hashed into a fixed number of weights. Partitions of the labelled rows are trained on separately, each row by row,
and their weights averaged. A score is one sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatetally.llm.common import salted_uniform, text_or_empty
from gatetally.llm.scan import Cache, texts_of

BITS = 18
#: About so many labelled rows are learnt from; beyond, a random part of them (see ``train``).
TRAIN_ROWS = 24_000
PARTS = 8
PASSES = 2
#: Follow-the-regularised-leader: learning rate, its smoothing, and both regularisations.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1

#: How far back a word is looked for again.
REPEATS = 4

_SHAPES = ((re.compile(r"[^\W\d_]"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"a+"), "a"))


def _shape(word: str) -> str:
    """Its letters and digits as one of each; whether it is in capitals; its other signs as they are."""
    said = word
    for pattern, sign in _SHAPES:
        said = pattern.sub(sign, said)
    return said[:24] + ("^" if len(word) > 1 and word.isupper() else "")


def _hashes(word: str) -> int:
    return zlib.crc32(word.lower().encode()) << 32 | zlib.crc32(_shape(word).encode(), 1)


@lru_cache(maxsize=1)
def _words() -> Cache:
    return Cache(_hashes)


def _mixed_number(k: int) -> np.uint64:
    """A feature of its own for a small number."""
    return np.uint64(zlib.crc32(b"again %d" % k) << 32)


def features(text: str) -> np.ndarray:
    """Indexes of the features of a text, with repeats; 0 is the bias and isn't among them."""
    words = text.split()
    both = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    first, second = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    parts = [word * first]
    parts.append((shape + np.uint64(1)) * second)
    parts.append((word[:-1] * first ^ word[1:]) * second)
    parts.append((shape[:-1] * second ^ shape[1:]) * first)
    # A word that is the same as one just before it, whichever word that is.
    for back in range(1, REPEATS + 1):
        same = np.count_nonzero(word[back:] == word[:-back])
        parts.append(np.repeat(_mixed_number(back), same))
    hashed = np.concatenate(parts) >> np.uint64(64 - BITS)
    return np.maximum(hashed, np.uint64(1)).astype(np.int64)


class Leader:
    """Follow-the-regularised-leader (proximal) for logistic loss."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        small = np.abs(z) <= L1
        return np.where(small, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def _learn(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The weights of each part, from rows in the order of parts."""
    part, seen = None, []
    for batch in rows:
        for now, text, label in zip(batch["part"], batch["text"], batch["label"], strict=True):
            if now != part and seen:
                yield _learnt(seen)
                seen = []
            part, found = now, features(text)
            at, counts = np.unique(found, return_counts=True)
            x = np.concatenate(([1.0], counts / np.sqrt(max(1, len(found)))))
            seen.append((np.concatenate(([0], at)).astype(np.int32), x.astype(np.float32), int(label)))
    if seen:
        yield _learnt(seen)


def _learnt(seen: list[tuple[np.ndarray, np.ndarray, int]]) -> pd.DataFrame:
    leader = Leader()
    for k in range(PASSES):
        for i in np.random.default_rng(k).permutation(len(seen)):
            leader.learn(*seen[i])
    return pd.DataFrame({"n": [len(seen)], "w": [leader.weights().astype(np.float32).tobytes()]})


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``. A null id counts as an empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights learnt from the rows of ``docs`` that have a label (``labels``: id, label 0 or 1).

    With more than ``TRAIN_ROWS`` labels each is used with the same probability, by its id alone, so
    that about as many are. Null labels and labels without a document are ignored; a label counts for each
    row of its id, and a null id has none. Null texts are empty, whole texts are learnt from. Without labels or
    rows all weights are 0 and every score is 0.5. Rows are dealt to PARTS by their id and put in order there,
    so the weights don't depend on the number of tasks or the order of rows.
    """
    labels = labels.select(F.col(id_col).alias("_id"), F.col("label").cast("int").alias("label"))
    labels = labels.filter("label in (0, 1)")
    share = min(1.0, TRAIN_ROWS / max(1, labels.count()))
    used = labels.filter(salted_uniform(5, F.col("_id")) <= share)
    # The sample is bounded by TRAIN_ROWS, so it is sent to the documents.
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))
    part = F.pmod(F.xxhash64("_id"), F.lit(PARTS)).alias("part")
    rows = rows.join(F.broadcast(used), "_id").select("text", "label", part)
    # More tasks than parts, so that few parts share one; the parts are the same with any number of tasks.
    rows = rows.repartition(4 * PARTS, "part").sortWithinPartitions("part", "text", "label")
    learnt = rows.mapInPandas(_learn, "n bigint, w binary").collect()  # a row for each of PARTS
    total = sum(r["n"] for r in learnt)
    weights = np.zeros(1 << BITS)
    for r in learnt:
        weights += r["n"] / total * np.frombuffer(r["w"], np.float32)
    return weights.astype(np.float32)


def score(text: Column, weights: np.ndarray) -> Column:
    """Between 0 and 1, higher where label 1 is likelier. An empty text's follows from the bias."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        margins = np.empty(len(texts))
        for i, t in enumerate(texts_of(texts)):
            found = features(t)
            margins[i] = weights[0] + weights[found].sum(dtype=np.float64) / np.sqrt(max(1, len(found)))
        return pa.array(1 / (1 + np.exp(-np.clip(margins, -35, 35))))

    return run(text)


def classify(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` and ``predicted`` (1 from 0.5).

    A null text is scored as an empty one, whole texts of any length are, and rows that repeat a text alike.
    An empty table gives an empty result. Columns named like the two are replaced; others may have any names.
    """
    docs = docs.drop(*(c for c in ("score", "predicted") if c != text_col))
    scored = docs.withColumn("score", score(text_or_empty(text_col), weights))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
