"""Collocations and substring dedup against plain accounts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import awkward, empty
from gatetally.llm import collocations as mining
from gatetally.llm import substring_dedup as substrings
from gatetally.llm.collocations import collocations
from gatetally.llm.hashfilter import HashFilter, Sizes, bucketed, filter_of
from gatetally.llm.substring_dedup import lengths_to, substring_dedup
from gatetally.llm.wordhash import joined_bytes, run_hashes, word_hashes, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_collocations(rows, support, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    kept = []
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= support}
    covering = Counter()
    for (lang, words), a in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                key = lang, words[i : i + m]
                covering[key] = max(covering[key], a)
    for (lang, words), a in candidates.items():
        if 100 * covering[lang, words] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        kept.append((lang, " ".join(words), a, left, right, n[lang], score))
    kept.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, out = Counter(), []
    for lang, *rest in kept:
        ranks[lang] += 1
        if ranks[lang] <= top:
            out.append((lang, ranks[lang], *rest))
    return out


def texts(seed, rows=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "and", "New", "York", "new", "ünïcode", "日本", "it's", "\x00x", "a-b", "of the", "new\tyork"]
    between = [" ", "  ", " ", "\t", ", ", ". ", "\n", "\x0b", "; "]
    made = []
    for _ in range(rows):
        text = "".join(rng.choice(words) + rng.choice(between) for _ in range(rng.randint(0, 60)))
        made.append((rng.choice(["en", "de", None, "en"]), rng.choice([text, text, text, None])))
    return made


@pytest.mark.parametrize("support", [1, 8, 30])
def test_collocations_against_plain_counts(spark, support):
    rows = texts(support)
    frame = spark.createDataFrame(rows, "lang string, text string")
    found = sorted(map(tuple, collocations(frame, support=support).collect()))
    assert found == sorted(plain_collocations(rows, support)) and found


def everything(spark):
    """A filter that lets everything through: that costs work and changes nothing."""
    return HashFilter(spark.sparkContext.broadcast(np.full(1 << 17, 255, np.uint8)), 20)


def test_collocations_with_full_filters(spark, monkeypatch):
    monkeypatch.setattr(mining, "filter_of", lambda *_, **__: everything(spark))
    rows = texts(5)
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations(frame, support=10).collect())) == sorted(plain_collocations(rows, 10))


def test_filter_has_what_is_frequent(spark):
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**64, 3000, np.uint64)
    for n_bytes in (0, 1 << 30, 1 << 50):
        sizes = Sizes(n_bytes, 16)
        rows = []
        for need, own in ((1, hashes[:1000]), (2, hashes[1000:2000]), (3, hashes[2000:])):
            for part in (own, own[:500], own[:100]):
                buckets, rests = bucketed(part, 9, sizes)
                rows += zip(buckets.to_pylist(), [need % 2] * len(buckets), [need] * len(buckets), rests.to_pylist(), strict=True)
        made = filter_of(spark.createDataFrame(rows, "bucket long, shard long, need long, hashes binary"), sizes)
        frequent = np.concatenate((hashes[:1000], hashes[1000:1500], hashes[2000:2100]))
        assert made.has(frequent).all()
        assert made.has(hashes[1500:2000]).mean() < 0.01 and made.has(hashes[2100:]).mean() < 0.01


def test_top_and_long_text(spark):
    rows = [("en", "alpha beta " * 30_000), ("en", None), (None, "")]
    frame = spark.createDataFrame(rows, "lang string, text string")
    found = sorted(map(tuple, collocations(frame, top=3).collect()))
    assert found == sorted(plain_collocations(rows, 30, top=3))


def plain_substrings(texts, window):
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for words in split:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def passages(seed, rows=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["日本", "é"]
    shared = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 34, 35, 36, 80]))] for _ in range(6)]
    made = []
    for _ in range(rows):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice([*shared, [rng.choice(vocabulary) for _ in range(rng.randint(0, 50))]])
        made.append(rng.choice([" ", "\n", " \t "]).join(words))
    return [*made, *made[:5], None, "", " \n ", "x " * 90, "x " * 34]


@pytest.mark.parametrize("window", [1, 2, 9, 10, 35, 70])
def test_substrings_against_all_windows(spark, window):
    rows = passages(window)
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r for r in substring_dedup(frame, window=window).collect()}
    for i, (n_words, n_removed, kept) in enumerate(plain_substrings(rows, window)):
        assert (found[i].n_words, found[i].kept_text) == (n_words, kept)
        assert sum(s.end - s.start for s in found[i].removed) == n_removed
    assert len(found) == len(rows)


def test_substrings_with_full_filters(spark, monkeypatch):
    monkeypatch.setattr(substrings, "filter_of", lambda *_: everything(spark))
    rows = passages(3)
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.kept_text for r in substring_dedup(frame).collect()}
    assert found == {i: kept for i, (_, _, kept) in enumerate(plain_substrings(rows, 35))}


def test_awkward_documents(spark):
    docs = awkward(spark)
    cut = substring_dedup(docs.withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id").cast("string"))))
    rows = cut.collect()
    plain = plain_substrings([r.text for r in docs.collect()], 35)
    assert sorted((r.n_words, r.kept_text) for r in rows) == sorted((n, kept) for n, _, kept in plain)
    assert cut.schema["doc_id"].dataType.simpleString() == "string"
    assert substring_dedup(empty(spark)).collect() == []
    mined = collocations(docs.withColumn("lang", F.col("source")))
    assert sorted(map(tuple, mined.collect())) == sorted(plain_collocations([(r.source, r.text) for r in docs.collect()], 30))
    assert collocations(empty(spark).withColumn("lang", F.lit("x"))).collect() == []


def test_lengths():
    assert lengths_to(35) == [9, 18, 35] and lengths_to(9) == [9] and lengths_to(70) == [9, 18, 35, 70]


def test_equal_runs_have_equal_hashes():
    data, _ = joined_bytes([b"aa b ccc aa b ccc", b"aa b ccc"])
    starts, ends = word_spans(data)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"aa", b"b", b"ccc"] * 3
    words = word_hashes(data, starts, ends)
    assert len(set(words.tolist())) == 3
    runs = run_hashes(words, starts[:7] * 0 + range(7), 3)
    assert len(set(runs.tolist())) == 3 and runs[0] == runs[3] == runs[6]
