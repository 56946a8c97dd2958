"""Rows whose ids are null, shared, repeated or text: none is lost, and each is treated as a row."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cases import awkward, empty
from gatetally.llm.mixing import mix
from gatetally.llm.ngram_join import ngram_join

WORDS = [f"w{i}" for i in range(500)]


def text(seed, n=60, changed=()):
    rng = random.Random(seed)
    words = [rng.choice(WORDS) for _ in range(n)]
    for i in changed:
        words[i] = f"other{i}"
    return " ".join(words)


@pytest.mark.parametrize("ids", ["null", "equal", "unique", "text"])
def test_mix_meets_its_targets_whatever_the_ids(spark, ids):
    """Two sources of 1000 documents of 7 words, as many of them alike in all but the id."""
    doc_id = {"null": "cast(null as bigint)", "equal": "5", "unique": "id", "text": "concat('d', id % 3)"}[ids]
    docs = spark.range(2000, numPartitions=3).selectExpr(
        f"{doc_id} as doc_id", "if(id % 2 = 0, 'a', 'b') as source", "concat('t', id % 40, ' b c d e f g') as text"
    )
    taken = mix(docs).cache()
    assert taken.count() == 2000
    sums = {r.source: (r.target, r.n) for r in taken.groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("n")).collect()}
    assert {s: t for s, (t, _) in sums.items()} == {"a": 10000.0, "b": 4000.0}
    assert all(abs(t - n) <= 7 for t, n in sums.values())
    # Rows that are alike aren't all taken or all left.
    assert taken.filter("source = 'b'").select("copies").distinct().count() == 2
    again = mix(docs.repartition(5)).groupBy("source").agg(F.sum("taken").alias("n"))
    assert {r.source: r.n for r in again.collect()} == {s: n for s, (_, n) in sums.items()}


def near(spark, rows, kind="long"):
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string, source string")
    left = corpus_pipeline.near_duplicates(spark, frame, "")
    assert left.columns == frame.columns
    return [(r.doc_id, r.text) for r in left.collect()]


def test_near_copies_go_whatever_their_ids(spark):
    a, near_a, b, c = text(1), text(1, changed=[30]), text(2), text(3)
    # The near copy's id is shared with another text, which stays.
    assert sorted(near(spark, [(1, a, "s"), (2, near_a, "s"), (2, b, "s"), (3, c, "s")])) == sorted([(1, a), (2, b), (3, c)])
    # Both without ids.
    left = near(spark, [(None, a, "s"), (None, near_a, "s"), (None, b, "s")])
    assert len(left) == 2 and (None, b) in left
    # Equal rows, and a near copy of theirs with a larger id.
    assert near(spark, [(5, a, "x"), (5, a, "y"), (9, near_a, "z")]) == [(5, a)]
    # Copies without an id give way to one that has one.
    assert near(spark, [(None, a, "s"), (7, a.upper(), "s"), (None, near_a, "s")]) == [(7, a.upper())]
    assert near(spark, [("x", a, "s"), ("y", near_a, "s"), (None, None, "s")], "string") == [("x", a), (None, None)]


def test_join_of_shared_ids(spark):
    a, near_a, b = text(1), text(1, changed=[30]), text(2)
    rows = [(1, a), (1, near_a), (1, b), (None, a), (None, None), (2, near_a), (2, near_a)]
    found = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert sorted((r.n_copies, r.n_links) for r in found) == sorted([(2, 1), (3, 1), (1, 0), (2, 1), (1, 0), (3, 1), (3, 1)])
    assert Counter(r.class_id for r in found) == {1: 6, None: 1}
    assert sum(r.stays for r in found) == 3


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_awkward_rows(spark, name):
    """Nulls, repeats, a long text, and columns named like those of the operators."""
    docs = awkward(spark).withColumn("lang", F.lit("en")).withColumns(
        {c: F.lit("mine") for c in ("copies", "size", "kept", "keep_id", "target", "taken", "text_hash", "stays", "part")}
    )
    sf_dir = "/root/testdata/sf0.001"
    left = STAGES[name](spark, docs, sf_dir)
    rows = left.collect()
    if name.startswith("byte-level"):
        assert len(rows) == docs.count()
        return
    assert left.columns == docs.columns
    assert all(r.copies == r.kept == r.stays == "mine" for r in rows)
    texts = Counter(r.text for r in rows)
    if name.startswith("exact"):
        assert texts["The quick brown fox jumps over the lazy dog tonight, it's said."] == 1
    if name.startswith("n-gram"):
        assert sum(n for t, n in texts.items() if t and t.lower().startswith("the quick")) == 1 and len(rows) == 8
    assert STAGES[name](spark, empty(spark).withColumn("lang", F.lit("")), sf_dir).collect() == []


def test_whole_pipeline(spark, folder):
    """``run`` over all documents: each stage by itself on what the one before kept, and nothing left behind."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = docs
    for stage in STAGES.values():
        expected = stage(spark, expected, sf_dir).cache()
    found = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect())) and found.count() > 100
    assert found.select("doc_id").distinct().join(docs, "doc_id").count() > 100
