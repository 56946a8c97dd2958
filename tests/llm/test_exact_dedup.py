from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cases import ROWS, awkward, empty
from gatetally.llm import exact_dedup as module
from gatetally.llm.exact_dedup import blocks_for, exact_dedup, possibly_repeated, repeated_filter


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def digest(text):
    return hashlib.sha256(lowered(text).encode()).hexdigest()


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[digest(text)].append(doc_id)
    return {d: (max(ids), len(ids)) for d, ids in groups.items()}


def test_awkward_rows(spark):
    df = exact_dedup(awkward(spark))
    assert set(awkward(spark).columns) <= set(df.columns)
    got, groups = df.collect(), expected(ROWS)
    assert len(got) == len(ROWS)
    for row in got:
        assert (row.keep_id, row.group_size) == groups[row.text_sha256]
        assert row.text_sha256 == digest(row.text)
        assert row.word == "word" and row.hash == "hash"
        if not row.kept:
            assert row.group_size > 1
    # One of each group, also of the rows that repeat text and id.
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_null_ids_are_smaller_than_others(spark):
    rows = [(None, "x"), (3, "X"), (None, "y"), (None, "y"), (None, "z")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [(r.doc_id, r.text) for r in got if r.kept]
    assert sorted(kept, key=str) == sorted([(3, "X"), (None, "y"), (None, "z")], key=str)
    assert {(r.text, r.keep_id, r.group_size) for r in got if r.text in "xyz"} == {
        ("x", 3, 2), ("y", None, 2), ("z", None, 1),
    }


def test_empty_table(spark):
    assert exact_dedup(empty(spark)).collect() == []


@pytest.mark.parametrize("blocks", [1, 2**13])
def test_many_rows_with_a_large_group(spark, monkeypatch, blocks):
    """A third of the rows under one text; also with a filter of the least size."""
    monkeypatch.setattr(module, "BLOCKS", blocks)
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "Same").otherwise(F.concat(F.lit("t"), (F.col("id") % 1500).cast("string"))).alias("text"),
    )
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups, got = expected(rows), exact_dedup(docs).collect()
    assert len(got) == 3000
    for row in got:
        assert (row.keep_id, row.group_size) == groups[row.text_sha256]
        assert row.kept == (row.doc_id == row.keep_id)


@pytest.mark.parametrize("blocks", [1, 8])
def test_filter_misses_no_repeat(spark, blocks):
    hashes = spark.range(4000).select((F.xxhash64(F.col("id") % 3000)).alias("hash"))
    found = repeated_filter(hashes, blocks)
    tested = hashes.withColumn("block", module._block(F.col("hash"), blocks)).join(found, "block", "left")
    tested = tested.withColumn("maybe", possibly_repeated(F.col("hash"), F.col("bits")))
    counts = tested.groupBy("hash").agg(F.count("*").alias("n"), F.min("maybe").alias("maybe"))
    assert counts.filter("n > 1 and not maybe").count() == 0
    assert counts.filter("n = 1 and maybe").count() < 40


def test_filter_is_bounded():
    assert [blocks_for(n) for n in (0, 1, 10_000, 10**12)] == [1, 1, 16, 2**13]


def test_rows_that_pass_are_not_shuffled(spark):
    """Two reads of the table in the result; what is shuffled there are rows set apart, and their groups."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("documents.parquet" in line for line in scans) == 1  # the other rows are in a table by now
    straight = plan[: plan.index("dedup_possible")]
    assert "documents.parquet" in straight and "Exchange hashpartitioning" not in straight
    assert "Window" not in plan and "Python" not in plan


def test_of_repeated_rows_the_content_decides(spark):
    rows = [(7, "Same", "b"), (7, "same", "a"), (7, "SAME", "c"), (None, "x", "1"), (None, "X", "2")]
    kept = []
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string, other string")
        kept.append(sorted((r.text, r.other) for r in exact_dedup(frame).collect() if r.kept))
    assert kept[0] == kept[1] and len(kept[0]) == 2


def test_text_ids_and_maps(spark):
    frame = spark.createDataFrame([("a", "x", {"k": 1}), ("b", "X", {"k": 2}), ("b", "y", {})], "doc_id string, text string, m map<string, int>")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_dedup(frame).collect()) == [
        ("a", "b", False), ("b", "b", True), ("b", "b", True),
    ]
