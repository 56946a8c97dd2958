from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cases import ROWS, WORD, awkward, empty
from gatetally.llm.mixing import mix

SF_DIR = "/root/testdata/sf0.01"


def water_fill(sizes: dict, weights=(5, 2, 1), limit=3) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        rest, shares = total - sum(full.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / shares >= limit * sizes[s]]
        if not over:
            return full | {s: rest * weight[s] / shares for s in open_}
        full |= {s: limit * sizes[s] for s in over}


def sizes_of(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    return sizes


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_targets_and_words_taken(spark, which):
    if which == "awkward":
        docs, rows = awkward(spark), ROWS
    else:
        docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
        # A hot source, a null one, and a small one.
        by = F.col("doc_id") % 10
        docs = docs.withColumn("source", F.when(by < 4, "src0").when(by == 4, None).when(F.col("doc_id") == 6, "tiny").otherwise(F.col("source")))
        rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got, sizes = mix(docs).collect(), sizes_of(rows)
    assert len(got) == len(rows)
    targets, taken, longest = water_fill(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len(WORD.findall(r.text or ""))
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    for source in sizes:
        # The repeated row is drawn with its like, so there the last step can be twice as long.
        assert abs(taken[source] - targets[source]) <= longest[source] + 1


def test_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source", "text")
    one, two = mix(docs), mix(docs.repartition(7))
    assert sorted(map(tuple, one.select("doc_id", "taken").collect())) == sorted(map(tuple, two.select("doc_id", "taken").collect()))


def test_inclusion_follows_the_weight(spark):
    """Documents of equal size 1 and 30 under one source: the longer ones have better odds."""
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, "w").otherwise(F.repeat(F.lit("w "), 30)).alias("text"),
        F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"),
    )
    rates = mix(docs).filter("source = 'b'").groupBy("size").agg(F.avg("copies").alias("rate")).collect()
    rate = {r["size"]: r.rate for r in rates}
    assert rate[30] > 2 * rate[1] > 0


def test_empty_and_wordless(spark):
    assert mix(empty(spark)).collect() == []
    got = mix(awkward(spark, ROWS[:3])).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0)] * 3
