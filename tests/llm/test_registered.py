"""The registered queries against their SQL, and the pipeline's stages against plain accounts."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from gatetally.llm.oracles import ORACLES
from gatetally.llm.queries import QUERIES
from test_exact_dedup import digest
from test_mixing import sizes_of, water_fill
from test_near import brute_join

SF_DIR = "/root/testdata/sf0.01"


def test_a_query_per_operator():
    assert [sum(name.startswith(f"op{n}_") for name in driver.queries()) for n in range(1, 14)] == [1] * 13
    assert QUERIES.keys() <= driver.queries().keys() and "pipeline" in driver.queries()


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    result = connection.sql(ORACLES[name])
    columns = sorted(result.columns)
    rows = QUERIES[name](spark, SF_DIR).select(*columns).collect()
    assert sorted(map(tuple, rows)) == sorted(result.select(*(f'"{c}"' for c in columns)).fetchall())


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("doc_id < 600").cache()
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")

    good = stages["quality classifier"](spark, docs, SF_DIR).cache()
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    marked = [(r.doc_id in kept, r.quality) for r in labels.filter("doc_id < 600").collect()]
    assert sum(k == bool(q) for k, q in marked) > 0.97 * len(marked)

    single = stages["exact dedup"](spark, good, SF_DIR).cache()
    last = {}
    for r in good.collect():
        last[digest(r.text)] = max(last.get(digest(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(last.values())
    assert single.columns == docs.columns

    apart = stages["n-gram Jaccard join"](spark, single, SF_DIR).cache()
    classes = brute_join([(r.doc_id, r.text) for r in single.collect()])
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, c in classes.items() if c[0] == i)
    assert apart.columns == docs.columns

    mixed = stages["mixing sources to target weights"](spark, apart, SF_DIR).cache()
    rows = [(r.doc_id, r.text, r.source) for r in apart.collect()]
    times, sizes = Counter(r.doc_id for r in mixed.collect()), sizes_of(rows)
    targets, taken, longest = water_fill(sizes), Counter(), Counter()
    for doc_id, text, source in rows:
        size = sizes_of([(doc_id, text, source)])[source]
        taken[source] += times[doc_id] * size
        longest[source] = max(longest[source], size)
    assert max(times.values()) <= 3
    assert all(abs(taken[s] - targets[s]) <= longest[s] for s in sizes)
    assert mixed.columns == docs.columns

    coded = stages["byte-level BPE encoding and decoding"](spark, mixed, SF_DIR)
    whole = mixed.select("doc_id", F.sha2("text", 256).alias("decoded_sha256")).distinct()
    assert coded.count() == mixed.count()
    assert coded.join(whole, ["doc_id", "decoded_sha256"]).count() == mixed.count()


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).collect() == []
