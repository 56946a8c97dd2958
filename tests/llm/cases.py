"""Awkward documents that every operator has to take, and plain accounts to compare with."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = "ab cd\nEf 12 " * 20_000

#: doc_id, text, source. Ids are unique but for the repeated row at the end.
ROWS = [
    (1, None, "b"),
    (2, "", "a"),
    (3, " \t\n ", None),
    (4, "one", "a"),
    (5, "The quick brown fox jumps over the lazy dog tonight, it's said.", "a"),
    (6, "the QUICK brown fox jumps over the lazy dog tonight, it's said.", None),
    (7, LONG, "b"),
    (8, "ünïcode 日本語 \U0001f600 <|im_end|> \x00 x", "é"),
    (9, "mail me@example.org or +1 (555) 010-99887 from 10.0.0.1", "a"),
    (10, "The quick brown fox jumps over the lazy dog tonight, it's said.", "c"),
    (10, "The quick brown fox jumps over the lazy dog tonight, it's said.", "c"),
]

#: Columns that nothing asks for, named like those the operators use inside.
EXTRA = ("word", "hash", "bits", "key", "n", "row", "u", "level", "digest", "_row", "_id", "spans")


def awkward(spark: SparkSession, rows=ROWS) -> DataFrame:
    names = ", ".join(f"{c} string" for c in EXTRA)
    filled = [(*row, *EXTRA) for row in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, source string, {names}")


def empty(spark: SparkSession) -> DataFrame:
    return awkward(spark, [])
