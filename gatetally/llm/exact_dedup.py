"""Exact duplicates by two-pass Bloom filtering.

Pass one enters each text's 64-bit hash and makes a blocked Bloom filter of those entered more than once. Its
size is bounded, so it always goes to the rows and they never to it. Pass two tests every row. A row that has a
bit outside the filter has no equal and goes straight through; only the others, which possibly repeat, are
set apart, shuffled by their digest and grouped exactly. False positives cost a shuffled row and never change
a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from gatetally.llm.common import text_or_empty, written

#: Bits of the filter per row, and of a block of it; all bits of a hash lie in one block.
BITS_PER_ROW, BLOCK_BITS = 32, 15
BITS_PER_HASH = 3
#: At most so many blocks of 4 KB: 32 MB are broadcast, however many rows there are.
BLOCKS = 1 << 13
#: A group is large if it holds more than this share of all rows, so there are at most 1000 of them.
LARGE_GROUP = 1 / 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Texts are equal when they agree after lower-casing A-Z only."""
    return F.translate(text, _UPPER, _LOWER)


def _places(hashed: Column) -> list[Column]:
    """The bits of a hash in its block."""
    low = F.lit((1 << BLOCK_BITS) - 1)
    return [F.shiftrightunsigned(hashed, BLOCK_BITS * i).bitwiseAND(low) for i in range(BITS_PER_HASH)]


def _block(hashed: Column, blocks: int) -> Column:
    """A hash's block, from bits that its places don't take."""
    return F.shiftrightunsigned(hashed, BLOCK_BITS * BITS_PER_HASH).bitwiseAND(F.lit(blocks - 1))


def blocks_for(rows: int) -> int:
    return min(BLOCKS, 1 << max(0, (rows * BITS_PER_ROW >> BLOCK_BITS).bit_length()))


def repeated_filter(hashes: DataFrame, blocks: int) -> DataFrame:
    """block, bits: the filter of the hashes (column ``hash``) that are there more than once.

    What is shuffled is a hash and a count per text of a partition. Spark's bitmaps are or-ed before they
    are shuffled and behind it.
    """
    repeated = hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    places = F.explode(F.array(*_places(F.col("hash")))).alias("place")
    entered = repeated.select(_block(F.col("hash"), blocks).alias("block"), places)
    return entered.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))


def possibly_repeated(hashed: Column, bits: Column) -> Column:
    """Whether all bits of a hash are in its block; not so where there is no block."""
    is_in = F.lit(True)
    for place in _places(hashed):
        byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10)
        of_byte = F.call_function("shiftright", byte.cast("int"), place.bitwiseAND(F.lit(7)).cast("int"))
        is_in = is_in & (of_byte.bitwiseAND(F.lit(1)) == 1)
    return F.coalesce(is_in, F.lit(False))


def _content(docs: DataFrame) -> Column:
    """A hash of a row's columns, by which rows of one id and text are told apart."""
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType | VariantType)]
    return F.xxhash64(*(F.col("row")[c] for c in plain)) if plain else F.lit(0).cast("bigint")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id is kept. A null text equals an empty one. Null ids are
    smaller than all others. Of rows that repeat both text and id one is kept, by a hash of its columns (maps
    aside), so reruns agree on its content. Texts of any length are hashed whole. An empty table gives an
    empty result. Columns of ``docs`` named like the four are replaced; others may have any names.

    ``docs`` is read three times: for the hashes, for the rows that possibly repeat, and for those that go
    straight through; no operator of Spark's has two outputs. Each text's SHA-256 is worked out once.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.drop(*(c for c in added if c not in (id_col, text_col)))
    # Other columns travel in one struct, so that none of their names can clash.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    whole = docs.select(row, F.col(id_col).alias("id"), normalised(text_or_empty(text_col)).alias("text"))
    hashed = whole.withColumn("hash", F.xxhash64("text"))
    rows = docs.count()
    blocks = blocks_for(rows)
    found = F.broadcast(written(repeated_filter(hashed, blocks), "dedup_filter"))
    tested = hashed.withColumn("block", _block(F.col("hash"), blocks)).join(found, "block", "left")
    repeats = possibly_repeated(F.col("hash"), F.col("bits"))
    digest = F.sha2("text", 256).alias("digest")

    straight = tested.filter(~repeats).select(
        "row", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), digest
    )
    possible = tested.filter(repeats).select("row", "id", digest, F.monotonically_increasing_id().alias("nr"))
    possible = written(possible, "dedup_possible")
    order = F.struct(F.col("id").isNotNull().alias("has"), "id", _content(docs).alias("content"), "nr")
    groups = possible.groupBy("digest").agg(F.max(order).alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("digest", F.col("best.id").alias("keep_id"), F.col("best.nr").alias("best_nr"), "group_size")
    groups = written(groups, "dedup_groups")
    # Rows of large groups meet their few group rows by broadcast, so that no task gets such a group.
    large = F.col("group_size") > F.lit(max(1.0, rows * LARGE_GROUP))
    in_large = F.broadcast(groups.filter(large))
    columns = ("row", "keep_id", "group_size", (F.col("nr") == F.col("best_nr")).alias("kept"), "digest")
    of_large = possible.join(in_large, "digest").select(*columns)
    others = possible.join(in_large.select("digest"), "digest", "left_anti")
    others = others.join(groups.filter(~large), "digest").select(*columns)
    result = straight.unionAll(of_large).unionAll(others)
    return result.select("row.*", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
