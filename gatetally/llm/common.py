"""What several operators share: tables, blank-separated words, written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatetally.workspace import delete_folder, shared_folder

# White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def tables_deleted(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes in here are deleted at the end, when nothing may need them any more."""
    token = _tables.set([])
    try:
        yield
    finally:
        for folder in _tables.get():
            delete_folder(spark, folder)
        _tables.reset(token)


def written(df: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and a lost executor loses nothing.

    The table stays, since a result that is worked out later may read it, unless ``tables_deleted`` is used.
    """
    folder = shared_folder(df.sparkSession, purpose)
    if (tables := _tables.get()) is not None:
        tables.append(folder)
    df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by columns of the same names, in which nulls are equal. The columns of ``right`` other than the
    keys follow those of ``left``."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, on, how).drop(*(f"_right_{k}" for k in keys))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def salted_uniform(seed: int | Column, *columns: Column) -> Column:
    """A number above 0 and below 1 that depends on the columns alone, so reruns agree.

    It is made of 52 bits of a digest that other engines have, too.
    """
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws(":", seed, *(c.cast("string") for c in columns)).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return (bits + 0.5) / F.lit(float(2**52))
