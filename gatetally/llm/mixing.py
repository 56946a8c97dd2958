"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of the words by its weight, at most ``max_copies`` times what it has. Inside
a source a document's expected copies follow its inclusion weight under the same limit. Whole copies
are certain. For the fraction that is left, documents are ranked by the odds of a random number over
the odds of their inclusion, and taken in that order up to the words that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatetally.llm.common import null_safe, salted_uniform, text_or_empty, word_count, written

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Documents per bucket of the ranking. A source's order is found bucket by bucket.
RANK_BUCKET = 2000


#: Up to so many pairs of id and size that rows share are broadcast; beyond, they are joined.
BROADCAST_SHARED = 500_000
#: Up to so many sources their table (under 100 bytes a row) is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 100_000


def _with_source(items: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """``items`` with the columns of ``sources``; a null source matches itself."""
    table = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    other = table.withColumnRenamed("source", "_source")
    return items.join(other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _level(fixed: Column, open_share: Column, total: Column) -> Column:
    """The level at which the open shares take what the fixed items leave; infinite if none is open."""
    return F.when(open_share > 0, (total - fixed) / open_share).otherwise(F.lit(float("inf")))


def source_targets(sources: DataFrame, weights=WEIGHTS, max_copies: float = MAX_COPIES) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: shares of all words by weight, under the limit.

    Targets that would be above ``max_copies`` times their source's size stop there, and the excess
    is shared again by weight until none is above. The table has a row per source; it is put in order
    in one task.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(place, F.lit(len(weights))) + 1)
    cap = F.col("source_size") * float(max_copies)
    sources = written(sources.withColumn("weight", weight).withColumn("cap", cap), "mix_sources")
    level, n_full = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") >= F.col("cap")
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(full).alias("n_full"),
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
        ).first()
        if row["n_full"] == n_full:
            break
        n_full = row["n_full"]
        level = (row["total"] - row["fixed"]) / row["open"] if row["open"] > 0 else float("inf")
    target = F.when(F.lit(level) * F.col("weight") >= F.col("cap"), F.col("cap"))
    return sources.withColumn("target", target.otherwise(F.lit(level) * F.col("weight")))


def _copies(max_copies: float) -> Column:
    return F.least(F.lit(float(max_copies)), F.col("level") * F.col("inclusion"))


def _copy_levels(items: DataFrame, sources: DataFrame, n_sources: int, max_copies: float) -> DataFrame:
    """``sources`` with ``level``: a document's expected copies are level * inclusion, at most the limit."""
    levels, n_full = sources.withColumn("level", F.lit(0.0)), -1
    while True:
        held = _with_source(items, levels.select("source", "level", "target"), n_sources)
        full = F.col("level") * F.col("inclusion") >= max_copies
        sums = held.groupBy("source").agg(
            F.sum(F.when(full, F.col("size") * float(max_copies)).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("inclusion"))).alias("open"),
            F.count_if(full).alias("n_full"),
            F.max("target").alias("target"),
        )
        sums = written(sums, "mix_levels")
        now = sums.agg(F.coalesce(F.sum("n_full"), F.lit(0))).first()[0]
        if now == n_full:
            return levels
        n_full = now
        level = _level(F.col("fixed"), F.col("open"), F.col("target"))
        levels = _with_source(
            sources, sums.select("source", level.alias("level")), n_sources
        )


def _rank() -> Column:
    """Pareto sampling ranks by q, the odds of u over the odds of the part. This is q / (1 + q): it has the
    same order, lies between 0 and 1, and divides by 0 nowhere."""
    u, part = F.col("u"), F.col("part")
    return u * (1 - part) / (u * (1 - part) + part * (1 - u))


def _split_copies(items: DataFrame, max_copies: float) -> DataFrame:
    """``items`` with their certain ``whole`` copies and the ``part`` that is drawn."""
    copies = _copies(max_copies)
    return items.select("*", F.floor(copies).alias("whole"), (copies - F.floor(copies)).alias("part"))


def _limits(items: DataFrame, sources: DataFrame, n_sources: int, max_copies: float) -> DataFrame:
    """source, limit, last_in: documents of a source are drawn if they rank before ``limit`` or, where
    there is none, up to ``last_in``.

    A source isn't put in order as a whole. Its ranks are cut into buckets; sums of their words tell
    in which one the words that are left end, and only that one is ordered.
    """
    items = _split_copies(_with_source(items.filter("size > 0"), sources, n_sources), max_copies)
    sure = items.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    buckets = F.ceil(F.col("n") / RANK_BUCKET)
    drawn = items.filter("part > 0").withColumn("rank", _rank())
    bucket = F.least(F.floor(F.col("rank") * buckets), buckets - 1)
    drawn = drawn.select("source", "size", "rank", bucket.alias("bucket"))
    sums = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("end", F.sum("words").over(up_to))
    rest = _with_source(sources, sure, n_sources)
    rest = rest.select("source", (F.col("target") - F.col("sure")).alias("rest"))
    last = _with_source(sums, rest, n_sources).filter("end - words <= rest and rest <= end")
    last = last.groupBy("source").agg(
        F.min(F.struct("bucket", (F.col("end") - F.col("words")).alias("before"), "rest")).alias("last")
    )
    last = last.select("source", F.col("last.bucket").alias("last_bucket"), "last.before", "last.rest")

    edge = _with_source(drawn, last, n_sources).filter("bucket = last_bucket")
    in_order = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("end", F.col("before") + F.sum("size").over(in_order))
    # A document is in if at least half of its words are among those left.
    within = F.col("end") - F.col("size") / 2 <= F.col("rest")
    return edge.groupBy("source").agg(
        F.min(F.when(~within, F.col("rank"))).alias("limit"),
        F.max(F.when(within, F.col("rank"))).alias("last_in"),
    )


def _numbered(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The ``rows`` whose id and size other rows have, too, with a random number ``u`` of their own.

    Their texts' digests tell them apart, and rows that are alike in all three are numbered: inside each part
    of the written table, behind as many as the parts before have.
    """
    key = ["id", "size", "digest"]
    repeated = null_safe(rows, shared, ["id", "size"]).withColumn("nr", F.monotonically_increasing_id())
    repeated = written(repeated.withColumn("part", F.spark_partition_id()), "mix_repeated")
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = repeated.groupBy(*key, "part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(*key, "part").orderBy("nr"))
    numbered = null_safe(repeated.withColumn("within", within), parts, [*key, "part"])
    place = F.col("before") + F.col("within")
    u = salted_uniform(F.col("seed"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key), place)
    return written(numbered.withColumn("u", u).drop("nr", "part", "before", "within"), "mix_repeated")


def mix(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    weights=WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = 0,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``size`` counts the words of the text, ``taken`` is copies times size. Inside a source longer
    documents have better odds: their inclusion grows with the logarithm of their size. The words
    taken from a source differ from its target by half a document at most.

    Each row is drawn for itself, by a random number of its id and size. Where rows share both, as without ids,
    the text's digest and a number among equal rows go into it as well. So reruns agree on what is taken.

    A null source is a source of its own, the last. A null or empty text has size 0 and 0 copies. Ids may be
    null, repeated and of any type. An empty table gives an empty result. Columns of ``docs`` named like the
    five are replaced.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in added or c in (source_col, text_col, id_col)]
    text = text_or_empty(text_col)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        F.col(id_col).alias("id"),
    )
    rows = rows.withColumn("inclusion", F.log1p("size")).withColumn("seed", F.lit(str(seed)))
    by_id = salted_uniform(seed, F.col("id"), F.col("size"))
    items = written(rows.select("id", "source", "size", "inclusion", by_id.alias("u")), "mix_items")
    shared = items.filter("size > 0").groupBy("id", "size").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(shared.select("id", "size"), "mix_shared")
    n_shared = shared.count()
    rows = rows.withColumn("u", by_id)
    if n_shared:
        few = F.broadcast(shared) if n_shared <= BROADCAST_SHARED else shared
        digest = F.sha2(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")), 256)
        repeated = _numbered(rows.drop("u").withColumn("digest", digest), few).select(rows.columns)
        rows = null_safe(rows, few, ["id", "size"], "left_anti").unionByName(repeated)
        items = null_safe(items, few, ["id", "size"], "left_anti").unionByName(repeated.select(items.columns))
        items = written(items, "mix_items")
    items = items.drop("id")
    sources = items.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = source_targets(sources, weights, max_copies)
    n_sources = sources.count()
    levels = _copy_levels(items, sources, n_sources, max_copies)
    sources = written(levels.select("source", "source_size", "target", "n", "level"), "mix_targets")

    limits = written(_limits(items, sources, n_sources, max_copies), "mix_limits")
    limits = limits.withColumnRenamed("source", "_s")
    params = sources.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    decided = _split_copies(_with_source(rows, params, n_sources), max_copies)
    before = F.when(F.col("limit").isNotNull(), _rank() < F.col("limit"))
    before = before.otherwise(F.coalesce(_rank() <= F.col("last_in"), F.lit(False)))
    drawn = F.when(F.col("part") > 0, before).otherwise(False)
    copies = F.when(F.col("size") > 0, F.col("whole") + drawn.cast("bigint")).otherwise(0).cast("bigint")
    return decided.select(
        "row.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
