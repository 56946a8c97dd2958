"""Document fingerprints by consistent weighted sampling.

Each word of a text is a term, weighted by how often it is there. For each of ``SAMPLES`` samples two
gamma variates and a uniform one, which depend on the term alone, give the term a level and a rank; the
least rank wins. Two texts' samples agree with the probability of their generalised Jaccard similarity:
the sum of the smaller weights over the sum of the larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from gatetally.llm.common import text_or_empty, written

SAMPLES = 48
#: One 64-bit hash gives four uniform numbers of so many bits for the gamma variates, and one of the rest.
_BITS, _REST_BITS = 13, 12
#: Ranks are kept in steps of 2^-25 from -64 on, above 31 bits that tell the term and its level. Weights are 1 or
#: more, so no rank is above 32.
_RANK_STEPS, _RANK_FROM, _ID_BITS = float(1 << 25), 64.0, 31
#: A word's part in a document: in its text only, in the edited one only, or in both as often. An empty
#: word is none, and has a part of its own.
_OWN, _EDITED, _BOTH, _NONE = range(4)


def _field(hashed: Column, place: int, bits: int = _BITS) -> Column:
    return F.shiftrightunsigned(hashed, place * _BITS).bitwiseAND(F.lit((1 << bits) - 1))


def _uniform(field: Column, bits: int = _BITS) -> Column:
    """Above 0 and below 1, from bits of a hash."""
    return (field + F.lit(0.5)) / F.lit(float(1 << bits))


def _exponentials(spark: SparkSession) -> DataFrame:
    """exponentials: for each field of a hash the exponential variate that its uniform number gives. A
    logarithm costs more than all else in a sample, so these are worked out once and not for every term."""
    each = F.transform(F.sequence(F.lit(0), F.lit((1 << _BITS) - 1)), lambda k: F.coalesce(-F.ln(_uniform(k)), F.lit(0.0)))
    return spark.range(1).select(each.alias("exponentials"))


def _sampled(term: Column, log_weight: Column, exponentials: Column, sample: int) -> Column:
    """A term's rank in a sample and what tells it, in one number: the least of a text is its sample."""
    hashed = F.xxhash64(term, F.lit(sample))
    drawn = [F.get(exponentials, _field(hashed, place).cast("int")) for place in range(4)]
    # The sum of two exponential variates is gamma distributed with shape 2.
    r, c = drawn[0] + drawn[1], drawn[2] + drawn[3]
    beta = _uniform(_field(hashed, 4, _REST_BITS), _REST_BITS)
    level = F.floor(log_weight / r + beta)
    rank = F.ln(c) - r * (level - beta) - r
    steps = F.greatest(((rank + F.lit(_RANK_FROM)) * F.lit(_RANK_STEPS)).cast("bigint"), F.lit(0).cast("bigint"))
    # Levels are small numbers; times an odd constant they change the term's own bits.
    told = term.bitwiseXOR(level * F.lit(0x9E3779B1)).bitwiseAND(F.lit((1 << _ID_BITS) - 1))
    return F.shiftleft(steps, _ID_BITS).bitwiseOR(told)


def _words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")


def _signatures(texts: DataFrame) -> DataFrame:
    """key, edited_sha256, own, edited: the samples of both texts, null for a text without words.

    ``texts`` has key, text and edited, and is already dealt out by key, so nothing here is shuffled. Two
    thirds of a text are in the edited one as well: a word that both have equally often is sampled once.
    """
    each = F.array(
        *(F.struct(F.lit(i).alias("what"), _words(F.col(c)).alias("words")) for i, c in enumerate(("text", "edited")))
    )
    by_key = ("key", "edited_sha256")
    words = texts.select("key", F.unhex(F.sha2("edited", 256)).alias("edited_sha256"), F.explode(each).alias("e"))
    words = words.select(*by_key, "e.what", F.explode("e.words").alias("word"))
    counts = words.groupBy(*by_key, "word").agg(F.count_if(F.col("what") == 0).alias("own"), F.count_if(F.col("what") == 1).alias("edited"))
    weighted = lambda part, n: F.struct(F.lit(part).alias("part"), F.ln(n.cast("double")).alias("log_weight"))
    own, edited = F.col("own"), F.col("edited")
    parts = (
        F.when(F.col("word") == "", F.array(weighted(_NONE, F.lit(1))))
        .when(own == edited, F.array(weighted(_BOTH, own)))
        .when(edited == 0, F.array(weighted(_OWN, own)))
        .when(own == 0, F.array(weighted(_EDITED, edited)))
        .otherwise(F.array(weighted(_OWN, own), weighted(_EDITED, edited)))
    )
    terms = counts.select(*by_key, F.xxhash64("word").alias("term"), F.explode(parts).alias("p"))
    terms = terms.select(*by_key, "term", "p.part", "p.log_weight")
    terms = terms.crossJoin(F.broadcast(_exponentials(texts.sparkSession)))
    # Without a condition around it, Spark works out what a sample's expression has several times once.
    columns = [F.col(c) for c in ("term", "log_weight", "exponentials")]
    samples = [F.min(_sampled(*columns, i)).alias(f"s{i}") for i in range(SAMPLES)]
    least = terms.groupBy(*by_key, "part").agg(*samples)
    least = least.select(*by_key, "part", F.array(*(f"s{i}" for i in range(SAMPLES))).alias("s"))
    three = [F.first(F.when(F.col("part") == part, F.col("s")), True).alias(f"p{part}") for part in (_OWN, _EDITED, _BOTH)]
    both = F.col(f"p{_BOTH}")
    return least.groupBy(*by_key).agg(*three).select(
        *by_key, _least_of(F.col(f"p{_OWN}"), both).alias("own"), _least_of(F.col(f"p{_EDITED}"), both).alias("edited")
    )


def _least_of(a: Column, b: Column) -> Column:
    """The samples of two sets of words together; null where a set is empty."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: F.least(x, y)))


def _hex8(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 8, "0"))


def _next_keys(keys: DataFrame) -> DataFrame:
    """key, n_chars, times, next: the next lower key; after the least the greatest.

    Keys that end in a place of 2 stand for rows that equal the one of place 1, and are followed by its like,
    themselves. Keys are dealt out by range, so that each part is put in order on its own; the parts' ends
    are a row per part.
    """
    dealt = keys.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "fingerprint_order")
    within = Window.partitionBy("part").orderBy(F.col("key").desc())
    placed = dealt.withColumn("next", F.lead("key").over(within))
    ends = dealt.groupBy("part").agg(F.max("key").alias("greatest"))
    in_order = Window.orderBy("part")
    ends = ends.select("part", F.lag("greatest").over(in_order).alias("below"), F.max("greatest").over(Window.partitionBy()).alias("top"))
    joined = placed.join(F.broadcast(ends), "part")
    following = F.coalesce("next", "below", "top")
    if isinstance(keys.schema["key"].dataType, StructType):
        following = F.when(F.col("key.place") == 2, F.col("key")).otherwise(following)
    return written(joined.select("key", "n_chars", "times", following.alias("next")), "fingerprint_order")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples, 0 to 1. Two texts without words are alike, one and another aren't."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    none_a, none_b = a[0].isNull(), b[0].isNull()
    return F.when(none_a & none_b, 1.0).when(none_a | none_b, 0.0).otherwise(equal / F.lit(float(SAMPLES)))


def _keyed(docs: DataFrame, id_col: str) -> tuple[Column, Column]:
    """A key that is never null and has the order of the ids, null the least; and the id from a key."""
    kind = docs.schema[id_col].dataType
    if isinstance(kind, IntegralType):
        least = F.lit(-(2**63)).cast("bigint")
        return F.coalesce(F.col(id_col).cast("bigint"), least), F.when(F.col("key") != least, F.col("key")).cast(kind)
    said = F.concat(F.lit("1"), F.col(id_col).cast("string"))
    return F.coalesce(said, F.lit("0")), F.when(F.col("key") != "0", F.substring("key", 2, 2**31 - 1)).cast(kind)


def _with_repeats(base: DataFrame) -> DataFrame:
    """key, text, times: a row per id and different text, and one for the rows that repeat both.

    Of n equal rows the last is followed by the next different one, as any row is; the others are followed by
    their equal, and stand in one row ``times`` n - 1.
    """
    each = base.groupBy("key", F.sha2("text", 256).alias("digest")).agg(F.min("text").alias("text"), F.count("*").alias("n"))
    kinds = F.array(
        F.struct(F.lit(1).alias("place"), F.lit(1).cast("bigint").alias("times")),
        F.struct(F.lit(2).alias("place"), (F.col("n") - 1).alias("times")),
    )
    rows = each.select("key", "digest", "text", F.explode(F.filter(kinds, lambda k: k["times"] > 0)).alias("k"))
    return rows.select(F.struct(F.col("key").alias("id"), "digest", "k.place").alias("key"), "text", "k.times")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by as much of the start of the next document, in falling
    order of ids; the least is followed by the greatest. A fingerprint is the text of its samples, empty
    for a text without words. There is a row per row of ``docs``. Ids are whole numbers or text (others go
    by their text) and may be null, which is the least, or shared: rows of one id are in falling order
    of their texts' SHA-256, and equal ones follow each other. A null text is empty; texts are read whole.
    An empty table gives an empty result; other columns play no part, whatever their names.
    """
    key, the_id = _keyed(docs, id_col)
    base = docs.select(key.alias("key"), text_or_empty(text_col).alias("text"))
    keys = written(base.select("key", F.length("text").cast("bigint").alias("n_chars")), "fingerprint_keys")
    if keys.count() != keys.select("key").distinct().count():
        base = written(_with_repeats(base), "fingerprint_texts")
        keys = base.select("key", F.length("text").cast("bigint").alias("n_chars"), "times")
    else:
        keys = keys.withColumn("times", F.lit(1).cast("bigint"))
    order, shared = _next_keys(keys), "times" in base.columns

    replaced = F.floor(F.col("n_chars") / 3).cast("int")
    asked = order.select(F.col("next").alias("key"), F.col("key").alias("asker"), replaced.alias("m"))
    given = base.join(asked, "key")
    given = given.select(F.col("asker").alias("key"), F.substring(F.col("text"), F.lit(1), F.col("m")).alias("start"))
    texts = base.join(given, "key")
    length = F.length("text")
    own = F.substring(F.col("text"), F.lit(1), (length - F.floor(length / 3)).cast("int"))
    texts = texts.select("key", "text", F.concat(own, F.col("start")).alias("edited"))
    signed = written(_signatures(texts), "fingerprint_samples")

    told = lambda c: F.transform(c, lambda s: s.bitwiseAND(F.lit((1 << _ID_BITS) - 1)))
    none = F.array_repeat(F.lit(None).cast("bigint"), SAMPLES)
    signed = signed.select("key", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), *(F.coalesce(told(F.col(c)), none).alias(c) for c in ("own", "edited")))
    after = signed.select(F.col("key").alias("next"), F.col("own").alias("after"))
    joined = order.join(signed, "key").join(after, "next")
    if shared:
        joined = joined.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
        joined = joined.withColumn("key", F.col("key.id"))
    text = lambda c: F.array_join(F.transform(c, _hex8), "")
    return joined.select(
        the_id.alias(id_col), "n_chars", "edited_sha256",
        text(F.col("own")).alias("fingerprint"), text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
