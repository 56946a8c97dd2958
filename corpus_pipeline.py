"""A training corpus from raw documents: each stage applies one operator to all the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatetally.llm import quality
from gatetally.llm.byte_bpe import encoding_digests
from gatetally.llm.common import null_safe, table, tables_deleted, written
from gatetally.llm.exact_dedup import exact_dedup
from gatetally.llm.mixing import mix
from gatetally.llm.ngram_join import BROADCAST_IDS, ngram_join
from gatetally.workspace import delete_folder, shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Labels come from the table of labels.

    A null text is scored as an empty one. Rows that repeat a document are scored alike, so they go or stay
    together; a label counts for each row of its id. Without rows nothing is learnt, and none is returned.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    weights = quality.train(docs, labels)
    return docs.filter(quality.score(F.coalesce("text", F.lit("")), weights) >= 0.5)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the row with the largest id stays; null ids are the least.

    A null text equals an empty one. Of rows that repeat id and text one stays. Columns that are named like
    the operator's own are kept as they are.
    """
    plain = docs.select(*(F.col(f"`{c}`").alias(f"{_MARK}{c}") for c in docs.columns))
    kept = exact_dedup(plain, f"{_MARK}doc_id", f"{_MARK}text").filter("kept")
    return kept.select(*(F.col(f"`{_MARK}{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents a row with the least id stays; null ids come last.

    Rows are told apart by id and text, so a text that shares its id with a copy stays. Of rows that repeat
    both one stays. Texts without words all stay, null ones, too.
    """
    joined = ngram_join(docs).select("doc_id", "text_hash", F.col("stays").cast("int").alias("stays"))
    decided = joined.groupBy("doc_id", "text_hash").agg(F.sum("stays").alias("n_stay"), F.count("*").alias("n_rows"))
    decided = written(decided.filter("n_stay < n_rows"), "pipeline_near")
    few = F.broadcast(decided) if decided.count() <= BROADCAST_IDS else decided
    # Other columns travel in one struct, so that none of their names can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    others = null_safe(rows, few, ["doc_id", "text_hash"], "left_anti").select("row.*")
    # Of rows that repeat id and text, as many as stay, in an order that the other columns give.
    repeated = null_safe(rows, few.filter("n_stay > 0"), ["doc_id", "text_hash"])
    order = Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64(*(F.col("row")[c] for c in docs.columns)))
    first = repeated.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return others.unionAll(first.select("row.*"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to three times; rows without words, null texts too, not at all.

    Every row is drawn for itself, whatever its id. Columns that are named like the operator's own are kept.
    """
    names = {c: f"{_MARK}{c}" for c in docs.columns}
    plain = docs.select(*(F.col(f"`{c}`").alias(name) for c, name in names.items()))
    taken = mix(plain, names["source"], names["text"], names["doc_id"])
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    rows = taken.select(*(F.col(f"`{name}`") for name in names.values()), copies)
    return rows.select(*(F.col(f"`{name}`").alias(c) for c, name in names.items()))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's tokens, counted and digested, and the digest of what they decode to; a null text is empty."""
    coded = encoding_digests(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


#: Before a document's own columns, where an operator adds columns next to them.
_MARK = "own_"

STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: Model scores, random ranks and merges are beyond SQL; each stage is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents.

    What a stage has used up is deleted once its result is written: the tables of its operator, and the result
    of the stage before.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        folder = shared_folder(spark, "pipeline")
        with tables_deleted(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        if before is not None:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
