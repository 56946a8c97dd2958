"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatetally.llm import chat, pii, quality
from gatetally.llm.byte_bpe import encoding_digests
from gatetally.llm.chat_repair import damaged, repair_conversations
from gatetally.llm.collocations import collocations
from gatetally.llm.common import table, written
from gatetally.llm.exact_dedup import exact_dedup
from gatetally.llm.fingerprints import fingerprints
from gatetally.llm.lm import lm_scores
from gatetally.llm.mixing import mix
from gatetally.llm.ngram_join import ngram_join
from gatetally.llm.substring_dedup import substring_dedup
from gatetally.llm.token_counts import token_counts


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = f"{chat.END}{chat.START}assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"),
    )
    messages = chat.conversation_messages(conversations.unionByName(own))
    formatted = written(chat.format_conversations(messages), "chat_formatted")
    turns = chat.read_back(formatted).groupBy("tree").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("place", "role", "text", "loss"))).alias("t"),
    )
    said = F.array_join(F.transform("t", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform("t", lambda t: F.coalesce(t.loss, F.lit(""))), "")
    digests = turns.select(
        "tree", "n_turns", F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
    )
    chars = formatted.select(F.col("tree").alias("_t"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    joined = digests.join(chars, F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")
    return joined.withColumnRenamed("tree", "conv_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    weights = quality.train(docs, labels.filter(quality.fold("doc_id", 3) != 1))
    scored = quality.classify(docs, weights)
    held_out = (quality.fold("doc_id", 3) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = quality.fold("doc_id", 7)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scores(docs.withColumn("held_out", fold == 2), fold != 2)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.base)
    kinds = F.transform(base, lambda s: s.kind)
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS
    ]
    digest = F.sha2(pii.said(base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.said(F.col("spans")).alias("spans"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoding_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    return repair_conversations(damaged(rows), rows).withColumnRenamed("conv", "conv_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lengths = F.transform("removed", lambda s: s["end"] - s["start"])
    n_removed = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda n, length: n + length)
    return cut.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_mix_sources": op3_mix_sources,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_lm_scores": op6_lm_scores,
    "op7_pii": op7_pii,
    "op8_fingerprints": op8_fingerprints,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_chat_repair": op11_chat_repair,
    "op12_collocations": op12_collocations,
    "op13_substring_dedup": op13_substring_dedup,
}
