"""The registered queries of this subpackage and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import contamination, conversations, language, negatives, packing, quality, secrets, sharding, simhash, substrings, tokens, urls, vectors
from corvane.llm.tables import table
from corvane.plans.scratch import cut


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once; their statistics, twenty numbers a document, serve to fit and to score."""
    stats = cut(quality.with_statistics(table(spark, sf_dir, "documents"), ["doc_id"]), "statistics")
    model = quality.fit(quality.training_rows(stats, table(spark, sf_dir, "labels")))
    scored = quality.with_scores(stats, model, ["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = quality.held_out(F.col("doc_id"), 4, 2)
    model = language.learn(documents.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return language.identify(documents, model, ["doc_id", held_out.alias("held_out")])


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secrets.scan(documents, secrets.learn(documents), ["doc_id"])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place_rows(table(spark, sf_dir, "documents"), 24)


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the rows get the next label; a fiftieth are anchors."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.RULES))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(whole), whole)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_tokens": op2_tokens,
        "op3_contamination": op3_contamination,
        "op4_language": op4_language,
        "op5_substrings": op5_substrings,
        "op6_secrets": op6_secrets,
        "op7_simhash": op7_simhash,
        "op8_sharding": op8_sharding,
        "op9_vectors": op9_vectors,
        "op10_packing": op10_packing,
        "op11_negatives": op11_negatives,
        "op12_urls": op12_urls,
        "op13_conversations": op13_conversations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_contamination": contamination.oracle(), "op9_vectors": vectors.oracle(), "op10_packing": packing.oracle(), "op11_negatives": negatives.oracle(), "op12_urls": urls.oracle()}
