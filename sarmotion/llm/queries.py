"""One query for each text operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarmotion.llm import language_id, oracle, toxicity
from sarmotion.llm.common import crc_mod, table
from sarmotion.llm.decontamination import benchmark_hits, contaminated, hit_words
from sarmotion.llm.exact_dedup import exact_duplicates
from sarmotion.llm.lm_scoring import scored
from sarmotion.llm.near_dedup import near_duplicates
from sarmotion.llm.packing import packed_pieces
from sarmotion.llm.periodic_runs import periodic_runs
from sarmotion.llm.pii import KINDS, personal_data, written_spans, written_terms
from sarmotion.llm.prefix_trie import prefix_trie
from sarmotion.llm.quality import quality
from sarmotion.llm.sharding import shuffled_shards
from sarmotion.llm.substring_dedup import repeated_passages


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from text and lang of rows whose crc32(doc_id) mod 4 is not 2; ``rejected`` is the calibrated rejection."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    found = language_id.identified(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, number))).cast("long").alias(f"n_{kind}")
        for number, kind in enumerate(KINDS)
    ]
    base = written_spans(F.col("spans"))
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, written_terms(F.col("terms"))), ",").alias("spans"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from texts whose crc32(doc_id) mod 5 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    found = scored(docs.select("doc_id", "text", (~held_out).alias("trained")), trained_col="trained")
    return found.withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the 16 shards are at most one apart: the law is ``rows``."""
    sharded = shuffled_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharded.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("n_hit", hit_words("hits")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from labels of rows whose crc32(doc_id) mod 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held_out))
    found = toxicity.toxicity(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.85)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crc32 of the doc_id plants a period in a tenth of the texts."""
    return periodic_runs(table(spark, sf_dir, "documents"), planted=F.col("doc_id").cast("string"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from labels of rows whose crc32(doc_id) mod 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    found = quality(docs, labels.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


# Parts of results that SQL can check, through the same operators.


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.floor(F.col("base_score") * 1e3 + 0.5) / F.lit(1e3)
    return op4_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"))


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and slots of every shard."""
    return op5_sharding(spark, sf_dir).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("slot").alias("n_slots"), F.min("slot").alias("first_slot"),
        F.max("slot").alias("last_slot"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_pii(spark, sf_dir).select("doc_id", *[f"n_{kind}" for kind in KINDS])


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality": op13_quality,
    "lm_base_scores": lm_base_scores,
    "shard_law": shard_law,
    "pii_counts": pii_counts,
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": oracle.EXACT_DEDUP,
    "op6_decontamination": oracle.DECONTAMINATION,
    "op9_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op10_minhash_near_dedup": oracle.NEAR_DEDUP,
    "op11_prefix_trie": oracle.PREFIX_TRIE,
    "op12_periodic_runs": oracle.PERIODIC_RUNS,
    "lm_base_scores": oracle.BASE_SCORES,
    "shard_law": oracle.SHARD_LAW,
    "pii_counts": oracle.BASE_COUNTS,
}
