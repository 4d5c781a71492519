"""Cleaning and packing of a text corpus in five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarmotion.llm import language_id
from sarmotion.llm.common import small_batches, table, written
from sarmotion.llm.decontamination import benchmark_hits, contaminated, hit_words
from sarmotion.llm.exact_dedup import exact_duplicates
from sarmotion.llm.idfilter import without
from sarmotion.llm.near_dedup import near_duplicates
from sarmotion.llm.packing import packed_pieces
from sarmotion.session import ship_package

TOKENIZER = "word_bpe_49k.json"
CACHED_CHUNKS = 150_000


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    small_batches(spark)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language identification rejects go: no letter, or a confidence below its threshold."""
    _prepare(spark)
    return language_id.accepted(docs, language_id.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one stays."""
    _prepare(spark)
    return without(docs, written(exact_duplicates(docs).where("not kept").select("doc_id")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    _prepare(spark)
    return without(docs, written(near_duplicates(docs, threshold=0.8).where("not kept").select("doc_id")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words in benchmark windows go."""
    _prepare(spark)
    found = benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    dirty = found.where(contaminated(hit_words(F.col("hits")), F.col("n_words"))).select("doc_id")
    return without(docs, written(dirty))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in planned sequences."""
    _prepare(spark)
    # The stages before it have left their memory behind.
    return packed_pieces(docs, public_tokenizers.path(TOKENIZER), cached_chunks=CACHED_CHUNKS)


STAGES = [
    ("language_id", identify),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack),
]

# Neither the language model nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
