"""From raw documents to packed training sequences: quality, language, near-duplicates, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import copies, language, mixing, packing, quality, simhash
from tessera.llm.queries import tokenizer_path
from tessera.plans.cut import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the label model over the quality rules keeps. Null, empty and short texts go; rows that repeat stay or go together."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told, which then stands in lang. Without any declared language all stay as they are."""
    return language.keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id; rows without an id stay, of rows that repeat one does."""
    return simhash.keep_one(docs)


def drop_like(docs: DataFrame) -> DataFrame:
    """docs without the near copies that the radius of simhash_dedup leaves: one document stays of those 0.8 or more alike by five-word shingles."""
    return copies.keep_unlike(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, after drop_like: that step reads its input several times, so it stands here, where the input is a table."""
    return mixing.take(drop_like(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a null text is its end token."""
    return packing.pack_documents(docs, tokenizer_path(), gather=4 << 20)


#: simhash_dedup drops near copies within op10's radius; what is 0.8 or more alike beyond it goes at the beginning of mixing (drop_like).
STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("simhash_dedup", simhash_dedup), ("mixing", mix), ("packing", pack)]

#: No stage can be told in SQL as a whole (models fitted to the corpus, XXH64, a tokenizer); tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
