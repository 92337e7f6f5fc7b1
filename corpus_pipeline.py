"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

Every stage is a function of (spark, docs, sf_dir), whose result is written as Parquet and read again as the next
one's documents. All but the last return the columns of `documents`; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from crewledger.llm import language_em, minhash_bbit, pack_reduction, pii_boost, quality_mcd, tokens
from crewledger.session import use_checkpoints


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; a missing `lang` is filled in."""
    return language_em.identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near others of their language and source."""
    return quality_mcd.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates at 80 percent."""
    return minhash_bbit.deduplicated(docs, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by marks."""
    return pii_boost.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack_reduction.pack(docs, tokens.public_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing),
]

# Mixtures, robust estimates, boosted trees and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
