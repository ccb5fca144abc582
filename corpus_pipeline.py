"""Documents to packed token ids: quality, near-duplicates, benchmark passages, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medloom.llm import decontaminate, minhash, mixing, packing, quality
from medloom.llm.common import cut
from medloom.plans.base import table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", _quality),
    ("minhash_dedup", _near_duplicates),
    ("decontamination", _decontamination),
    ("source_mixing", _mixture),
    ("token_packing", _packing),
]

# A trained classifier, sampled signatures and a tokenizer are beyond SQL: tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
