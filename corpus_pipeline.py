"""The corpus pipeline: a stage takes the documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passledger.llm import bpe, contamination, exact, quality, simhash
from passledger.llm.common import learnable, table
from passledger.session import scratch_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of ``sf_dir``."""
    model = quality.learned(docs, learnable(table(spark, sf_dir, "labels"), "quality", 5, 0))
    return quality.drop_rejected(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of equal texts stays."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near fingerprints stays."""
    return simhash.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    rows = bpe.tokenized(docs.select("doc_id", "lang", "source", "text"), bpe.public_ranks(), bpe.public_pattern())
    return rows.select("doc_id", "lang", "source", "ids", *bpe.digests(rows))


#: Name and function of each stage, in order; all but the last return the columns of documents.
STAGES = [
    ("quality classifier", quality_filter), ("exact dedup", exact_dedup), ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate), ("byte-level bpe", encode),
]

#: Only exact dedup can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
