"""A corpus pipeline over ``documents``: classify, deduplicate lines and documents, decontaminate, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlight.llm import decontamination, line_dedup, packing, quality, simhash
from spendlight.llm.tables import columns, table
from spendlight.storage import cut


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, each row by its own text."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their redundant lines taken out and ``n_chars`` counted anew; none goes."""
    kept = line_dedup.dedup_lines(docs)
    return kept.select(*(F.length("text").cast("long").alias("n_chars") if name == "n_chars" else column for name, column in zip(docs.columns, columns(docs), strict=True)))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least doc_id (null ids stay)."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``, each row by its own text."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; see ``packing.pack``."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]

#: No stage can be written in DuckDB SQL: they hold a trained model, MinHash, XXH64, a decomposition and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
