"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns it was given. Nulls, empty and very long texts, repeated
rows, empty tables and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import decontamination, line_dedup, near_dedup, packing, quality
from rankweave.llm.common import Scratch, prepare, table


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    prepare(spark)
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; a document without lines left goes."""
    prepare(spark)
    return line_dedup.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each near-duplicate group: 5-word shingles, Jaccard similarity 0.8 or more."""
    prepare(spark)
    return near_dedup.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of ``benchmark``, word for word or with other values in its slots."""
    prepare(spark)
    return decontamination.remove_contaminated(docs, table(spark, folder, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of at most 4096 tokens, each with its sequence and its place there."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# Sketches, genetic packing and robust estimates are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, folder, "documents")
    for _, stage in STAGES:
        docs = scratch.store(stage(spark, docs, folder))
    return docs
