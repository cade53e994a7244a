"""Named queries of the training-data operators over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import (
    decontamination, divergence, extraction, licenses, line_dedup, near_dedup, oracle, packing, pii, quality, secret_scan, sharding,
    toxicity, walsh_clusters,
)
from rankweave.llm.common import prepare, table


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or with other values in its slots."""
    found = decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "kind", "from_word", "to_word", F.round("coverage", 4).alias("coverage"), "n_slots")


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in whole texts, found through a trigram index."""
    return secret_scan.scan(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Category probabilities of a classifier chain trained on ``labels``; documents judged toxic."""
    scored = toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    chances = [c for c in scored.columns if c.startswith("p_")]
    return scored.select("doc_id", *[F.round(c, 4).alias(c) for c in chances], "toxic")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and robust outliers per language and source."""
    judged = quality.judge(table(spark, folder, "documents"))
    counts = [f"stats.{name}" for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc.doc_id", *counts, "base_failed", "kept", F.round("distance", 4).alias("distance"))


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets have a Jaccard similarity of 0.8 or more."""
    settings = near_dedup.NearDedupSettings(words=2, percent=80)
    return near_dedup.near_duplicates(table(spark, folder, "documents"), settings)


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts that are known licenses, and license notices among their lines."""
    return licenses.scan(table(spark, folder, "documents"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards of one mixture of sources, equal in rows."""
    placed = sharding.interleave(table(spark, folder, "documents"), sharding.ShardSettings(shards=8))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of at most 4096 tokens in as few sequences as the genetic algorithm finds."""
    return packing.pack(table(spark, folder, "documents"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without later occurrences of three-line windows."""
    return line_dedup.dedup_lines(table(spark, folder, "documents")).select("doc.doc_id", "cleaned.*")


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in whole texts, by rules and by contexts learnt from their matches."""
    return pii.find(table(spark, folder, "documents"))


def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page by wrappers inferred per host."""
    return extraction.extract(table(spark, folder, "pages"))


def op12_walsh_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen clusters of the vectors after three rounds, assigned by a progressive Walsh-Hadamard search."""
    return walsh_clusters.cluster(table(spark, folder, "embeddings"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How far each source of a language strays from its peers, and by which terms."""
    return divergence.audit(table(spark, folder, "documents"))


_QUERIES = [
    op1_benchmark_decontamination,
    op2_secret_scan,
    op3_toxicity,
    op4_quality_rules,
    op5_minhash_near_dedup,
    op6_license_scan,
    op7_sharding,
    op8_best_fit_packing,
    op9_line_dedup,
    op10_personal_data,
    op11_html_extraction,
    op12_walsh_clusters,
    op13_source_divergence,
]


def _prepared(fn):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return fn(spark, folder)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: _prepared(fn) for fn in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
