"""Proportional stratified interleaving: shards that all have the mixture of the whole.

Rows are shuffled within their source by a seeded hash and ranked; all rows are sorted by fractional
rank, (rank - 1/2) / size of the source, and cut into shards of equal count. Both orders are total, so
ranks are exact positions of a distributed sort: tasks get ranges of equal size whatever share of the
rows one source has and however many rows have one fraction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import Scratch
from rankweave.operators.ordering import sort_rank


@dataclass(frozen=True)
class ShardSettings:
    shards: int = 8
    seed: int = 42
    by: str = "source"


def interleave(docs: DataFrame, s: ShardSettings = ShardSettings()) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: doc_id, source, size, text_crc32, shard, slot.

    Shard counts differ by one at most. A shard's count of a source differs from its share by one at
    most, and by the source's share of as many rows as there are sources, whatever the number of rows,
    since cuts by count move the fraction where a shard ends by that much. ``size`` is the text's UTF-8 bytes and 1; a null text has none, and the checksum of an empty
    one. Null sources are a source of their own. Repeated rows are ranked one after the other; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce("text", F.lit(""))
    rows = scratch.store(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(s.by).cast("string").alias("source"),
        F.to_json(F.array(F.col(s.by).cast("string"))).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(s.seed), "doc_id", "text").alias("shuffle"),
    ))
    total = rows.count()
    shuffled = scratch.store(
        sort_rank(rows, [F.col(c) for c in ("stratum", "shuffle", "doc_id", "text_crc32", "size")], "position")
    )
    strata = shuffled.groupBy("stratum").agg((F.min("position") - 1).alias("earlier"), F.count("*").alias("held"))
    placed = shuffled.join(strata, "stratum").select(
        "doc_id", "source", "stratum", "size", "text_crc32",
        ((2 * (F.col("position") - F.col("earlier")) - 1) / (2 * F.col("held"))).alias("fraction"),
        F.xxhash64(F.lit(s.seed + 1), "stratum").alias("turn"),
    )
    ordered = sort_rank(placed, [F.col(c) for c in ("fraction", "turn", "stratum")], "place")
    # Whole-number arithmetic: shard k begins at place ceil(k x total / shards).
    return (
        ordered.withColumn("shard", F.expr(f"cast(((place - 1) * {s.shards}) div {max(total, 1)} as int)"))
        .withColumn("first", F.expr(f"(shard * {total}L + {s.shards - 1}) div {s.shards}"))
        .select("doc_id", "source", "size", "text_crc32", "shard", (F.col("place") - 1 - F.col("first")).alias("slot"))
    )
