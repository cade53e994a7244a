"""Splits, filters and encodings that turn ratings into training and evaluation sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.hashing import HASH_RANGE, hash32
from rankweave.operators.ordering import hash_rank, hash_rank_within, label_by_cuts, sort_rank

RATING_SCALE = (1.0, 5.0)


def hash_cut(fraction: float) -> int:
    """The hashes below this number are ``fraction`` of all."""
    return math.ceil(fraction * HASH_RANGE)


def holdout_tag(ratings: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test`` from a hash of the pair: no sort and no shuffle, stable as rows arrive."""
    return ratings.withColumn("is_test", hash32(seed, "user_id", "item_id") < hash_cut(fraction))


def holdout_split(ratings: DataFrame, fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    tagged = holdout_tag(ratings, fraction, seed)
    return (
        tagged.filter(~F.col("is_test")).drop("is_test"),
        tagged.filter("is_test").drop("is_test"),
    )


def store_split(ratings: DataFrame, path: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Write the tagged ratings once, one folder per part, and read them back.

    Popularity, masks, truth and user samples all start from the split; a stored one is read
    with column and partition pruning where a view would be derived again for each of them.
    """
    tagged = holdout_tag(ratings, fraction, seed)
    tagged.write.mode("overwrite").partitionBy("is_test").parquet(path)
    return ratings.sparkSession.read.schema(tagged.schema).parquet(path)


def validation_split(train: DataFrame, fraction: float = 0.1, seed: int = 43) -> tuple[DataFrame, DataFrame]:
    """90/10 cut of the training rows; a different seed keeps it independent of the hold-out."""
    return holdout_split(train, fraction, seed)


def exact_holdout_tag(ratings: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test`` for exactly ``ceil(fraction * n)`` rows."""
    hashed = ratings.withColumn("_h", hash32(seed, "user_id", "item_id"))
    total = ratings.agg(F.count("*")).scalar()
    numbered = hash_rank(hashed, "_h", ["user_id", "item_id"])
    return numbered.withColumn("is_test", F.col("hash_no") <= F.ceil(F.round(total * F.lit(fraction), 6))).drop("_h", "hash_no")


def temporal_tag(
    ratings: DataFrame, fraction: float = 0.2, order: tuple[str, ...] = ("ts", "user_id", "item_id")
) -> DataFrame:
    """``is_test`` for the latest rows: everything after the first ``floor((1 - fraction) * n)``."""
    total = ratings.count()
    keep = math.floor(round(total * (1.0 - fraction), 6))
    if not 0 < keep < total:
        return ratings.withColumn("is_test", F.lit(keep <= 0))
    tagged = label_by_cuts(ratings, F.unix_micros(order[0]), list(order[1:]), [keep], "_behind")
    return tagged.withColumn("is_test", F.col("_behind") > 0).drop("_behind")


def stratified_tag(ratings: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test`` for ``ceil(fraction * n)`` rows of every user."""
    hashed = ratings.withColumn("_h", hash32(seed, "user_id", "item_id"))
    numbered = hash_rank_within(hashed, "user_id", "_h", ["item_id"])
    share = F.ceil(F.round(F.col("group_size") * F.lit(fraction), 6))
    return numbered.withColumn("is_test", F.col("hash_no") <= share).drop("_h", "hash_no", "group_size")


def min_items_per_user(ratings: DataFrame, least: int = 5) -> DataFrame:
    """Keep users with at least ``least`` rows; counts are pre-aggregated, rows are semi-joined."""
    enough = ratings.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return ratings.join(enough, "user_id", "left_semi")


def to_implicit(ratings: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Positive interactions: ratings at or above the threshold, weight 1."""
    return ratings.filter(F.col("rating") >= threshold).select("user_id", "item_id", F.lit(1.0).alias("weight"))


def confidence_weights(ratings: DataFrame, alpha: float = 40.0) -> DataFrame:
    """Confidence ``1 + alpha * rating`` (Hu, Koren and Volinsky 2008)."""
    return ratings.select("user_id", "item_id", (1.0 + F.lit(float(alpha)) * F.col("rating")).alias("confidence"))


def encode_ids(rows: DataFrame, column: str) -> DataFrame:
    """Dictionary ``(column, idx)``: 0-based contiguous index in id order."""
    ids = rows.select(column).distinct()
    return sort_rank(ids, [F.col(column)]).select(column, (F.col("order_no") - 1).alias("idx"))


def transpose(interactions: DataFrame) -> DataFrame:
    """Item-to-user orientation of an interaction table."""
    rest = [c for c in interactions.columns if c not in ("user_id", "item_id")]
    return interactions.select("item_id", "user_id", *rest)


def item_list_tiles(interactions: DataFrame, width: int = 1024) -> DataFrame:
    """Each user's distinct items as sorted lists, one per ``width`` consecutive item ids.

    Tiling bounds every list, so a user holding a large part of the rows is still spread over
    many groups and no list outgrows a row.
    """
    tile = F.floor(F.col("item_id") / width).alias("tile")
    return interactions.groupBy("user_id", tile).agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def evaluation_users(truth: DataFrame, cap: int | None = None, seed: int = 42) -> DataFrame:
    """Users with any truth; where a ``cap`` is given, a seeded sample of at most that many."""
    users = truth.select("user_id").distinct()
    if cap is None:
        return users
    order = hash32(seed, "user_id")
    return users.orderBy(order, "user_id").limit(cap)


def clip_to_scale(estimate, scale: tuple[float, float] = RATING_SCALE):
    return F.greatest(F.lit(float(scale[0])), F.least(F.lit(float(scale[1])), estimate))
