"""Dataset profiles and item popularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rating_profile(ratings: DataFrame) -> DataFrame:
    return ratings.agg(
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
        F.count("*").alias("n_ratings"),
        F.avg("rating").alias("global_mean"),
    )


def _pairs(positives: DataFrame, unique: bool) -> DataFrame:
    pairs = positives.select("user_id", "item_id")
    return pairs if unique else pairs.distinct()


def interaction_profile(
    positives: DataFrame, universe: DataFrame, algorithm: str = "bpr", unique: bool = False
) -> DataFrame:
    """Shape from every rating (``universe``), non-zeros from the positives.

    ``unique`` states that the positives hold each pair once, which saves a shuffle of all pairs.
    """
    shape = universe.agg(
        F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items")
    )
    nnz = _pairs(positives, unique).agg(F.count("*")).scalar()
    return shape.select(
        "n_users",
        "n_items",
        nnz.alias("n_interactions"),
        (nnz / (F.col("n_users") * F.col("n_items"))).alias("density"),
        F.lit(algorithm).alias("algorithm"),
    )


def item_popularity(positives: DataFrame, universe: DataFrame, unique: bool = False) -> DataFrame:
    """Share of all users that hold each item; items without a positive get 0."""
    n_users = universe.agg(F.countDistinct("user_id")).scalar()
    counts = _pairs(positives, unique).groupBy("item_id").agg(F.count("*").alias("n_positives"))
    return (
        universe.select("item_id").distinct()
        .join(counts, "item_id", "left")
        .select(
            "item_id",
            F.coalesce("n_positives", F.lit(0)).alias("n_positives"),
            (F.coalesce("n_positives", F.lit(0)) / n_users).alias("popularity"),
        )
    )


def model_size(user_factors: DataFrame, item_factors: DataFrame) -> DataFrame:
    """Row counts, factor width and ``U*f + I*f``; biases are not counted."""
    width = user_factors.agg(F.max(F.size("factors")).cast("long")).scalar()
    n_items = item_factors.agg(F.count("*")).scalar()
    return user_factors.agg(F.count("*").alias("n_users")).select(
        "n_users",
        n_items.alias("n_items"),
        width.alias("n_factors"),
        (F.col("n_users") * width + n_items * width).alias("total_parameters"),
    )


SKETCH_BITS = 14  # of a sketch's registers: a standard error of about 1.04 / sqrt(2 ** bits)


def profile_sketches(ratings: DataFrame, part: Column | str) -> DataFrame:
    """``(part, n_ratings, rating_sum, users, items)``: a rating-set profile per part that can be merged.

    ``users`` and ``items`` are HyperLogLog sketches, to be stored with a part once and merged with those of
    later parts, where exact distinct counts would read all ratings again.
    """
    part = F.col(part) if isinstance(part, str) else part
    return ratings.groupBy(part.alias("part")).agg(
        F.count("*").alias("n_ratings"), F.sum("rating").alias("rating_sum"),
        F.hll_sketch_agg("user_id", SKETCH_BITS).alias("users"), F.hll_sketch_agg("item_id", SKETCH_BITS).alias("items"),
    )


def merge_profiles(sketches: DataFrame) -> DataFrame:
    """One row like ``rating_profile``, with estimated ``n_users`` and ``n_items``, from stored parts."""
    merged = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c))
    return sketches.agg(
        merged("users").alias("n_users"), merged("items").alias("n_items"), F.sum("n_ratings").alias("n_ratings"),
        (F.sum("rating_sum") / F.sum("n_ratings")).alias("global_mean"),
    )
