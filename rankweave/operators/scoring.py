"""Scoring given (user, item) pairs by factor lookups, and explaining the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.vectors import dot, vector_mean


def score_pairs(pairs: DataFrame, users: DataFrame, items: DataFrame, use_bias: bool = False) -> DataFrame:
    """Add ``score``: factor dot product (plus biases); an unknown user or item scores 0.0.

    The items' vectors travel to the users: they may be floats, and often few items have one.
    """
    bias = ["bias"] if use_bias else []
    left = users.select("user_id", F.col("factors").alias("_p"), *[F.col(b).alias("_bu") for b in bias])
    right = items.select("item_id", F.col("factors").alias("_q"), *[F.col(b).alias("_bi") for b in bias])
    value = dot(F.col("_p"), F.col("_q"))
    if use_bias:
        value = value + F.col("_bu") + F.col("_bi")
    return (
        pairs.join(right, "item_id", "left")
        .join(left, "user_id", "left")
        .select("item_id", "user_id", *[c for c in pairs.columns if c not in ("item_id", "user_id")], F.coalesce(value, F.lit(0.0)).alias("score"))
    )


def explain_scores(pairs: DataFrame, users: DataFrame, items: DataFrame, n_top: int = 5) -> DataFrame:
    """The ``n_top`` factors with the largest absolute contribution to each pair's score.

    Pairs with an unknown user or item are absent. The sort runs inside one pair's array, whose
    length is the factor width.
    """
    products = F.zip_with("_p", "_q", lambda a, b: F.struct((a * b).alias("contribution"), a.alias("user_value"), b.alias("item_value")))
    numbered = F.transform(
        products,
        lambda x, i: F.struct(
            (-F.abs(x.contribution)).alias("key"), i.cast("long").alias("factor_id"),
            x.contribution.alias("contribution"), x.user_value.alias("user_value"), x.item_value.alias("item_value"),
        ),
    )
    top = F.slice(F.array_sort(numbered), 1, n_top)
    return (
        pairs.join(items.select("item_id", F.col("factors").alias("_q")), "item_id")
        .join(users.select("user_id", F.col("factors").alias("_p")), "user_id")
        .withColumns({c: F.col(c).cast("array<double>") for c in ("_p", "_q")})
        .select("user_id", "item_id", dot(F.col("_p"), F.col("_q")).alias("total_score"), top.alias("top"))
        .select(
            "user_id", "item_id", "total_score",
            F.transform(
                "top",
                lambda t: F.struct(t.factor_id.alias("factor_id"), t.contribution.alias("contribution"),
                                   t.user_value.alias("user_value"), t.item_value.alias("item_value")),
            ).alias("top_factors"),
        )
    )


def liked_item_vectors(positives: DataFrame, items: DataFrame) -> DataFrame:
    """A user vector as the mean vector of the user's items (users without any are absent)."""
    widest = items.select(F.size("factors").alias("n")).first()
    width = widest.n if widest else 0
    return (
        positives.join(items.select("item_id", "factors"), "item_id")
        .groupBy("user_id").agg(vector_mean("factors", width).alias("factors"))
    )


def rank_scores(scores: DataFrame, n: int) -> DataFrame:
    """Best ``n`` rows per user; near-equal scores (9 places) fall back to item order.

    Filtering the row number lets Spark cut each map task's share of a user to ``n`` rows before
    the shuffle.
    """
    order = Window.partitionBy("user_id").orderBy(F.round("score", 9).desc(), "item_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def nested_lists(ranked: DataFrame) -> DataFrame:
    """One row per user with the ordered ``array<struct<item_id, score>>`` of a cut list."""
    entry = F.struct("rank", "item_id", "score")
    ordered = F.array_sort(F.collect_list(entry))
    return ranked.groupBy("user_id").agg(
        F.transform(ordered, lambda e: F.struct(e.item_id.alias("item_id"), e.score.alias("score"))).alias("items")
    )
