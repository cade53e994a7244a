"""Small tables with known structure."""

from pyspark.sql import functions as F

from rankweave.functions.hashing import hash32, uniform
from rankweave.functions.vectors import dot


def lists(spark, by_user: dict):
    rows = [(u, i, r + 1) for u, items in by_user.items() for r, i in enumerate(items)]
    return spark.createDataFrame(rows, "user_id long, item_id long, rank int")


def planted_ratings(spark, n_users=300, n_items=150, seed=1):
    """Ratings from 4 hidden dimensions, about a fifth of all pairs kept."""
    def hidden(kind, column):
        return F.array(*[uniform(seed, kind, column, F.lit(d)) - 0.5 for d in range(4)])

    pairs = spark.range(n_users * n_items).select(
        (F.col("id") % n_users).alias("user_id"), F.floor(F.col("id") / n_users).alias("item_id")
    )
    rating = 3 + 6 * dot(hidden(1, "user_id"), hidden(2, "item_id"))
    return pairs.filter(hash32(7, "user_id", "item_id") % 10 < 3).select(
        "user_id", "item_id", F.greatest(F.lit(1.0), F.least(F.lit(5.0), rating)).alias("rating"),
        F.timestamp_seconds(hash32(8, "user_id", "item_id") % 1_000_000).alias("ts"),
    )
