"""Readers for the MovieLens text layout: tab-separated ratings, pipe-separated items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The genre flags of the MovieLens-100K item file, in file order.
GENRES = [
    "unknown", "Action", "Adventure", "Animation", "Children's", "Comedy", "Crime",
    "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "Musical", "Mystery",
    "Romance", "Sci-Fi", "Thriller", "War", "Western",
]

_RATING_FILE = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("epoch_seconds", T.LongType()),
])

_ITEM_FILE = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("release_date", T.StringType()),
        T.StructField("video_release_date", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
    + [T.StructField(g, T.IntegerType()) for g in GENRES]
)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(_RATING_FILE).option("sep", "\t").csv(path)
    return raw.select("user_id", "item_id", "rating", F.timestamp_seconds("epoch_seconds").alias("ts"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ITEM_FILE).option("sep", "|").option("encoding", "ISO-8859-1").csv(path)


def genre_features(items: DataFrame) -> DataFrame:
    """``(item_id, feature, value)``, one row per set genre flag."""
    flags = F.array(*[
        F.struct(F.lit(f"genre={g}").alias("feature"), F.col(f"`{g}`").cast("double").alias("value"))
        for g in GENRES
    ])
    return (
        items.select("item_id", F.explode(flags).alias("flag"))
        .select("item_id", "flag.feature", "flag.value")
        .filter(F.col("value") > 0)
    )
