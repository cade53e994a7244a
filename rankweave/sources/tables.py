"""Ratings, item features and feedback as views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _instant(df: DataFrame, column: str):
    """A timestamp column as an instant; zoneless ones are read as UTC whatever the session zone."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})"))
    return F.col(column).cast("timestamp")


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """One rating per (user, item): the latest purchase, its quantity mapped to 1..5.

    ``max`` over a struct replaces a sort window: it pre-aggregates before the shuffle, so
    neither a popular item nor a heavy buyer gathers its rows in one task.
    """
    orders = _table(spark, folder, "orders")
    orders = orders.select("o_orderkey", "o_custkey", _instant(orders, "o_orderdate").alias("o_orderdate"))
    lines = _table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    latest = F.max(F.struct("o_orderdate", "l_orderkey", "l_quantity")).alias("latest")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
        .agg(latest)
        .select(
            "user_id",
            "item_id",
            F.ceil(F.col("latest.l_quantity") / 10).cast("double").alias("rating"),
            F.col("latest.o_orderdate").alias("ts"),
        )
    )


def event_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Raw feedback rows ``(event_id, user_id, item_id, rating, ts)`` of the event log.

    ``rating`` is the event value folded onto 1..5.
    """
    events = _table(spark, folder, "events")
    return events.select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        (1.0 + F.floor(F.col("value")).cast("long") % 5).alias("rating"),
        _instant(events, "ts").alias("ts"),
    )


def item_features(spark: SparkSession, folder: str) -> DataFrame:
    """``(item_id, feature, value)`` from the part attributes, one indicator per attribute."""
    names = F.array(
        F.concat(F.lit("brand="), "p_brand"),
        F.concat(F.lit("type="), "p_type"),
        F.concat(F.lit("size="), F.col("p_size").cast("string")),
    )
    return _table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"), F.explode(names).alias("feature"), F.lit(1.0).alias("value")
    )


def item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(item_id, factors)``: the stored embeddings, floats as floats; items past the last one have none."""
    vectors = _table(spark, folder, "embeddings")
    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select(
        F.col("vec_id").alias("item_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("factors")
    )
