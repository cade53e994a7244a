"""Exact row numbers over data that must not pass through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.hashing import HASH_RANGE
from rankweave.session import cut_lineage

HASH_BUCKETS = 65536
# A group with more rows than this is numbered bucket by bucket.
LARGE_GROUP_ROWS = 1_000_000


def sort_rank(df: DataFrame, order: list[Column], name: str = "order_no") -> DataFrame:
    """1-based position in the global ``order``, which must be total.

    Range partitions are sorted independently; a partition's offset is the summed size of the
    partitions before it. The checkpoint pins the sampled range bounds, so sizes and positions
    agree even if tasks are retried. The broadcast side has one row per partition.
    """
    position = F.monotonically_increasing_id()  # partition number << 33, then row number
    ranged = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", position)
    ).withColumn("_part", F.shiftright("_pos", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    within = F.col("_pos").bitwiseAND(F.lit(2**33 - 1))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + within + 1)
        .drop("_pos", "_part", "_before")
    )


def hash_rank(df: DataFrame, hash_column: str, ties: list[str], name: str = "hash_no") -> DataFrame:
    """1-based position by ``(hash_column, *ties)`` over all rows.

    The hash is uniform, so its leading bits cut the rows into even buckets that are numbered in
    parallel; the broadcast offsets are at most ``HASH_BUCKETS`` rows.
    """
    bucket = F.floor(F.col(hash_column) / (HASH_RANGE // HASH_BUCKETS)).alias("_bucket")
    rows = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_bucket").orderBy(hash_column, *ties)
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_before") + F.col("_row"))
        .drop("_bucket", "_before", "_row")
    )


def hash_rank_within(
    df: DataFrame,
    group: str,
    hash_column: str,
    ties: list[str],
    name: str = "hash_no",
    size: str = "group_size",
    large: int = LARGE_GROUP_ROWS,
) -> DataFrame:
    """Position by hash inside each group, plus the group size.

    Groups are usually one bucket. A group above ``large`` rows is cut into hash buckets, each numbered on its own, so no task sorts it whole.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias(size))
    is_large = F.col(size) > large
    bucket = F.when(is_large, F.floor(F.col(hash_column) / (HASH_RANGE // HASH_BUCKETS))).otherwise(0)
    # The explicit repartition matters: the size join leaves rows hashed by group alone, which
    # would also satisfy the window and keep a large group in one partition.
    rows = (
        df.join(sizes.withColumn("_large", is_large), group)
        .withColumn("_bucket", bucket)
        .repartition(group, "_bucket")
    )
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.filter("_large").groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
        .select(group, "_bucket", F.sum("_n").over(before).alias("_before"))
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(hash_column, *ties)
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [group, "_bucket"], "left")
        .withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_row"))
        .drop("_bucket", "_before", "_row", "_large")
    )


CUT_BUCKETS = 4096  # of a value range, counted in one pass


def cut_values(values: DataFrame, positions: list[int]) -> list[tuple[int, int, int]]:
    """(value, smaller, equal) at each 1-based position of the sorted ``values(v long)``, without sorting them.

    Every pass counts the values in the buckets of each position's range and goes on with the bucket that holds the
    position; at most ``CUT_BUCKETS`` counts a position reach the driver, and 64-bit values need six passes.
    """
    low, high = values.agg(F.min("v"), F.max("v")).first()
    ranges = {p: (low, high, 0) for p in positions}  # first and last value, rows before
    found: dict[int, tuple[int, int, int]] = {}
    while ranges:
        width = {p: -(-(b - a + 1) // CUT_BUCKETS) for p, (a, b, _) in ranges.items()}
        spans = F.array(*[
            F.struct(F.lit(p).alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(width[p]).alias("w"))
            for p, (a, b, _) in ranges.items()
        ])
        inside = values.select("v", F.explode(F.filter(spans, lambda x: F.col("v").between(x["a"], x["b"]))).alias("x"))
        counts = inside.groupBy(F.col("x.p").alias("p"), F.expr("(v - x.a) div x.w").alias("bucket")).count().collect()
        for p, (a, b, before) in list(ranges.items()):
            for bucket, n in sorted((r.bucket, r["count"]) for r in counts if r.p == p):
                if before + n >= p:
                    break
                before += n
            start = a + bucket * width[p]
            if width[p] == 1:
                found[p] = (start, before, n)
                del ranges[p]
            else:
                ranges[p] = (start, min(b, start + width[p] - 1), before)
    return [found[p] for p in positions]


def label_by_cuts(df: DataFrame, value: Column, ties: list[str], positions: list[int], name: str) -> DataFrame:
    """Add how many of ``positions`` each row stands behind in the order of ``value``, then ``ties``.

    ``value`` is a long or null (first). Rows between cuts are told by comparison; only rows equal to a cut are numbered.
    """
    least = F.lit(-(2**62))
    rows = df.withColumn("_v", F.coalesce(value, least))
    if not positions:
        return rows.withColumn(name, F.lit(0)).drop("_v")
    cuts = cut_values(rows.select(F.col("_v").alias("v")), positions)
    behind = sum(((F.col("_v") > F.lit(v)).cast("int") for v, *_ in cuts), F.lit(0))
    met = sorted({(v, smaller, equal) for v, smaller, equal in cuts})
    apart = rows.filter(~F.col("_v").isin([v for v, *_ in met])).withColumn(name, behind)
    numbered = sort_rank(rows.filter(F.col("_v").isin([v for v, *_ in met])), [F.col(c) for c in ("_v", *ties)], "_no")
    earlier, shift = 0, F.lit(0)
    for v, smaller, equal in met:  # from the place among these rows to the place among all
        shift = F.when(F.col("_v") == F.lit(v), F.lit(smaller - earlier)).otherwise(shift)
        earlier += equal
    place = F.col("_no") + shift
    there = numbered.withColumn(name, sum(((place > F.lit(p)).cast("int") for p in positions), F.lit(0))).drop("_no")
    return apart.unionByName(there).drop("_v")
