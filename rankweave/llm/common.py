"""Reading the tables, intermediate tables in the shared folder, Arrow passes and linked components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.session import fresh_path, ship_package, write_and_read

SLICE_ROWS = 2048
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and bound Arrow batches: rows hold whole texts."""
    ship_package(spark)
    if not 0 < int(spark.conf.get(_BATCH)) <= SLICE_ROWS:
        spark.conf.set(_BATCH, str(SLICE_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def arrow_pass(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, done: Callable[[], None] | None = None
) -> DataFrame:
    """Apply ``step`` to runs of at most ``SLICE_ROWS`` rows, so its own arrays stay small.

    ``done`` runs at the end of a task, to empty caches: workers live on and serve other stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield step(batch.slice(at, SLICE_ROWS))
            pa.default_memory_pool().release_unused()
        if done:
            done()

    return df.mapInArrow(run, schema)


class Scratch:
    """Tables written below ``spark.checkpoint.dir``; those a result does not read can go early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, fresh_path(spark, name), 0

    def store(self, df: DataFrame) -> DataFrame:
        self.count += 1
        return write_and_read(df, f"{self.root}/{self.count}")

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a stored table that nothing will read again."""
        files = df.inputFiles()[:1]
        if files:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``; the label is the component's smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). A round groups by node and
    keeps one row per edge, so a node with very many edges is aggregated before the shuffle and its
    join is split where it is skewed. Ends when a round changes nothing.
    """

    def star(pairs: DataFrame, both_ways: bool) -> DataFrame:
        around = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else pairs
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        moved = around.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        if both_ways:  # neighbours above the node move to the least
            linked = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            return linked.filter("a <> b").distinct()
        own = least.select("a", F.col("low").alias("b"))
        return moved.unionByName(own).filter("a <> b").distinct()

    def order(pairs: DataFrame) -> DataFrame:
        return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = scratch.store(order(edges))
    seen = None
    while True:
        then = scratch.store(star(order(star(now, both_ways=True)), both_ways=False))
        scratch.drop(now)
        now = then
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
