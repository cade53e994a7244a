"""Sessions for tests and benchmarks, and the shared folder jobs write intermediate tables to."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rankweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a folder of our own only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rankweave-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows live in the shared folder and outlast any executor."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application (needed where it is not installed)."""
    sc = spark.sparkContext
    if getattr(sc, "_rankweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="rankweave-package-")) / "rankweave"
    sc.addPyFile(shutil.make_archive(str(target), "zip", root.parent, root.name))
    sc._rankweave_shipped = True


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables that nothing will read again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def even_labels(spark: SparkSession, n: int) -> list[int]:
    """``n`` int keys that hash partitioning deals into ``n`` different partitions, in order.

    Few heavy groups keyed by them fill ``repartition(n, key)`` with one group a task.
    """
    ids = spark.range(0, 64 * n + 64, 1, 1).select(F.col("id").cast("int").alias("label"))
    rows = ids.groupBy(F.pmod(F.hash("label"), F.lit(n)).alias("part")).agg(F.min("label").alias("label")).collect()
    return [r.label for r in sorted(rows, key=lambda r: r.part)]


def cell_partitions(spark: SparkSession, cells: int) -> int:
    """Partitions for heavy groups: four for each while they are few, never fewer than groups.

    Hashing n groups into n partitions stacks several in one task, and adaptive coalescing
    would merge them because their bytes are few.
    """
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(4 * cells, max(4096, cells, configured)))
