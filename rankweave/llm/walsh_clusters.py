"""Centroid clustering of integer vectors, with assignment by a progressive Walsh-Hadamard search.

A Walsh-Hadamard transform H of 64 components is exact on integers and keeps distances up to a
constant: |Hx - Hc|^2 = 64 |x - c|^2. Vectors and centroids are transformed once, coefficients are
ordered by sequency, coarse patterns first, and squared differences are accumulated group by group.
A partial sum can only grow, so a centroid whose partial sum already exceeds a centroid's full sum is
strictly farther and is dropped; ties are never dropped. What is left is summed over all 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 64
STEPS = (4, 8, 16, 32, SIZE)  # coefficients summed before each elimination
_LONG = 2**63 - 1
_EXACT = 2**24  # components up to this keep 64 squared differences of coefficients within 64 bits


@dataclass(frozen=True)
class ClusterSettings:
    clusters: int = 16
    rounds: int = 3
    scale: int = 64
    seed: int = 1


def _sequency() -> np.ndarray:
    """The rows of the natural-order transform by their number of sign changes."""
    signs = transform(np.eye(SIZE, dtype=np.int64))
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in natural order."""
    rows, half = len(x), 1
    x = x.copy()
    while half < SIZE:
        pairs = x.reshape(rows, SIZE // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, SIZE)
        half *= 2
    return x


_ORDER = _sequency()


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to each row's nearest centroid (ties: smaller number); pairs finished.

    Integers beyond ``_EXACT`` are summed as unbounded ones.
    """
    widest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if widest > _EXACT:
        x, centroids = x.astype(object), centroids.astype(object)
    spectra, marks = transform(x)[:, _ORDER], transform(centroids)[:, _ORDER]
    rows = np.arange(len(x))
    start = STEPS[0]
    partial = np.stack([((spectra[:, :start] - mark[:start]) ** 2).sum(1) for mark in marks], axis=1)
    likely = partial.argmin(1)
    bound = partial[rows, likely] + ((spectra[:, start:] - marks[likely, start:]) ** 2).sum(1)
    row, centroid = np.nonzero(partial <= bound[:, None])
    total = partial[row, centroid]
    for begin, end in zip(STEPS, STEPS[1:]):
        total = total + ((spectra[row, begin:end] - marks[centroid, begin:end]) ** 2).sum(1)
        open_ = (total <= bound[row]).astype(bool)
        row, centroid, total = row[open_], centroid[open_], total[open_]
    # Pairs are in order of row and number, so the first of a row's least totals is the one.
    first = np.searchsorted(row, rows)
    least = np.minimum.reduceat(total, first) if len(rows) else total[:0]
    at = np.flatnonzero((total == least[row]).astype(bool)) if len(rows) else first
    best = np.full(len(rows), -1)
    best[row[at][::-1]] = centroid[at][::-1]
    return best, least // SIZE, len(row)


def _integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are kept and their integer vectors: ``SIZE`` finite components that fit a long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    long_enough = np.flatnonzero(np.array(column.value_lengths().fill_null(-1)) == SIZE)
    column = column.take(pa.array(long_enough))
    flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        values = np.floor(flat.reshape(-1, SIZE) * scale)
    good = (np.abs(values) < 2.0**62).all(1)  # also false for NaN
    return long_enough[good], values[good].astype(np.int64)


def _sums(centroids: np.ndarray, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: each cluster's count and componentwise sums, as two longs, the upper 32 bits and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        high, low = (np.zeros((len(centroids), SIZE), np.int64) for _ in range(2))
        for batch in batches:
            _, x = _integers(batch.column("embedding"), scale)
            best, _, _ = nearest(x, centroids)
            count += np.bincount(best, minlength=len(centroids))
            np.add.at(high, best, x >> 32)
            np.add.at(low, best, x & 0xFFFFFFFF)
        used = np.flatnonzero(count)
        yield pa.record_batch(
            [
                pa.array(np.repeat(used, SIZE), pa.int64()), pa.array(np.tile(np.arange(SIZE), len(used)), pa.int64()),
                pa.array(np.repeat(count[used], SIZE)), pa.array(high[used].ravel()), pa.array(low[used].ravel()),
            ],
            names=["cluster", "component", "n", "high", "low"],
        )

    return run


def _assigned(centroids: np.ndarray, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = _integers(batch.column("embedding"), scale)
            best, distance, finished = nearest(x, centroids)
            ids = batch.column("vec_id").take(pa.array(kept))
            away = pa.array([int(d) if d <= _LONG else None for d in distance], pa.int64())
            yield pa.record_batch([ids, pa.array(best, pa.int32()), away], names=["vec_id", "cluster", "distance"])

    return run


def _first(vectors: DataFrame, settings: ClusterSettings) -> np.ndarray:
    """The kept vectors with the smallest hashes of their ids; at most ``clusters`` rows reach the driver."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _integers(batch.column("embedding"), settings.scale)
            components = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), SIZE).cast(pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("vec_id").take(pa.array(rows)), components], names=["vec_id", "x"])

    key = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = (
        vectors.mapInArrow(kept, "vec_id long, x array<long>").withColumn("key", key)
        .orderBy(F.asc_nulls_last("key"), "x").limit(settings.clusters).collect()
    )
    return np.array([r.x for r in rows], np.int64).reshape(-1, SIZE)


def cluster(vectors: DataFrame, settings: ClusterSettings = ClusterSettings()) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are the rows of ``vectors(vec_id, embedding)`` whose embedding has 64 components, none null or
    non-finite, with integers ``floor(scale * x)`` below 2**62; a null embedding is not kept. Repeated
    rows each count. Equal hashes of ids order by components, rows without an id come last. Fewer
    kept vectors than ``clusters`` give fewer centroids, an empty table gives no rows; an empty cluster keeps
    its centroid. A distance or sum beyond a long is null. Further columns are not read. Each round
    reads the vectors once and moves one row per task, cluster and component; only centroids
    (``clusters`` x 64 numbers) meet on the driver. Runs jobs when called.
    """
    vectors = vectors.select("vec_id", "embedding")
    centroids = _first(vectors, settings)
    for _ in range(settings.rounds if len(centroids) else 0):
        sums = (
            vectors.mapInArrow(_sums(centroids, settings.scale), "cluster long, component long, n long, high long, low long")
            .groupBy("cluster", "component")
            .agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
        )
        centroids = centroids.copy()
        for row in sums.collect():
            centroids[row.cluster, row.component] = ((int(row.high) << 32) + int(row.low)) // row.n
    if not len(centroids):
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    assigned = vectors.mapInArrow(_assigned(centroids, settings.scale), "vec_id long, cluster int, distance long")
    held = assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"),
        F.max(F.col("distance").isNull()).alias("beyond"),
    ).collect()
    whole = sum(int(r.inertia or 0) for r in held)
    unknown = any(r.beyond for r in held) or whole > _LONG
    fits = lambda r: None if r.beyond or int(r.inertia) > _LONG else int(r.inertia)
    rows = [
        (r.cluster, fits(r), None if unknown else whole,
         hashlib.sha256(",".join(str(int(v)) for v in centroids[r.cluster]).encode()).hexdigest())
        for r in held
    ]
    facts = vectors.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(facts), "cluster").select(  # at most ``clusters`` rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
