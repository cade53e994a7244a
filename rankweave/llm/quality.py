"""Quality rules: base rules on word counts and repeats, then robust multivariate outliers.

The minimum covariance determinant (Rousseeuw and Van Driessen, 1999) is estimated for every
language and source over all documents that pass the base rules: concentration steps keep the three
quarters of a group nearest to its centre and take their mean and covariance anew. Each step is two
aggregations over a narrow table, so a group of any size is summed before it is shuffled.

A statistic that has (nearly) one value in a group's middle half has no scatter to estimate there, for
example symbols in clean prose: its term of the distance has a fixed standard deviation. All others are
measured by the group's own covariance, scaled to that of a normal population.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import Scratch
from rankweave.llm.kernels import Texts, chain, hash_spans, lines, text_slices, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
# The standard deviation of each transformed statistic in groups where its own is (nearly) zero.
FLOORS = (0.12, 0.05, 0.10, 0.10, 0.06, 0.12)
NEAR_ZERO = 0.1  # share of its floor below which a standard deviation counts as zero
WIDTH = len(FLOORS)
PAIRS = [(i, j) for i in range(WIDTH) for j in range(i, WIDTH)]


def _marks(characters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters.encode())] = True
    return found


_SYMBOLS, _SHOUTS, _UPPER = _marks("#*$%&|<>"), _marks("!?"), _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_BLANK = _marks(" \t\n\x0b\x0c\r")


def _repeats(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: is it equal to an earlier one of its row; is it equal to any other."""
    order = np.lexsort((value, row))  # stable: the earliest comes first
    same = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    later, any_other = np.zeros(len(row), bool), np.zeros(len(row), bool)
    later[order[1:]] = same
    any_other[order[1:]] = same
    any_other[order[:-1]] |= same
    return later, any_other


def _count(texts: Texts) -> np.ndarray:
    """One column for each of COUNTS."""
    found = words(texts)
    n = texts.rows
    code_points = texts.per_row((texts.data & 0xC0) != 0x80)
    split = lines(texts)
    starts = np.searchsorted(found.start, split.start), np.searchsorted(found.start, split.end)
    worded = starts[0] < starts[1]
    line_hash = hash_spans(texts.data, split.start[worded], split.end[worded])
    line_row = split.row[worded]
    again, _ = _repeats(line_row, line_hash)
    window, at = chain(found.hash, found.row, 3)
    _, repeated = _repeats(found.row[at], window)
    covered = np.zeros(len(found.row) + 2, bool)
    for k in range(3):
        covered[at[repeated] + k] = True
    return np.stack([
        np.bincount(found.row, minlength=n),
        code_points - texts.per_row(_BLANK[texts.data]),
        texts.per_row(_SYMBOLS[texts.data]),
        np.bincount(line_row[again], minlength=n),
        np.bincount(found.row[covered[: len(found.row)]], minlength=n),
        np.bincount(line_row, minlength=n),
        texts.per_row(_UPPER[texts.data]),
        texts.per_row(_SHOUTS[texts.data]),
    ])


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in COUNTS]))
def text_counts(text: pa.Array) -> pa.Array:
    parts = [_count(texts) for texts in text_slices(text)]
    table = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in table], list(COUNTS))


def base_failed(stats: Column) -> Column:
    return (stats.n_words < 50) | (100 * stats.n_repeat_words > 50 * stats.n_words)


def transformed(stats: Column) -> Column:
    """The statistics as an array on scales where clean prose is roughly symmetric."""
    per_word = F.greatest(stats.n_words, F.lit(1)).cast("double")
    chars = F.greatest(stats.word_chars, F.lit(1)).cast("double")
    return F.array(
        F.log(chars / per_word),
        F.log1p(stats.n_symbols / per_word),
        stats.n_dup_lines / F.greatest(stats.n_lines, F.lit(8)),
        stats.n_repeat_words / per_word,
        F.sqrt(stats.n_upper / chars),
        F.log1p(stats.n_marks / per_word),
    )


def chi_square_share(x: float, degrees: int) -> float:
    """The share of the distribution below ``x``, from its closed forms."""
    half = x / 2
    if degrees % 2 == 0:
        return 1 - math.exp(-half) * sum(half**k / math.factorial(k) for k in range(degrees // 2))
    terms = sum(half ** (k + 0.5) / math.gamma(k + 1.5) for k in range(degrees // 2))
    return math.erf(math.sqrt(half)) - math.exp(-half) * terms


def chi_square_quantile(share: float, degrees: int = WIDTH) -> float:
    low, high = 0.0, 400.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(middle, degrees) < share else (low, middle)
    return low


def consistency(core: float, degrees: int) -> float:
    """What the covariance of the nearest ``core`` of a normal population is short of the whole's."""
    return core / chi_square_share(chi_square_quantile(core, degrees), degrees + 2)


@dataclass(frozen=True)
class OutlierSettings:
    """``core``: share of a group that the determinant is taken over; ``reject``: share of a normal
    population beyond the distance limit. A group of fewer than ``least`` documents takes its
    language's estimate, and that of all documents if the language has too few."""

    core: float = 0.75
    reject: float = 1e-6
    least: int = 100
    steps: int = 8
    tolerance: float = 1e-3
    broadcast_groups: int = 20_000


def _off(i: int) -> Column:
    return F.col("x")[i] - F.col("centre")[i]


def _estimated() -> Column:
    """Squared Mahalanobis distance of ``x`` over the statistics whose scatter is estimated."""
    return sum(((1 if i == j else 2) * _off(i) * _off(j) * F.col("inverse")[i * WIDTH + j] for i, j in PAIRS), F.lit(0.0))


def _fixed() -> Column:
    """The same over those that have a floor for a standard deviation."""
    return sum(
        (F.when(F.col("still")[i], F.pow(_off(i) / FLOORS[i], 2)).otherwise(F.lit(0.0)) for i in range(WIDTH)), F.lit(0.0)
    )


def _invert(core: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One row per group: covariance of the nearest ``core`` of it to its inverse and log determinant.

    Statistics that were still, or whose variance is (nearly) zero, are still: zero in the inverse.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale = [1.0, *(consistency(core, k) if core < 1 else 1.0 for k in range(1, WIDTH + 1))]
        for frame in frames:
            inverses, stills, log_dets, degrees = [], [], [], []
            for flat, was in zip(frame["cov"], frame["still"]):
                cov = np.zeros((WIDTH, WIDTH))
                for value, (i, j) in zip(flat, PAIRS):
                    cov[i, j] = cov[j, i] = value
                still = np.array(was, bool) | (np.diag(cov) < np.square(NEAR_ZERO * np.array(FLOORS)))
                live = np.flatnonzero(~still)
                part = cov[np.ix_(live, live)] * scale[len(live)]
                part += np.diag(1e-6 * np.diag(part))  # two statistics may be one
                inverse = np.zeros((WIDTH, WIDTH))
                inverse[np.ix_(live, live)] = np.linalg.inv(part)
                inverses.append(inverse.reshape(-1))
                stills.append(still)
                degrees.append(len(live))
                log_dets.append(np.linalg.slogdet(part)[1] + 2 * np.log(np.array(FLOORS)[still]).sum())
            yield pd.DataFrame({
                "grp": frame["grp"], "centre": frame["centre"], "inverse": inverses, "still": stills,
                "degrees": pd.Series(degrees, dtype="int32"), "log_det": pd.Series(log_dets, dtype="float64"),
            })

    return run


_PARAMS = (
    "grp string, centre array<double>, inverse array<double>, still array<boolean>, degrees int, log_det double"
)


class RobustGroups:
    """Centre and scatter of every language and source of ``points(lang, source, x)``."""

    def __init__(self, scratch: Scratch, points: DataFrame, settings: OutlierSettings):
        self.scratch, self.settings = scratch, settings
        sizes = points.groupBy("lang", "source").agg(F.count("*").alias("n"))
        by_lang = sizes.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("n_lang"))
        named = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("l"))).select(
            "lang", "source",
            F.when(F.col("n") >= settings.least, F.to_json(F.array("lang", "source")))
            .when(F.col("n_lang") >= settings.least, F.to_json(F.array("lang")))
            .otherwise("[]").alias("grp"),
        )
        self.names = scratch.store(named)
        self.small = self.names.count() <= settings.broadcast_groups
        self.points = scratch.store(self._named(points).select("grp", "x"))

    def _side(self, df: DataFrame) -> DataFrame:
        """A side of one row per group: broadcast where its counted size allows."""
        return F.broadcast(df) if self.small else df

    def _named(self, points: DataFrame) -> DataFrame:
        names = self._side(self.names.select(F.col("lang").alias("l"), F.col("source").alias("s"), "grp"))
        same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
        known = points.join(names, same, "left").drop("l", "s")
        return known.withColumn("grp", F.coalesce("grp", F.lit("[]")))

    def _placed(self, params: DataFrame) -> DataFrame:
        return self.points.join(self._side(params), "grp")

    def _moments(self, near: DataFrame, core: float) -> DataFrame:
        """Mean and covariance of the rows of ``near(grp, x, centre, still)``, summed about the old centre."""
        sums = near.groupBy("grp").agg(
            F.count("*").alias("n"), F.first("centre").alias("old"), F.first("still").alias("still"),
            *[F.sum(_off(i)).alias(f"s{i}") for i in range(WIDTH)],
            *[F.sum(_off(i) * _off(j)).alias(f"q{i}_{j}") for i, j in PAIRS],
        )
        mean = [F.col(f"s{i}") / F.col("n") for i in range(WIDTH)]
        flat = sums.select(
            "grp", "still",
            F.array(*[F.col("old")[i] + mean[i] for i in range(WIDTH)]).alias("centre"),
            F.array(*[F.col(f"q{i}_{j}") / F.col("n") - mean[i] * mean[j] for i, j in PAIRS]).alias("cov"),
        )
        return self.scratch.store(flat.mapInPandas(_invert(core), _PARAMS))

    def _start(self) -> DataFrame:
        """Medians and quartile ranges, coordinate by coordinate."""
        cuts = self.points.groupBy("grp").agg(
            *[F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 1000).alias(f"c{i}") for i in range(WIDTH)]
        )
        spread = lambda i: F.pow((F.col(f"c{i}")[2] - F.col(f"c{i}")[0]) / 1.349, 2)
        flat = cuts.select(
            "grp",
            F.array(*[F.col(f"c{i}")[1] for i in range(WIDTH)]).alias("centre"),
            F.array(*[spread(i) if i == j else F.lit(0.0) for i, j in PAIRS]).alias("cov"),
            F.array(*[F.lit(False)] * WIDTH).alias("still"),
        )
        return self.scratch.store(flat.mapInPandas(_invert(1.0), _PARAMS))

    def _scaled(self, params: DataFrame) -> DataFrame:
        """``params`` with the factor that makes the core's distance limit that of a normal population."""
        core = self.settings.core
        cut = self._placed(params).groupBy("grp").agg(
            F.percentile_approx(_estimated(), core, 10_000).alias("limit")
        )
        limits = F.array(*[F.lit(chi_square_quantile(core, k) if k else 0.0) for k in range(WIDTH + 1)])
        factor = F.when(F.col("limit") > 1e-9, limits[F.col("degrees")] / F.col("limit")).otherwise(F.lit(1.0))
        return params.join(self._side(cut), "grp").withColumn("factor", factor)

    def fit(self) -> DataFrame:
        """grp, centre, inverse, still, factor."""
        core, params, before = self.settings.core, self._start(), None
        for _ in range(self.settings.steps):
            cut = self._placed(params).groupBy("grp").agg(
                F.percentile_approx(_estimated() + _fixed(), core, 10_000).alias("limit")
            )
            limited = self.scratch.store(params.join(self._side(cut), "grp"))
            params = self._moments(self._placed(limited).filter(_estimated() + _fixed() <= F.col("limit")), core)
            volume = params.agg(F.sum("log_det"), F.count("*")).first()
            if before is not None and abs(volume[0] - before) <= self.settings.tolerance * volume[1]:
                break
            if volume[0] is None:
                break
            before = volume[0]
        # The customary reweighting: all rows but the outlying fortieth of a normal population.
        scaled = self.scratch.store(self._scaled(params))
        inside = self._placed(scaled).filter(scaled_distance() <= chi_square_quantile(0.975))
        return self.scratch.store(self._scaled(self._moments(inside, 1.0)))


def scaled_distance() -> Column:
    return _estimated() * F.col("factor") + _fixed()


def judge(docs: DataFrame, settings: OutlierSettings = OutlierSettings()) -> DataFrame:
    """Every row of ``docs(text, lang, source, ...)`` as ``doc`` with stats, base_failed, distance, kept.

    ``distance`` is the scaled squared Mahalanobis distance under the row's group; a row is kept if
    it passes the base rules and lies within the limit. Null text counts as empty, null languages
    and sources are groups of their own, an empty table gives no rows. Equal rows get equal
    verdicts; the counts cover whole texts of any length.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(
        F.struct("*").alias("doc"), F.col("lang").alias("lang"), F.col("source").alias("source"),
        text_counts(F.col("text")).alias("stats"),
    )
    rows = rows.withColumn("base_failed", base_failed(F.col("stats"))).withColumn("x", transformed(F.col("stats")))
    points = scratch.store(rows.filter("not base_failed").select("lang", "source", "x"))
    groups = RobustGroups(scratch, points, settings)
    fitted = groups.fit()
    placed = groups._named(rows).join(groups._side(fitted), "grp", "left")
    distance = F.coalesce(scaled_distance(), F.lit(0.0))
    limit = chi_square_quantile(1 - settings.reject)
    return placed.select(
        "doc", "stats", "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & (distance <= limit)).alias("kept"),
    )


def keep_good(docs: DataFrame, settings: OutlierSettings = OutlierSettings()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return judge(docs, settings).filter("kept").select("doc.*")
