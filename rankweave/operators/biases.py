"""Damped user and item biases by alternating group-bys, for one or several runs at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.prep import clip_to_scale


@dataclass(frozen=True)
class BiasRun:
    """One fit: its damping, the rows it trains on, and whether it has biases beyond the mean."""

    reg_user: float = 0.0
    reg_item: float = 0.0
    member: Column | None = None
    biased: bool = True


@dataclass(frozen=True)
class BiasModel:
    """``means`` per run; ``users`` and ``items`` hold ``(id, biases)``, one array entry per run."""

    means: list[float]
    users: DataFrame
    items: DataFrame

    def single(self) -> tuple[DataFrame, DataFrame]:
        """Bias tables of the first run, as ``(id, bias)``."""
        first = F.element_at("biases", 1).alias("bias")
        return self.users.select("user_id", first), self.items.select("item_id", first)


def fit_biases(rows: DataFrame, runs: list[BiasRun], iterations: int = 2) -> BiasModel:
    """Fit ``mean + b_user + b_item`` for every run (fold, trial) in the same passes.

    Runs are columns, not copies of the rows: each half-step is one join and one group-by with a
    pair of sums per run. It joins on one id and groups on the other, so a hot id is split by the
    skew join and its rows are combined before the next shuffle.
    """
    def mine(run: BiasRun, value: Column) -> Column:
        return value if run.member is None else F.when(run.member, value)

    averages = rows.agg(*[F.avg(mine(run, F.col("rating"))).alias(f"m{i}") for i, run in enumerate(runs)]).first()
    means = [float(m) if m is not None else 0.0 for m in averages]

    def step(known: DataFrame | None, on: str, to: str, damping: str) -> DataFrame:
        left = rows if known is None else rows.join(known.withColumnRenamed("biases", "_known"), on)
        biases = []
        for i, run in enumerate(runs):
            residual = F.col("rating") - F.lit(means[i])
            if known is not None:
                residual = residual - F.element_at("_known", i + 1)
            count = F.count(mine(run, F.lit(1)))
            bias = F.sum(mine(run, residual)) / (F.lit(float(getattr(run, damping))) + count)
            biases.append(F.coalesce(bias, F.lit(0.0)) if run.biased else F.lit(0.0))
        return left.groupBy(to).agg(F.array(*biases).alias("biases"))

    users = None
    for _ in range(iterations):
        items = step(users, "user_id", "item_id", "reg_item")
        users = step(items, "item_id", "user_id", "reg_user")
    return BiasModel(means, users, items)


def predict_biases(pairs: DataFrame, model: BiasModel, run: Column | int = 0, clip: bool = True) -> DataFrame:
    """Add ``estimate`` under the given run; an unknown user or item contributes no bias."""
    return _with_estimate(pairs, model, lambda all_runs: F.element_at(all_runs, run + 1), clip, "estimate")


def predict_all_runs(pairs: DataFrame, model: BiasModel, clip: bool = True) -> DataFrame:
    """Add ``estimates``, one entry per run."""
    return _with_estimate(pairs, model, lambda all_runs: all_runs, clip, "estimates")


def _with_estimate(pairs, model, pick, clip, name) -> DataFrame:
    def entry(column: str, i: int) -> Column:
        return F.coalesce(F.element_at(column, i + 1), F.lit(0.0))

    every = [F.lit(m) + entry("_user", i) + entry("_item", i) for i, m in enumerate(model.means)]
    all_runs = F.array(*[clip_to_scale(e) if clip else e for e in every])
    return (
        pairs.join(model.items.withColumnRenamed("biases", "_item"), "item_id", "left")
        .join(model.users.withColumnRenamed("biases", "_user"), "user_id", "left")
        .withColumn(name, pick(all_runs))
        .drop("_item", "_user")
    )
