"""Explicit factors by stochastic gradient descent on the rotation of user and item blocks."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators import stats
from rankweave.operators.model import FactorModel
from rankweave.operators.rotation import Rotation, RotationSettings

START_DEVIATION = 0.1  # of the start values


def explicit_settings(
    n_factors: int = 50, n_epochs: int = 20, learning_rate: float = 0.005, regularization: float = 0.02, biased: bool = False,
    reg_bu: float | None = None, reg_bi: float | None = None, seed: int = 42, mean: float = 0.0, passes: int = 1, blocks: int = 8,
) -> RotationSettings:
    """``n_epochs`` passes over the ratings, ``passes`` of them each time two blocks meet."""
    return RotationSettings(
        loss="squared", factors=n_factors, rounds=max(1, math.ceil(n_epochs / passes)), passes=min(passes, n_epochs),
        learning_rate=learning_rate, user_reg=regularization, item_reg=regularization, user_bias_reg=reg_bu,
        item_bias_reg=reg_bi, batch=256, seed=seed, spread=START_DEVIATION * math.sqrt(12), offset=mean if biased else 0.0, biased=biased,
        blocks=blocks,
    )


def fit_sgd(
    ratings: DataFrame, n_factors: int = 50, n_epochs: int = 20, learning_rate: float = 0.005, regularization: float = 0.02,
    biased: bool = False, reg_bu: float | None = None, reg_bi: float | None = None, seed: int = 42, passes: int = 5,
    blocks: int = 8, workspace: str | None = None,
) -> FactorModel:
    """Probabilistic matrix factorisation with squared loss; ``biased`` trains mean, biases and factors together.

    ``ratings(user_id, item_id, rating)`` holds each pair once. No ratings give no factors.
    """
    start = time.time()
    info = stats.rating_profile(ratings).first().asDict()
    mean = info["global_mean"] or 0.0
    s = explicit_settings(
        n_factors, n_epochs, learning_rate, regularization, biased, reg_bu, reg_bi, seed, mean, passes, blocks
    )
    run = Rotation(ratings.select("user_id", "item_id", F.col("rating").cast("double").alias("value")), ratings, s, home=workspace)
    run.run()
    info |= {"training_time": time.time() - start, "losses": run.losses}
    return FactorModel(
        run.users(), run.features().withColumnRenamed("feature_id", "item_id"), "svd", explicit=True, biased=biased,
        offset=mean if biased else 0.0, fallback=mean, info=info,
    )
