"""Parameter search kept as tables: sampled trials, objectives, pruning, best and importance."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.hashing import uniform
from rankweave.operators import als, biases, metrics, pairwise, sgd
from rankweave.operators.model import FactorModel
from rankweave.plans import evaluate
from rankweave.session import fresh_path, remove_path

# The explicit and the implicit search space, and the default trial.
# (name, kind, low, high, step) or (name, "choice", options)
EXPLICIT_SPACE = [
    ("n_factors", "int", 10, 200, 10),
    ("n_epochs", "int", 10, 50, 1),
    ("learning_rate", "log", 1e-4, 1e-1),
    ("regularization", "log", 1e-4, 1e-1),
    ("use_biased", "choice", [True, False]),
    ("reg_bu", "log", 1e-4, 1e-1),
    ("reg_bi", "log", 1e-4, 1e-1),
]
IMPLICIT_SPACE = [
    ("factors", "int", 10, 200, 10),
    ("iterations", "int", 50, 300, 25),
    ("learning_rate", "log", 1e-4, 1e-1),
    ("regularization", "log", 1e-5, 1e-2),
    ("algorithm", "choice", ["bpr", "als", "lmf"]),
    ("verify_negative_samples", "choice", [True, False]),
]
EXPLICIT_DEFAULTS = {
    "n_factors": 50, "n_epochs": 20, "learning_rate": 0.005, "regularization": 0.02, "use_biased": False,
}
# Parameters that only exist under another one's value.
CONDITIONS = {
    "reg_bu": ("use_biased", True),
    "reg_bi": ("use_biased", True),
    "verify_negative_samples": ("algorithm", "bpr"),
}
SECONDS_BUDGET = 900.0
PARALLEL, TRIAL_BLOCKS = 4, 2  # trials at once, and least blocks of each: trials run side by side instead
# Passes over the positives in a synchronised round: of whole training, and where ``rounds`` cuts it short.
PASSES, SHORT_PASSES = 10, 2


def _draw(entry, seed: int) -> Column:
    name, kind, *rest = entry
    u = uniform(seed, "trial", F.lit(name))
    if kind == "int":
        low, high, step = rest
        return (F.lit(low) + F.floor(u * ((high - low) // step + 1)) * step).cast("int")
    if kind == "log":
        low, high = rest
        return F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))
    options = rest[0]
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(u * len(options)) + 1).cast("int"))


def sample_trials(spark: SparkSession, space: list, n_trials: int = 20, seed: int = 42, defaults: dict | None = None) -> DataFrame:
    """Seeded random search: one row per trial; ``defaults`` takes the place of trial 0."""
    trials = spark.range(n_trials).select(F.col("id").cast("int").alias("trial"))
    for entry in space:
        value = _draw(entry, seed)
        if defaults is not None:
            kept = F.lit(defaults.get(entry[0]))
            value = F.when(F.col("trial") == 0, kept).otherwise(value)
        if entry[0] in CONDITIONS:
            parent, wanted = CONDITIONS[entry[0]]
            value = F.when(F.col(parent) == F.lit(wanted), value)
        trials = trials.withColumn(entry[0], value)
    return trials


def bias_trials(train: DataFrame, validation: DataFrame, trials: DataFrame) -> DataFrame:
    """Objective of the bias part of every explicit trial, all trials in the same passes.

    ``value`` is the negated validation RMSE; ``mae`` and ``n_predictions`` are attributes. A
    trial without biases predicts the mean. Values are kept to 9 places so that such equal trials
    tie. The trial table is bounded by the trial budget, so its rows may visit the driver.
    """
    rows = trials.select("trial", "use_biased", "reg_bu", "reg_bi").orderBy("trial").collect()
    runs = [biases.BiasRun(r.reg_bu or 0.0, r.reg_bi or 0.0, biased=bool(r.use_biased)) for r in rows]
    model = biases.fit_biases(train, runs, iterations=1)
    scored = biases.predict_all_runs(validation.select("user_id", "item_id", "rating"), model)
    columns = []
    for i, row in enumerate(rows):
        error = F.col("rating") - F.element_at("estimates", i + 1)
        columns.append(F.struct(
            F.lit(row.trial).alias("trial"), F.round(-F.sqrt(F.avg(error * error)), 9).alias("value"),
            F.avg(F.abs(error)).alias("mae"), F.count("*").alias("n_predictions"),
        ))
    results = scored.agg(F.array(*columns).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return trials.join(results, "trial")


def _run(trials: DataFrame, objective, attributes: list[str], seconds: float, parallel: int = PARALLEL) -> DataFrame:
    """Evaluate trials, ``parallel`` at a time in trial order, under a hard time budget.

    Adds ``value``, the attributes and ``state``. At the end of the budget the jobs of running trials are cancelled by
    their tags; these trials and those not begun are ``TIMED_OUT``, without a value. The loop is over
    trials, which the trial budget bounds, not over data. Each trial gets a folder of its own, removed after it.
    """
    spark = trials.sparkSession
    context, home = spark.sparkContext, fresh_path(spark, "trials")
    end = time.monotonic() + seconds
    rows = trials.orderBy("trial").collect()

    def attempt(row) -> tuple | None:
        if time.monotonic() >= end:
            return None
        context.addJobTag(f"{home}-{row['trial']}")
        try:
            value, extra = objective(row.asDict(), f"{home}/{row['trial']}")
            return (row["trial"], float(value), *[float(extra[a]) for a in attributes], "COMPLETE")
        finally:
            context.removeJobTag(f"{home}-{row['trial']}")
            remove_path(spark, f"{home}/{row['trial']}")

    pool = ThreadPoolExecutor(parallel)
    try:
        running = {pool.submit(inheritable_thread_target(attempt), row): row["trial"] for row in rows}
        _, late = wait(running, timeout=max(0.0, end - time.monotonic()))
        cut = set(late)
        while late:
            for future in late:
                context.cancelJobsWithTag(f"{home}-{running[future]}")
            _, late = wait(late, timeout=0.2)
    finally:
        pool.shutdown(wait=True, cancel_futures=True)
    results = []
    for future, trial in running.items():
        done = None if future in cut and future.exception() else future.result()
        results.append(done or (trial, None, *[None for _ in attributes], "TIMED_OUT"))
    schema = "trial int, value double, " + ", ".join(f"`{a}` double" for a in attributes) + ", state string"
    return trials.join(spark.createDataFrame(results, schema), "trial")


def tune_explicit(
    train: DataFrame, validation: DataFrame, n_trials: int = 20, seconds: float = SECONDS_BUDGET,
    seed: int = 42, trials: DataFrame | None = None, parallel: int = PARALLEL,
) -> DataFrame:
    """Trial table of the explicit model: maximise ``-RMSE`` on the validation rows.

    Every trial trains by gradient descent with all its parameters.
    """
    if trials is None:
        trials = sample_trials(train.sparkSession, EXPLICIT_SPACE, n_trials, seed, EXPLICIT_DEFAULTS)

    def objective(p: dict, workspace: str):
        model = sgd.fit_sgd(
            train, p["n_factors"], p["n_epochs"], p["learning_rate"], p["regularization"],
            p["use_biased"], p["reg_bu"], p["reg_bi"], seed, passes=PASSES, blocks=TRIAL_BLOCKS, workspace=workspace,
        )
        errors = evaluate.evaluate_ratings(model, validation).first()
        return -errors.rmse, {"mae": errors.mae, "n_predictions": errors.n_predictions}

    return _run(trials, objective, ["mae", "n_predictions"], seconds, parallel)


def fit_implicit(
    positives: DataFrame, universe: DataFrame, p: dict, seed: int = 42, rounds: int | None = None,
    workspace: str | None = None, tolerance: float = 0.0, blocks: int = 8,
) -> FactorModel:
    """Train the implicit model a parameter row names (``bpr``, ``als`` or ``lmf``).

    ``rounds`` bounds the synchronised training rounds. By default an iteration count means
    passes over the positives, ``PASSES`` to a round, and all of them are made; ``tolerance`` ends training once a
    round improves its loss by less than that share.
    """
    if p["algorithm"] == "als":
        return als.fit_implicit_als(
            positives, universe, p["factors"], rounds or p["iterations"], p["regularization"], seed=seed
        )
    passes = PASSES if rounds is None else SHORT_PASSES
    settings = pairwise.PairwiseSettings(
        loss="logistic" if p["algorithm"] == "lmf" else "bpr",
        factors=p["factors"], rounds=rounds or max(1, p["iterations"] // passes), passes=passes,
        learning_rate=p["learning_rate"], user_reg=p["regularization"], item_reg=p["regularization"],
        verify_negatives=bool(p.get("verify_negative_samples", True)), seed=seed, tolerance=tolerance, blocks=blocks,
    )
    return pairwise.fit_pairwise(positives, universe, settings, workspace)


def tune_implicit(
    train_positives: DataFrame, validation_positives: DataFrame, universe: DataFrame,
    n_trials: int = 20, seconds: float = SECONDS_BUDGET, seed: int = 42,
    trials: DataFrame | None = None, rounds: int | None = None, parallel: int = PARALLEL,
) -> DataFrame:
    """Trial table of the implicit model: maximise precision@10; diversity is not computed."""
    if trials is None:
        trials = sample_trials(train_positives.sparkSession, IMPLICIT_SPACE, n_trials, seed)
    if rounds is not None:  # the table says what is run
        trials = trials.withColumn("iterations", F.when(F.col("algorithm") == "als", rounds).otherwise(rounds * SHORT_PASSES))

    def objective(p: dict, workspace: str):
        model = fit_implicit(train_positives, universe, p, seed, rounds, workspace, blocks=TRIAL_BLOCKS)
        rows = evaluate.evaluate_ranking(
            model, train_positives, validation_positives, universe, ks=[10], diversity=False
        ).collect()
        found = {(r.metric, r.k): r.value for r in rows}
        return found["precision", 10], {
            "recall@10": found["recall", 10], "ndcg@10": found["ndcg", 10], "coverage": found["coverage", None]
        }

    return _run(trials, objective, ["recall@10", "ndcg@10", "coverage"], seconds, parallel)


def prune_trials(trials: DataFrame, percentile: float = 25.0, startup: int = 5) -> DataFrame:
    """Add ``state``: ``PRUNED`` when a value is under the top-``percentile`` cut of the completed
    trials before it, else ``COMPLETE``. The first ``startup`` completed trials are never cut. Trials without a value
    keep being ``TIMED_OUT`` and count for nothing.

    Whether a trial counts depends on all earlier decisions, so the decisions fold over the
    ordered trials inside one row; the trial budget bounds it.
    """
    share = 1.0 - percentile / 100.0

    def quantile(values: Column) -> Column:
        ordered = F.array_sort(values)
        place = (F.size(values) - 1) * F.lit(share)
        low = F.floor(place).cast("int")
        high = F.least(low + 1, F.size(values) - 1)
        bottom = F.element_at(ordered, low + 1)
        return bottom + (F.element_at(ordered, high + 1) - bottom) * (place - low)

    def decide(acc: Column, t: Column) -> Column:
        cut = F.when(F.size(acc.done) < F.lit(max(startup, 1)), F.lit(False)).otherwise(t.value < quantile(acc.done))
        return F.struct(
            F.when(cut, acc.done).otherwise(F.concat(acc.done, F.array(t.value))).alias("done"),
            F.concat(
                acc.out,
                F.array(F.struct(t.trial.alias("trial"), F.when(cut, "PRUNED").otherwise("COMPLETE").alias("state"))),
            ).alias("out"),
        )

    start = F.struct(
        F.array().cast("array<double>").alias("done"),
        F.array().cast("array<struct<trial:int,state:string>>").alias("out"),
    )
    trials = trials.drop("state")
    ordered = trials.filter("value IS NOT NULL").agg(F.array_sort(F.collect_list(F.struct("trial", F.col("value").cast("double").alias("value")))).alias("t"))
    states = ordered.select(F.explode(F.aggregate("t", start, decide, lambda acc: acc.out)).alias("s")).select("s.*")
    return trials.join(states, "trial", "left").withColumn("state", F.coalesce("state", F.lit("TIMED_OUT")))


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the highest value, the earliest on a tie, as one row."""
    columns = [c for c in trials.columns if c not in ("trial", "value")]
    winner = F.max_by(F.struct("trial", "value", *columns), F.struct("value", -F.col("trial"))).alias("best")
    return trials.agg(winner).select("best.*")


def merge_explicit_parameters(best: DataFrame) -> DataFrame:
    """Best trial as model settings: ``use_biased`` becomes the model's ``biased``."""
    return best.drop("trial", "value").withColumnRenamed("use_biased", "biased")


def parameter_importance(trials: DataFrame, parameters: list[str], seed: int = 42) -> DataFrame:
    """Share of each parameter in explaining the objective, by a random forest on the trials with a value.

    Without such a trial all shares are zero.
    """
    trials = trials.filter("value IS NOT NULL")
    schema = "parameter string, importance double"
    if trials.isEmpty():
        return trials.sparkSession.createDataFrame([(p, 0.0) for p in parameters], schema)
    words = [p for p in parameters if trials.schema[p].dataType.simpleString() == "string"]
    table = trials.withColumn("label", F.col("value"))
    for word in words:
        coded = StringIndexer(inputCol=word, outputCol="_code", handleInvalid="keep").fit(table).transform(table)
        table = coded.drop(word).withColumnRenamed("_code", word)
    table = table.select(*[F.coalesce(F.col(p).cast("double"), F.lit(0.0)).alias(p) for p in parameters], "label")
    features = VectorAssembler(inputCols=parameters, outputCol="features").transform(table)
    model = RandomForestRegressor(numTrees=50, seed=seed).fit(features)
    rows = [(p, float(v)) for p, v in zip(parameters, model.featureImportances.toArray())]
    return trials.sparkSession.createDataFrame(rows, schema)
