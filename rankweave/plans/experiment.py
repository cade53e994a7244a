"""The whole experiment: split, tune, train, evaluate, report."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators import als, pairwise, prep, sgd, topk
from rankweave.operators.model import FactorModel
from rankweave.plans import evaluate, search
from rankweave.plans.config import settings
from rankweave.session import cut_lineage, fresh_path, write_and_read
from rankweave.sources import sinks


def split_ratings(ratings: DataFrame, data: dict) -> tuple[DataFrame, DataFrame]:
    """Train and test by the configured rule, from one stored tagged table."""
    if data["temporal_split"]:
        tagged = prep.temporal_tag(ratings, data["test_size"])
    elif data["stratified_split"]:
        tagged = prep.stratified_tag(ratings, data["test_size"], data["random_state"])
    else:
        tagged = prep.holdout_tag(ratings, data["test_size"], data["random_state"])
    stored = write_and_read(tagged, fresh_path(ratings.sparkSession, "split"))
    train = stored.filter(~F.col("is_test")).drop("is_test")
    test = stored.filter("is_test").drop("is_test")
    if data["min_train_items"]:
        train = prep.min_items_per_user(train, data["min_train_items"])
    return train, test


def fit_pmf(train: DataFrame, p: dict) -> FactorModel:
    """``svd`` by gradient descent, so that the learning rate counts; ``nmf`` by alternating least squares."""
    if p["algorithm"] == "svd":
        return sgd.fit_sgd(
            train, p["n_factors"], p["n_epochs"], p["learning_rate"], p["regularization"], p["biased"],
            p.get("reg_bu"), p.get("reg_bi"), p["random_state"],
        )
    return als.fit_explicit(
        train, n_factors=p["n_factors"], n_epochs=p["n_epochs"], regularization=p["regularization"],
        biased=p["biased"], algorithm=p["algorithm"], reg_pu=p["reg_pu"], reg_qi=p["reg_qi"],
        reg_bu=p.get("reg_bu"), reg_bi=p.get("reg_bi"), seed=p["random_state"],
    )


def fit_hybrid(
    positives: DataFrame, features: DataFrame, p: dict, rounds: int | None = None, universe: DataFrame | None = None,
    tolerance: float = 0.0,
) -> FactorModel:
    passes = search.PASSES if rounds is None else search.SHORT_PASSES
    return pairwise.fit_hybrid(positives, features, pairwise.PairwiseSettings(
        loss=p["loss"], factors=p["no_components"], rounds=rounds or max(1, p["epochs"] // passes), passes=passes,
        learning_rate=p["learning_rate"], user_reg=p["user_alpha"], item_reg=p["item_alpha"],
        max_sampled=p["max_sampled"], seed=p["random_state"], tolerance=tolerance,
    ), universe=universe)


def report_row(name: str, metrics: DataFrame, model: FactorModel) -> DataFrame:
    """``(model, metrics map, info map, size struct)``."""
    label = F.when(F.col("k").isNull(), F.col("metric")).otherwise(F.concat_ws("@", "metric", F.col("k").cast("string")))
    pairs = F.map_from_entries(F.collect_list(F.struct(label.alias("key"), F.col("value"))))
    size = model.size().select(F.struct("*")).scalar()
    info = [x for k, v in model.info.items() if not isinstance(v, list) for x in (F.lit(k), F.lit(str(v)))]
    return metrics.agg(pairs.alias("metrics")).select(
        F.lit(name).alias("model"), "metrics", F.create_map(*info).alias("model_info"), size.alias("model_size")
    )


def error_rows(errors: DataFrame) -> DataFrame:
    names = errors.columns
    cells = [
        F.struct(F.lit(c).alias("metric"), F.lit(None).cast("int").alias("k"), F.col(c).cast("double").alias("value"))
        for c in names
    ]
    return errors.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def run_experiment(
    ratings: DataFrame, item_features: DataFrame, overrides: dict | None = None, out: str | None = None,
    rounds: int | None = None,
) -> DataFrame:
    """Run every configured step and return one report row per model; write outputs under ``out``.

    ``rounds`` shortens the iterative implicit training.
    """
    start = time.time()
    config = settings(overrides)
    data, models, evaluation = config["data"], config["models"], config["evaluation"]
    threshold = data["min_rating_threshold"]
    train, test = split_ratings(ratings, data)
    universe = ratings.select("user_id", "item_id")  # filters on users drop no item and no user from it
    positives, truth = prep.to_implicit(train, threshold), prep.to_implicit(test, threshold)

    if config["optimization"]["run_optimization"]:
        budget = config["optimization"]
        parts = zip(prep.validation_split(train), ("fit", "held"))
        fit, held = (write_and_read(df, fresh_path(ratings.sparkSession, name)) for df, name in parts)
        explicit = search.tune_explicit(fit, held, budget["n_trials"], budget["timeout"])
        implicit = search.tune_implicit(
            prep.to_implicit(fit, threshold), prep.to_implicit(held, threshold), universe,
            budget["n_trials"], budget["timeout"], rounds=rounds,
        )
        for name, trials, space in (("pmf", explicit, search.EXPLICIT_SPACE), ("bpr", implicit, search.IMPLICIT_SPACE)):
            trials = cut_lineage(search.prune_trials(trials) if name == "bpr" else trials)
            best = search.best_trial(trials)
            merged = search.merge_explicit_parameters(best) if name == "pmf" else best
            row = merged.first().asDict()
            known = {"reg_bu", "reg_bi", "biased", *(entry[0] for entry in space)}
            models[name].update({k: v for k, v in row.items() if k in known and v is not None})
            if out:
                sinks.write_best_parameters(best, f"{out}/optimization", name)
                sinks.write_trials(trials, f"{out}/optimization", name)
                sinks.write_importance(
                    search.parameter_importance(trials, [e[0] for e in space]), f"{out}/optimization", name
                )

    fitted = {"pmf": fit_pmf(train, models["pmf"])}
    implicit_rows = positives
    if data["use_confidence_weights"] and models["bpr"]["algorithm"] == "als":
        liked = train.filter(F.col("rating") >= threshold)
        implicit_rows = prep.confidence_weights(liked).withColumnRenamed("confidence", "weight")
    fitted["bpr"] = search.fit_implicit(
        implicit_rows, universe, models["bpr"], rounds=rounds, tolerance=config["optimization"]["tolerance"]
    )
    if config["optimization"]["run_lightfm"]:
        fitted["lightfm"] = fit_hybrid(
            positives, item_features, models["lightfm"], rounds, universe, config["optimization"]["tolerance"]
        )

    reports = {"pmf": error_rows(_judge_ratings(fitted["pmf"], train, test, evaluation["calc_confidence"]))}
    for name in [n for n in fitted if n != "pmf"]:
        reports[name] = evaluate.evaluate_ranking(
            fitted[name], positives, truth, universe, evaluation["k_values"], evaluation["max_eval_users"],
            evaluation["calc_diversity"], data["random_state"],
        )
    rows = [report_row(name, metrics, fitted[name]) for name, metrics in reports.items()]
    judged = cut_lineage(reduce(DataFrame.unionByName, rows))
    report = judged.withColumn("total_execution_time", F.lit(time.time() - start))

    if out:
        sinks.write_report(report, f"{out}/metrics")
        _write_extras(config, fitted, train, test, positives, truth, out)
    return report


def _judge_ratings(model: FactorModel, train: DataFrame, test: DataFrame, confidence: bool) -> DataFrame:
    """Rating errors; with ``confidence`` also how often the interval of 1.96 training errors holds the rating."""
    if not confidence:
        return evaluate.evaluate_ratings(model, test)
    spread = 1.96 * (evaluate.evaluate_ratings(model, train).first().rmse or 0.0)
    bounds = model.predict(test, "_middle").withColumns(
        {"lower": F.col("_middle") - spread, "upper": F.col("_middle") + spread}
    )
    return evaluate.evaluate_ratings(model, bounds.drop("_middle"), "lower", "upper")


def _write_extras(config, fitted, train, test, positives, truth, out) -> None:
    """Optional outputs: models, predictions, ensemble lists, folds and time windows."""
    evaluation, advanced = config["evaluation"], config["advanced"]
    n = max(evaluation["k_values"])
    users = prep.evaluation_users(truth, evaluation["max_eval_users"])
    if config["output"]["save_models"]:
        for name, model in fitted.items():
            model.save(f"{out}/models/{name}")
    if config["output"]["save_predictions"]:
        scored = [
            model.predict(test.select("user_id", "item_id"), "prediction").withColumn("model", F.lit(name))
            for name, model in fitted.items()
        ]
        sinks.write_predictions(reduce(DataFrame.unionByName, scored), f"{out}/predictions")
    if advanced["ensemble"]["enabled"]:
        blend = advanced["ensemble"]
        if blend["method"] != "weighted":
            raise ValueError(f"unknown ensemble method {blend['method']}")
        one, two = (fitted[m] for m in blend["models"])
        sides = [(m.users.withColumn("bias", F.col("bias") + F.lit(m.offset)), m.items) for m in (one, two)]
        lists = topk.blended_topk(*sides, users, positives, n, tuple(blend["weights"]))
        lists.write.mode("overwrite").parquet(f"{out}/ensemble")
    if advanced["cross_validation"]["enabled"]:
        folds = evaluate.cross_validate(
            train, lambda part: fit_pmf(part, config["models"]["pmf"]), advanced["cross_validation"]["n_folds"]
        )
        folds.write.mode("overwrite").json(f"{out}/cross_validation")
    if advanced["time_based_evaluation"]["enabled"]:
        windows = evaluate.evaluate_time_windows(fitted["pmf"], test, advanced["time_based_evaluation"]["n_windows"])
        windows.write.mode("overwrite").json(f"{out}/time_windows")
