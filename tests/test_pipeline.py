"""Readers, writers and the whole experiment, written to a scratch folder and read back."""

import json

from planted import planted_ratings
from pyspark.sql import functions as F

from rankweave.plans.config import settings
from rankweave.plans.experiment import run_experiment
from rankweave.sources import movielens, sinks


def test_movielens_files(spark, tmp_path):
    (tmp_path / "u.data").write_text("1\t2\t3\t881250949\n4\t5\t1\t881250950\n")
    flags = ["0"] * 19
    flags[1] = flags[5] = "1"
    line = "|".join(["2", "Caf\xe9 (1990)", "01-Jan-1990", "", "http://x"] + flags)
    (tmp_path / "u.item").write_bytes((line + "\n").encode("latin-1"))
    ratings = movielens.read_ratings(spark, str(tmp_path / "u.data"))
    assert ratings.dtypes == [("user_id", "bigint"), ("item_id", "bigint"), ("rating", "double"), ("ts", "timestamp")]
    assert ratings.count() == 2
    items = movielens.read_items(spark, str(tmp_path / "u.item"))
    assert items.first().title == "Caf\xe9 (1990)"
    assert {r.feature for r in movielens.genre_features(items).collect()} == {"genre=Action", "genre=Comedy"}


def test_trials_csv_flattens_nested_columns(spark, tmp_path):
    trials = spark.range(2).select(
        F.col("id").alias("trial"), F.create_map(F.lit("lr"), F.lit("0.1")).alias("params"), F.lit(0.5).alias("value")
    )
    sinks.write_trials(trials, str(tmp_path), "pmf")
    back = spark.read.option("header", True).csv(str(tmp_path / "pmf_trials"))
    assert json.loads(back.first().params) == {"lr": "0.1"}


def test_settings_reject_unknown_keys():
    import pytest

    with pytest.raises(KeyError):
        settings({"data": {"nope": 1}})
    assert settings({"data": {"test_size": 0.3}})["data"]["test_size"] == 0.3


def test_experiment_end_to_end(spark, tmp_path):
    ratings = planted_ratings(spark, 120, 80)
    features = ratings.select("item_id").distinct().select(
        "item_id", F.concat(F.lit("g="), (F.col("item_id") % 5).cast("string")).alias("feature"), F.lit(1.0).alias("value")
    )
    overrides = {
        "models": {
            "pmf": {"n_factors": 4, "n_epochs": 3, "regularization": 0.1},
            "bpr": {"factors": 4}, "lightfm": {"no_components": 4},
        },
        "optimization": {"n_trials": 1},
        "output": {"save_predictions": True},
        "evaluation": {"calc_confidence": True},
        "advanced": {
            "ensemble": {"enabled": True}, "cross_validation": {"enabled": True, "n_folds": 2},
            "time_based_evaluation": {"enabled": True},
        },
    }
    out = str(tmp_path / "run")
    report = {r.model: r for r in run_experiment(ratings, features, overrides, out, rounds=1).collect()}
    assert set(report) == {"pmf", "bpr", "lightfm"}
    assert {"rmse", "mae", "mse", "n_predictions", "confidence_coverage"} <= set(report["pmf"].metrics)
    assert 0 < report["pmf"].metrics["confidence_coverage"] <= 1
    assert {"precision@10", "map@20", "coverage", "diversity", "novelty"} <= set(report["bpr"].metrics)
    assert report["lightfm"].model_info["loss"] == "warp"
    assert report["pmf"].model_size.total_parameters > 0
    assert spark.read.json(f"{out}/metrics").count() == 3
    for model in ("pmf", "bpr"):
        assert spark.read.json(f"{out}/optimization/{model}_best_params").count() == 1
        assert spark.read.option("header", True).csv(f"{out}/optimization/{model}_trials").count() == 1
        assert spark.read.json(f"{out}/optimization/{model}_param_importance").count() > 0
    predictions = spark.read.parquet(f"{out}/predictions")
    assert {r.model for r in predictions.select("model").distinct().collect()} == {"pmf", "bpr", "lightfm"}
    assert spark.read.parquet(f"{out}/models/bpr/users").count() > 0
    assert spark.read.json(f"{out}/cross_validation").count() == 2
    assert spark.read.json(f"{out}/time_windows").count() == 5
    assert spark.read.parquet(f"{out}/ensemble").count() > 0
