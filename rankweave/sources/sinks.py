"""Writers for reports, trials, models and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_report(report: DataFrame, path: str) -> None:
    """Metric report as JSON rows; one nested row per model."""
    report.write.mode("overwrite").json(path)


def write_best_parameters(best: DataFrame, path: str, model: str) -> None:
    best.write.mode("overwrite").json(f"{path}/{model}_best_params")


def write_trials(trials: DataFrame, path: str, model: str) -> None:
    """Trial table as CSV with a header; nested columns become JSON text."""
    nested = (T.MapType, T.StructType, T.ArrayType)
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in trials.schema.fields
    ]
    trials.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/{model}_trials")


def write_importance(importance: DataFrame, path: str, model: str) -> None:
    importance.write.mode("overwrite").json(f"{path}/{model}_param_importance")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions of several models, one folder per model."""
    predictions.write.mode("overwrite").partitionBy("model").parquet(path)
