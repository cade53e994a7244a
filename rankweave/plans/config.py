"""Experiment settings as nested dictionaries."""

from __future__ import annotations

from copy import deepcopy

# The default experiment.
DEFAULTS = {
    "data": {
        "test_size": 0.2,
        "min_rating_threshold": 3.0,
        "temporal_split": False,
        "stratified_split": False,
        "min_train_items": 5,
        "use_confidence_weights": False,
        "random_state": 42,
    },
    "models": {
        "pmf": {
            "algorithm": "svd",
            "n_factors": 50,
            "n_epochs": 20,
            "learning_rate": 0.005,
            "regularization": 0.02,
            "biased": False,
            "reg_pu": None,
            "reg_qi": None,
            "random_state": 42,
        },
        "bpr": {
            "algorithm": "bpr",
            "factors": 100,
            "iterations": 1000,
            "learning_rate": 0.01,
            "regularization": 5.0e-4,
            "random_state": 42,
            "verify_negative_samples": False,
        },
        "lightfm": {
            "no_components": 100,
            "learning_rate": 0.01,
            "loss": "warp",
            "max_sampled": 10,
            "item_alpha": 1.0e-6,
            "user_alpha": 1.0e-6,
            "epochs": 50,
            "random_state": 42,
        },
    },
    "optimization": {"run_optimization": True, "run_lightfm": True, "n_trials": 20, "timeout": 900, "tolerance": 0.0},
    "evaluation": {"k_values": [5, 10, 20], "max_eval_users": None, "calc_diversity": True, "calc_confidence": False},
    "output": {"save_models": True, "save_predictions": False},
    "advanced": {
        "ensemble": {"enabled": False, "models": ["pmf", "bpr"], "method": "weighted", "weights": [0.5, 0.5]},
        "cross_validation": {"enabled": False, "n_folds": 5},
        "time_based_evaluation": {"enabled": False, "n_windows": 5},
    },
}


def settings(overrides: dict | None = None) -> dict:
    """The defaults with ``overrides`` merged in, level by level; unknown keys are rejected."""
    def merge(base: dict, extra: dict, where: str) -> dict:
        for key, value in extra.items():
            if key not in base:
                raise KeyError(f"unknown setting {where}{key}")
            if isinstance(base[key], dict):
                merge(base[key], value, f"{where}{key}.")
            else:
                base[key] = value
        return base

    return merge(deepcopy(DEFAULTS), overrides or {}, "")
