"""Experiment settings: read on the driver and checked up front."""

from __future__ import annotations

import json
from pathlib import Path

from routeloom.contracts import COUNT, HINTS, ORDINAL, FeatureConfig, ModelCandidate, RoutingPolicy, TrainingConfig, enabled_ids
from routeloom.operators.splitting import check_fractions

#: Settings of the evaluation, and those that may be left out with their values.
EVALUATION = {"probability_bins": COUNT, "timing_warmup_queries": ORDINAL, "timing_queries": ORDINAL, "numeric_threads": COUNT}
EVALUATION_DEFAULTS = {"timing_warmup_queries": 0, "timing_queries": 20, "numeric_threads": 1}


def candidates_of(config: dict) -> tuple[ModelCandidate, ...]:
    return tuple(ModelCandidate(**row) for row in config["models"])


def check_config(config: dict) -> dict:
    """``config`` itself, if all of it is valid."""
    active = set(enabled_ids(candidates_of(config)))
    FeatureConfig(**config["features"])
    TrainingConfig(**config["training"])
    RoutingPolicy(**config["policy"])
    if set(config["rules"]) != set(HINTS):
        raise ValueError(f"rules must cover {', '.join(HINTS)}")
    if not set(config["rules"].values()) <= active:
        raise ValueError("rules name unknown or disabled models")
    if "split" in config:
        check_fractions(config["split"]["train_fraction"], config["split"]["validation_fraction"], config["split"].get("seed", 0))
    if "evaluation" in config:
        given = EVALUATION_DEFAULTS | config["evaluation"]
        for name, domain in EVALUATION.items():
            domain.check(given.get(name), name)
    return config


def read_config(path: str | Path) -> dict:
    return check_config(json.loads(Path(path).read_text(encoding="utf-8")))
