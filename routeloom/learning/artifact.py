"""A trained router on disk: one JSON document, whose parts are checked against each other when it is read."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.contracts import FeatureConfig, ModelCandidate, ModelStatistics, RoutingPolicy, TrainingConfig, enabled_ids
from routeloom.learning.features import FeatureModel
from routeloom.learning.predictor import LinearModel, QualityPredictor
from routeloom.operators.baselines import of_decision
from routeloom.operators.routing import route_rows
from routeloom.operators.statistics import estimates_column
from routeloom.sources.config import candidates_of

VERSION = 1


@dataclass(frozen=True)
class RoutingArtifact:
    predictor: QualityPredictor
    statistics: dict[str, ModelStatistics]
    candidates: tuple[ModelCandidate, ...]
    policy: RoutingPolicy
    dataset_manifest: dict
    config: dict
    environment: dict

    def decide(self, requests: DataFrame) -> DataFrame:
        """``requests`` (with a query column) and a decision column: features, K probabilities, route; no shuffle."""
        return decide(requests, self.predictor, self.statistics, self.candidates, self.policy)

    def select(self, requests: DataFrame) -> DataFrame:
        """The artifact as a policy for evaluation."""
        return self.decide(requests).withColumn("selection", of_decision(F.col("decision"))).drop("decision")


def estimates_from_map(probabilities: Column, statistics: dict[str, ModelStatistics], model_ids: list[str]) -> Column:
    return estimates_column({m: probabilities[m] for m in model_ids}, statistics)


def decide(requests: DataFrame, predictor: QualityPredictor, statistics, candidates, policy: RoutingPolicy) -> DataFrame:
    return decide_predicted(predictor.predict(requests, enabled_ids(candidates)), statistics, candidates, policy)


def decide_predicted(predicted: DataFrame, statistics, candidates, policy: RoutingPolicy) -> DataFrame:
    """The same of requests that have their probabilities."""
    scored = predicted.withColumn("estimates", estimates_from_map(F.col("pass_probabilities"), statistics, enabled_ids(candidates)))
    return route_rows(scored, candidates, policy).drop("estimates", "pass_probabilities")


def _write_json(spark: SparkSession, value: dict, path: str) -> None:
    text = json.dumps(value, ensure_ascii=False, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_artifact(spark: SparkSession, artifact: RoutingArtifact, path: str) -> None:
    document = {
        "artifact_version": VERSION,
        "models": {m: asdict(model) for m, model in artifact.predictor.models.items()},
        "features": artifact.predictor.features.to_json(),
        "training": asdict(artifact.predictor.training),
        "training_counts": artifact.predictor.training_counts,
        "statistics": {m: asdict(s) for m, s in artifact.statistics.items()},
        "candidates": [asdict(c) for c in artifact.candidates],
        "policy": asdict(artifact.policy),
        "dataset_manifest": artifact.dataset_manifest,
        "config": artifact.config,
        "environment": artifact.environment,
    }
    _write_json(spark, document, f"{path}/artifact")


def check_document(x: dict) -> None:
    """Every part of an artifact must agree with its configuration; model sets are those of the enabled candidates."""
    if not isinstance(x, dict) or x.get("artifact_version") != VERSION:
        raise ValueError("unsupported routing artifact")
    try:
        policy, training = RoutingPolicy(**x["config"]["policy"]), TrainingConfig(**x["config"]["training"])
        features, candidates = FeatureConfig(**x["config"]["features"]), candidates_of(x["config"])
        held_policy, held_training = RoutingPolicy(**x["policy"]), TrainingConfig(**x["training"])
        held_features = FeatureModel.from_json(x["features"]).config
        held_candidates = tuple(ModelCandidate(**c) for c in x["candidates"])
        statistics = {m: ModelStatistics(**s) for m, s in x["statistics"].items()}
    except (KeyError, TypeError, ValueError) as error:
        raise ValueError(f"artifact holds invalid settings: {error}") from error
    if held_policy != policy:
        raise ValueError("artifact policy differs from its configuration")
    if held_training.quality_score_threshold != training.quality_score_threshold:
        raise ValueError("artifact quality threshold differs from its configuration; train anew")
    if held_training != training:
        raise ValueError("artifact training settings differ from its configuration")
    if held_features != features:
        raise ValueError("artifact feature settings differ from its configuration")
    if held_candidates != candidates:
        raise ValueError("artifact candidates differ from its configuration")
    expected = set(enabled_ids(candidates))
    for what, ids in (("models", set(x["models"])), ("training counts", set(x["training_counts"])), ("statistics", set(statistics))):
        if ids != expected:
            raise ValueError(f"artifact {what} don't match the enabled candidates: missing {sorted(expected - ids)}, extra {sorted(ids - expected)}")
    for m, s in statistics.items():
        if s.model_id != m:
            raise ValueError(f"artifact statistics are invalid for {m}")


def load_artifact(spark: SparkSession, path: str) -> RoutingArtifact:
    x = json.loads(spark.read.text(f"{path}/artifact", wholetext=True).first()["value"])
    check_document(x)
    features = FeatureModel.from_json(x["features"])
    models = {m: LinearModel(model["intercept"], tuple(model["coefficients"])) for m, model in x["models"].items()}
    for m, model in models.items():
        if len(model.coefficients) != features.size:
            raise ValueError(f"artifact model {m} has {len(model.coefficients)} coefficients for {features.size} features")
    predictor = QualityPredictor(features, TrainingConfig(**x["training"]), models, x["training_counts"])
    return RoutingArtifact(
        predictor,
        {m: ModelStatistics(**s) for m, s in x["statistics"].items()},
        tuple(ModelCandidate(**c) for c in x["candidates"]),
        RoutingPolicy(**x["policy"]),
        x["dataset_manifest"],
        x["config"],
        x["environment"],
    )
