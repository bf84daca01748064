"""One logistic regression for each model over shared features of the request text."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.contracts import FeatureConfig, TrainingConfig, distinct_ids
from routeloom.functions.text import STRUCTURAL, normalised, strip
from routeloom.learning import regression
from routeloom.learning.features import NORMAL, FeatureModel, dealt, fit_distinct, prepared
from routeloom.learning.regression import TOLERANCE, NotConverged
from routeloom.operators.statistics import passes
from routeloom.sources.storage import settle

__all__ = ["TOLERANCE", "LinearModel", "NotConverged", "QualityPredictor", "fit_predictor"]

@dataclass(frozen=True)
class LinearModel:
    """Coefficients of the structural features, then of the vocabulary's terms."""

    intercept: float
    coefficients: tuple[float, ...]


@dataclass(frozen=True)
class QualityPredictor:
    """Fitted and immutable: fitting anew makes a new one, so a failed fit changes nothing."""

    features: FeatureModel
    training: TrainingConfig
    models: dict[str, LinearModel]
    training_counts: dict[str, dict] = field(default_factory=dict)

    def predict(self, requests: DataFrame, model_ids: list[str] | None = None) -> DataFrame:
        """``requests`` (with a query column) and a map column pass_probabilities: one projection, whatever the number of models."""
        ids = sorted(self.models) if model_ids is None else list(model_ids)
        distinct_ids(ids, "prediction model ids")
        unknown = sorted(set(ids) - set(self.models))
        if unknown:
            raise ValueError(f"unknown models: {unknown}")
        scored = requests.withColumn("__scores", self._scores(ids)(normalised(F.col("query")), self.features.dense(F.col("query"))))
        return scored.select(*requests.columns, probabilities("__scores", ids).alias("pass_probabilities"))

    def _scores(self, ids: list[str]):
        """An Arrow function of normalised texts and their dense features: the scores of all models, an array."""
        weigh, n_dense = self.features.weigh, len(STRUCTURAL)
        table = np.array([self.models[m].coefficients for m in ids])
        intercepts, dense_part, sparse_part = np.array([self.models[m].intercept for m in ids]), table[:, :n_dense], np.ascontiguousarray(table[:, n_dense:].T)

        def scores(texts: pa.Array, dense: pa.Array) -> pa.Array:
            out = np.asarray(pa.compute.list_flatten(dense)).reshape(-1, n_dense) @ dense_part.T + intercepts
            for own, text in zip(out, texts.to_pylist()):
                positions, weights = weigh(text)
                own += weights @ sparse_part[positions]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(ids), pa.int32()), pa.array(out.ravel()))

        return F.arrow_udf(scores, "array<double>")

    def predict_long(self, requests: DataFrame) -> DataFrame:
        """(query_id, model_id, probability)."""
        return long(self.predict(requests))


def probabilities(scores: str, ids: list[str]) -> Column:
    """A map from each model to the probability that its score stands for."""
    return F.create_map(*[x for k, m in enumerate(ids) for x in (F.lit(m), 1 / (1 + F.exp(-F.get(scores, F.lit(k)))))])


def long(predicted: DataFrame) -> DataFrame:
    # Before a plain explode, Spark asks whether the map is empty, and so makes it twice.
    return predicted.select("query_id", F.explode_outer("pass_probabilities").alias("model_id", "probability"))


def observed(history: DataFrame, ids: list[str], threshold: float, key: str = "query") -> DataFrame:
    """(key, seen, positive): one row for each key, with the observations of each model and how many of them passed."""
    own = history.select(key, "model_id", passes(threshold).cast("int").alias("label"))
    seen = [F.count_if(F.col("model_id") == m) for m in ids]
    positive = [F.count_if((F.col("model_id") == m) & (F.col("label") == 1)) for m in ids]
    return own.groupBy(key).agg(F.array(*seen).alias("seen"), F.array(*positive).alias("positive"))


def observed_texts(history: DataFrame, ids: list[str], threshold: float) -> DataFrame:
    """(query, seen, positive): one row for each stripped request text, which is all that features depend on."""
    return observed(history.withColumn("query", strip(F.col("query"))), ids, threshold)


def label_totals(texts: DataFrame, ids: list[str]) -> dict[str, dict]:
    """For each model observations, passing and failing ones, and the rate of passing, from ``observed_texts``."""
    sums = [F.coalesce(F.sum(F.col(side)[k]), F.lit(0)) for k in range(len(ids)) for side in ("seen", "positive")]
    found = texts.agg(F.array(*sums)).first()[0]
    return {m: {"observation_count": n, "positive_count": p, "negative_count": n - p, "positive_rate": p / n if n else None} for m, n, p in zip(ids, found[::2], found[1::2])}


def training_rows(texts: DataFrame, features: FeatureModel, *keys: str) -> DataFrame:
    """One row for each of ``observed_texts`` that are ``prepared``, as ``regression.PACKED``, with its keys."""
    dense, terms = features.packed()
    made = texts.select(*keys, F.xxhash64(NORMAL).alias("draw"), dense.alias("dense"), terms.alias("terms"), "seen", "positive")
    return made.select(*keys, "draw", "dense", "terms.*", "seen", "positive")


def fit_predictor(history: DataFrame, model_ids: list[str], features: FeatureConfig = FeatureConfig(), training: TrainingConfig = TrainingConfig()) -> QualityPredictor:
    """Fit on the query texts and passing labels of ``history``; nothing else of it is a feature.

    Too few observations, a single label, and a fit that doesn't converge are errors. All models are
    fitted together, with one job for each step of all of them.
    """
    ids = sorted(distinct_ids(list(model_ids), "training model ids"))
    # A text is held once, not once for each model that answered it.
    texts = observed_texts(history.where(F.col("model_id").isin(ids)), ids, training.quality_score_threshold)
    with _fitted(texts, ids, features, training) as (predictor, _):
        return predictor


def fit_and_score(texts: DataFrame, key: str, model_ids: list[str], features: FeatureConfig = FeatureConfig(), training: TrainingConfig = TrainingConfig()) -> tuple[QualityPredictor, DataFrame]:
    """``fit_predictor`` on texts that are stripped and distinct, with their key and what is ``observed`` of the sorted models; and (key, scores) of these texts, from the features that the fit has made."""
    ids = sorted(distinct_ids(list(model_ids), "training model ids"))
    with _fitted(texts, ids, features, training, key) as (predictor, rows):
        found = [(predictor.models[m].intercept, predictor.models[m].coefficients) for m in ids]
        return predictor, settle(regression.scores(rows, len(predictor.features.terms), found, np.array(predictor.features.weights), key), "scores")


@contextmanager
def _fitted(texts: DataFrame, ids: list[str], features: FeatureConfig, training: TrainingConfig, *keys: str) -> Iterator[tuple[QualityPredictor, DataFrame]]:
    """The predictor, and the rows that it was fitted on, which are held as long as this is."""
    texts = prepared(texts).persist()
    try:
        counts = label_totals(texts, ids)
        for m, c in counts.items():
            if c["observation_count"] < training.min_model_samples:
                raise ValueError(f"insufficient training samples for {m}: {c}")
            if not c["positive_count"] or not c["negative_count"]:
                raise ValueError(f"single label for {m}: {c}")
        fitted = fit_distinct(texts, features)
        rows = training_rows(dealt(texts, texts.count()), fitted, *keys).persist()
        try:
            found = regression.fit(rows, len(ids), len(STRUCTURAL), len(fitted.terms), training.C, training.max_iter, ids, np.array(fitted.weights))
            models = {m: LinearModel(intercept, tuple(own.tolist())) for m, (intercept, own) in zip(ids, found)}
            yield QualityPredictor(fitted, training, models, counts), rows
        finally:
            rows.unpersist()
    finally:
        texts.unpersist()
