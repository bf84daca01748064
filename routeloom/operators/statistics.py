"""Per-model sums over training observations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.contracts import ESTIMATES, SHARE, ModelStatistics, distinct_ids


def passes(threshold: float, quality: str = "quality_score") -> Column:
    """Whether an outcome reaches the threshold, which counts as passing."""
    return F.col(quality) >= F.lit(float(threshold))


def stable_mean(column: str) -> Column:
    """A mean that doesn't depend on the order of summing, for values of at most eight decimals: ties stay ties."""
    return F.sum(F.col(column).cast("decimal(28,8)")).cast("double") / F.count(column)


def model_statistics(history: DataFrame, threshold: float) -> DataFrame:
    """One row for each model: mean cost, latency and quality, observations and pass rate; one shuffle of K partial rows."""
    SHARE.check(threshold, "quality_score_threshold")
    return history.groupBy("model_id").agg(
        stable_mean("cost").alias("mean_cost"),
        stable_mean("latency_ms").alias("mean_latency_ms"),
        F.count("*").alias("observation_count"),
        stable_mean("quality_score").alias("mean_quality"),
        F.avg(passes(threshold).cast("double")).alias("pass_rate"),
    )


def summarize_models(history: DataFrame, model_ids: list[str], threshold: float) -> dict[str, ModelStatistics]:
    """The statistics of the configured models, which are few, on the driver; a model without observations is an error."""
    distinct_ids(list(model_ids), "statistics model ids")
    rows = model_statistics(history.where(F.col("model_id").isin(list(model_ids))), threshold).collect()
    found = {r["model_id"]: ModelStatistics(**r.asDict()) for r in rows}
    missing = sorted(set(model_ids) - found.keys())
    if missing:
        raise ValueError(f"missing training observations: {missing}")
    return {m: found[m] for m in sorted(model_ids)}


def label_counts(history: DataFrame, threshold: float) -> DataFrame:
    """One row for each model: observations, passing and failing ones, and the rate of passing."""
    positive = F.count_if(passes(threshold))
    return history.groupBy("model_id").agg(
        F.count("*").alias("observation_count"),
        positive.alias("positive_count"),
        (F.count("*") - positive).alias("negative_count"),
        F.try_divide(positive.cast("double"), F.count("*")).alias("positive_rate"),
    )


def estimates_column(probabilities: Mapping[str, Column], statistics: Mapping[str, ModelStatistics]) -> Column:
    """An array of estimates: each model's probability with its mean cost and latency as literals, ordered by model."""
    missing = sorted(set(probabilities) - set(statistics))
    if missing:
        raise ValueError(f"missing training statistics: {missing}")
    rows = [
        F.struct(
            F.lit(m).alias("model_id"),
            probabilities[m].cast("double").alias("pass_probability"),
            F.lit(float(statistics[m].mean_cost)).alias("estimated_cost"),
            F.lit(float(statistics[m].mean_latency_ms)).alias("estimated_latency_ms"),
        )
        for m in sorted(probabilities)
    ]
    return F.array(*rows).cast(ESTIMATES)
