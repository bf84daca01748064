"""What streams of outcomes say of models and of decisions, in event time.

State is bounded by the watermark: sums of a window go once it has passed the window's end, and a
decision goes once no outcome of it can come any more. Nothing depends on how rows are dealt to
micro-batches, as long as they aren't later than the watermark allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.operators.statistics import passes

#: Sums of windows, which add up: decimals, so that their order doesn't matter.
SUMS = ("observation_count", "cost_sum", "latency_sum", "quality_sum", "pass_count")


def windowed_sums(outcomes: DataFrame, threshold: float, time: str = "observed_at", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(model_id, window_start, SUMS) of a stream, or a table, of observations; repeated call_ids count once.

    A stream's windows are complete, and returned, once the watermark (``late`` behind the latest
    row) has passed them. Rows without a time, a call_id or a model are left out.
    """
    named = outcomes.where(F.col(time).isNotNull() & F.col("call_id").isNotNull() & F.col("model_id").isNotNull())
    once = named.withWatermark(time, late).dropDuplicatesWithinWatermark(["call_id"]) if outcomes.isStreaming else named.dropDuplicates(["call_id"])
    amount = {"cost_sum": "cost", "latency_sum": "latency_ms", "quality_sum": "quality_score"}
    sums = [F.sum(F.col(c).cast("decimal(28,8)")).alias(name) for name, c in amount.items()]
    held = once.groupBy("model_id", F.window(time, window).alias("window")).agg(F.count("*").alias("observation_count"), *sums, F.count_if(passes(threshold)).alias("pass_count"))
    return held.select("model_id", F.col("window.start").alias("window_start"), *SUMS)


def model_estimates(windows: DataFrame, *by: str) -> DataFrame:
    """Statistics of each model (and ``by``) from any windows of it, as ``model_statistics`` has them from observations."""
    n = F.sum("observation_count")
    means = {"mean_cost": "cost_sum", "mean_latency_ms": "latency_sum", "mean_quality": "quality_sum"}
    return windows.groupBy("model_id", *by).agg(
        n.alias("observation_count"), *[(F.sum(c).cast("double") / n).alias(name) for name, c in means.items()], (F.sum("pass_count").cast("double") / n).alias("pass_rate")
    )


def decisions_with_outcomes(decisions: DataFrame, outcomes: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Every decision (query_id, selected_model, decided_at) with its outcome (query_id, model_id, observed_at, ...), if one comes ``within`` that time.

    A decision without an outcome is returned with nulls once the watermarks of both streams say that
    none can come any more; nothing is imputed. Of repeated outcomes one counts. For tables the same
    holds of what is in them: of several outcomes in time the first.
    """
    names = [c for c in outcomes.columns if c not in ("query_id", "model_id", "observed_at")]
    left = decisions.where("decided_at IS NOT NULL")
    right = outcomes.select(F.col("query_id").alias("of_query"), F.col("model_id").alias("of_model"), "observed_at", *names).where("observed_at IS NOT NULL")
    keys = ["of_query", "of_model"]
    if decisions.isStreaming or outcomes.isStreaming:
        left, right = left.withWatermark("decided_at", late), right.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(keys)
    met = (
        (F.col("query_id") == F.col("of_query")) & (F.col("selected_model") == F.col("of_model"))
        & (F.col("observed_at") >= F.col("decided_at")) & (F.col("observed_at") <= F.col("decided_at") + F.expr(f"INTERVAL {within}"))
    )
    joined = left.join(right, met, "leftOuter")
    if not (decisions.isStreaming or outcomes.isStreaming):
        first = F.min_by(F.struct("observed_at", *names), "observed_at").alias("outcome")
        joined = joined.groupBy(*decisions.columns).agg(first).select(*decisions.columns, "outcome.*")
    return joined.select(*decisions.columns, "observed_at", *names, F.col("observed_at").isNotNull().alias("observed"))
