"""The routing decision as one Column expression: the quality gate first, then cost, then latency.

It reads an array of estimates and returns a struct, so it fuses into the scan's projection and
never shuffles. A long table of estimates is gathered first, K rows for each request.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from routeloom.contracts import ESTIMATED, ESTIMATES, TEXT, ModelCandidate, RoutingPolicy, enabled_ids

#: Precise enough for doubles' shortest decimal forms, and their difference still fits in 38 digits.
_DECIMAL = "decimal(37,18)"


def in_cost_band(cost: Column, least: Column, tolerance: float) -> Column:
    """Whether a cost is within the tolerance of the least one.

    Without tolerance doubles must be equal; with one, decimal forms are compared, so 1.1 is within 0.1 of 1.0.
    """
    if tolerance == 0:
        return cost == least
    return cost.cast(_DECIMAL) - least.cast(_DECIMAL) <= F.lit(repr(float(tolerance))).cast("double").cast(_DECIMAL)


def route(estimates: Column, policy: RoutingPolicy) -> Column:
    """The decision for an array of estimates of all enabled models.

    A struct of selected_model, its pass_probability, estimated_cost and estimated_latency_ms,
    fallback_used, decision_reason, qualified_models and candidate_estimates, both in model order.
    Ties fall to latency, cost and id; without a qualified model to probability, cost, latency, id.
    """
    rows = F.array_sort(estimates.cast(ESTIMATES))
    qualified = F.filter(rows, lambda e: e["pass_probability"] >= F.lit(float(policy.router_probability_threshold)))
    least = F.array_min(F.transform(qualified, lambda e: e["estimated_cost"]))
    band = F.filter(qualified, lambda e: in_cost_band(e["estimated_cost"], least, policy.cost_tolerance_abs))

    def ranked(rows: Column, *order) -> Column:
        return F.array_min(F.transform(rows, lambda e: F.struct(*[f(e).alias(f"k{k}") for k, f in enumerate(order)], e.alias("e")))).getField("e")

    normal = ranked(band, lambda e: e["estimated_latency_ms"], lambda e: e["estimated_cost"], lambda e: e["model_id"])
    fallback = ranked(rows, lambda e: -e["pass_probability"], lambda e: e["estimated_cost"], lambda e: e["estimated_latency_ms"], lambda e: e["model_id"])
    selected = F.coalesce(normal, fallback)
    reason = (
        F.when(F.size(qualified) == 0, "FALLBACK_MAX_PASS_PROBABILITY")
        .when(F.size(qualified) == 1, "QUALIFIED_ONLY_MODEL")
        .when(F.size(band) == 1, "QUALIFIED_MINIMUM_COST")
        .otherwise("QUALIFIED_LATENCY_COST_ID_TIEBREAK")
    )
    return F.struct(
        selected["model_id"].alias("selected_model"),
        selected["pass_probability"].alias("pass_probability"),
        selected["estimated_cost"].alias("estimated_cost"),
        selected["estimated_latency_ms"].alias("estimated_latency_ms"),
        (F.size(qualified) == 0).alias("fallback_used"),
        reason.alias("decision_reason"),
        F.transform(qualified, lambda e: e["model_id"]).alias("qualified_models"),
        rows.alias("candidate_estimates"),
    )


def checked(estimates: Column, candidates: list[ModelCandidate] | tuple[ModelCandidate, ...]) -> Column:
    """The estimates of enabled candidates, or an error while running: for invalid values, unknown, repeated or missing models."""
    active = enabled_ids(candidates)
    known = F.array(*[F.lit(c.model_id) for c in candidates])
    rows = estimates.cast(ESTIMATES)
    ids = F.transform(rows, lambda e: e["model_id"])

    def bad(e: Column) -> Column:
        return ~reduce(lambda a, b: a & b, [domain.of_column(e[name]) for name, domain in ESTIMATED.items() if domain is not TEXT])

    problem = (
        F.when(F.exists(rows, bad), "invalid estimate")
        .when(F.size(F.array_except(ids, known)) > 0, "unknown model in estimates")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate model in estimates")
        .when(F.size(F.array_except(F.array(*[F.lit(m) for m in active]), ids)) > 0, "missing estimate")
    )
    kept = F.filter(rows, lambda e: e["model_id"].isin(active))
    return F.when(problem.isNotNull(), F.raise_error(problem).cast(ESTIMATES)).otherwise(kept)


def route_rows(requests: DataFrame, candidates, policy: RoutingPolicy, estimates: str = "estimates") -> DataFrame:
    """``requests`` with a decision column, from a checked array of estimates."""
    return requests.withColumn("decision", route(checked(F.col(estimates), candidates), policy))


def route_long(estimates: DataFrame, candidates, policy: RoutingPolicy, key: str = "query_id") -> DataFrame:
    """(key, decision) from a table of one row for each request and model."""
    row = F.struct("model_id", "pass_probability", "estimated_cost", "estimated_latency_ms")
    return route_rows(estimates.groupBy(key).agg(F.collect_list(row).alias("estimates")), candidates, policy).select(key, "decision")


def route_one(candidates, estimates: list[tuple[str, float, float, float]], policy: RoutingPolicy, spark) -> dict:
    """The decision for a single request, by the same expression; an estimate is (model, probability, cost, latency)."""
    rows = [(model, *map(float, numbers)) for model, *numbers in estimates]
    frame = spark.createDataFrame([(rows,)], T.StructType([T.StructField("estimates", ESTIMATES)]))
    return route_rows(frame, candidates, policy).select("decision.*").first().asDict(recursive=True)
