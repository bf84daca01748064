"""Evaluation of policies and predictors on held-out observations.

A policy sees request ids and texts only. Outcomes are joined to its choices afterwards, and a choice
that was never observed is an error, not something to impute.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.contracts import COUNT, SPACES
from routeloom.operators.baselines import Selector, for_text, selection
from routeloom.operators.statistics import passes

#: Fixed value: probabilities are moved this far from 0 and 1 before their logarithm is taken.
EPSILON = 2.220446049250313e-16

METRICS = (
    "query_count", "quality_pass_rate", "average_quality", "average_cost", "average_latency_ms", "fallback_rate",
    "normal_query_count", "fallback_query_count", "normal_routing_actual_pass_rate", "fallback_actual_pass_rate",
)


def requests_of(history: DataFrame) -> DataFrame:
    """(query_id, query), all that a policy may see."""
    return history.groupBy("query_id").agg(F.min("query").alias("query"))


def policy_outcomes(history: DataFrame, selected: DataFrame, threshold: float) -> DataFrame:
    """One row for each choice with what was observed of it; observed columns are null where nothing was."""
    chosen = selected.select("query_id", F.col("selection.selected_model").alias("model_id"), "selection")
    seen = history.select("query_id", "model_id", "task_type", "quality_score", "cost", "latency_ms")
    return chosen.join(seen, ["query_id", "model_id"], "left").select(
        "query_id",
        "task_type",
        F.col("model_id").alias("selected_model"),
        F.col("selection.fallback_used").alias("fallback_used"),
        F.col("selection.pass_probability").alias("predicted_pass_probability"),
        F.col("selection.decision_reason").alias("decision_reason"),
        F.col("quality_score").alias("observed_quality_score"),
        F.col("cost").alias("observed_cost"),
        F.col("latency_ms").alias("observed_latency_ms"),
        passes(threshold).alias("quality_pass"),
    )


def outcome_metrics(outcomes: DataFrame, *by: str) -> DataFrame:
    """The metrics of all outcomes, or of each value of ``by``; those that don't apply or have no rows are null."""
    return outcomes.groupBy(*by).agg(*_metrics())


def outcome_metrics_by_sets(outcomes: DataFrame, sets: list[list[str]]) -> DataFrame:
    """The metrics for each value of several groupings in one pass over the outcomes; [] is all of them together.

    Columns that a row isn't grouped by are null there. ``level`` has a bit for each of the columns, in
    the order in which they first occur, that is set where a row isn't grouped by it.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return outcomes.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().alias("level"), *_metrics())


def _metrics() -> list[Column]:
    passed = F.col("quality_pass").cast("double")
    normal, fallback = ~F.col("fallback_used"), F.col("fallback_used")
    gated = F.count("fallback_used") == F.count("*")
    return [
        F.count("*").alias("query_count"),
        F.avg(passed).alias("quality_pass_rate"),
        F.avg("observed_quality_score").alias("average_quality"),
        F.avg("observed_cost").alias("average_cost"),
        F.avg("observed_latency_ms").alias("average_latency_ms"),
        F.when(gated, F.avg(fallback.cast("double"))).alias("fallback_rate"),
        F.when(gated, F.count_if(normal)).alias("normal_query_count"),
        F.when(gated, F.count_if(fallback)).alias("fallback_query_count"),
        F.avg(F.when(normal, passed)).alias("normal_routing_actual_pass_rate"),
        F.avg(F.when(fallback, passed)).alias("fallback_actual_pass_rate"),
    ]


def log_loss_and_brier(rows: DataFrame, *by: str, label: str = "label", probability: str = "probability") -> DataFrame:
    """(by..., observation_count, log_loss, brier_score)."""
    return rows.groupBy(*by).agg(*_losses(label, probability))


def pooled_log_loss_and_brier(rows: DataFrame, by: str, label: str = "label", probability: str = "probability") -> DataFrame:
    """The same for each value of ``by`` and, with ``pooled`` true and a null there, for all rows; in one pass over them."""
    return rows.groupingSets([[F.col(by)], []], by).agg((F.grouping_id() > 0).alias("pooled"), *_losses(label, probability))


def _losses(label: str, probability: str) -> list[Column]:
    y, p = F.col(label).cast("double"), F.col(probability)
    clipped = F.greatest(F.least(p, F.lit(1 - EPSILON)), F.lit(EPSILON))
    return [
        F.count("*").alias("observation_count"),
        F.avg(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier_score"),
    ]


def calibration_bins(rows: DataFrame, bins: int, label: str = "label", probability: str = "probability", by: str | None = None) -> DataFrame:
    """For every bin, the empty ones too: bounds, count, mean prediction and observed rate; the last bin holds 1."""
    COUNT.check(bins, "probability_bins")
    bucket = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    sums = rows.groupBy(*keys, bucket.alias("bin")).agg(F.count("*").alias("count"), F.avg(probability).alias("mean_predicted_probability"), F.avg(F.col(label).cast("double")).alias("observed_pass_rate"))
    every = sums.select(*keys).distinct() if by else rows.sparkSession.range(1).select()
    every = every.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(sums, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("bin") / F.lit(float(bins))).alias("lower_inclusive"),
        ((F.col("bin") + 1) / F.lit(float(bins))).alias("upper"),
        (F.col("bin") == bins - 1).alias("upper_inclusive"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        "mean_predicted_probability",
        "observed_pass_rate",
    )


def probability_diagnostics(rows: DataFrame, bins: int, label: str = "label", probability: str = "probability") -> dict:
    """Log loss, Brier score and bins of paired labels and predictions, which must be valid and not empty."""
    COUNT.check(bins, "probability_bins")
    y, p = F.col(label), F.col(probability)
    ok = y.isin(0, 1) & (p >= 0) & (p <= 1) & ~F.isnan(p)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad")).first()
    if not counts["n"] or counts["bad"]:
        raise ValueError("probability diagnostics need paired binary labels and probabilities")
    sums = log_loss_and_brier(rows, label=label, probability=probability).first().asDict()
    held = [r.asDict() for r in calibration_bins(rows, bins, label, probability).orderBy("bin").collect()]
    return {**sums, "bins": [{k: v for k, v in b.items() if k != "bin"} for b in held]}


def labelled_predictions(history: DataFrame, predictions: DataFrame, threshold: float) -> DataFrame:
    """(query_id, model_id, label, probability): observations with predictions (query_id, model_id, probability)."""
    return history.select("query_id", "model_id", passes(threshold).cast("int").alias("label")).join(predictions, ["query_id", "model_id"])


def evaluate_predictor(history: DataFrame, predictions: DataFrame, model_ids: list[str], threshold: float, bins: int) -> dict:
    """Diagnostics of each model and of all together; a model without held-out rows is an error."""
    rows = labelled_predictions(history, predictions, threshold).persist()
    try:
        per_model = {r["model_id"]: r.asDict() for r in log_loss_and_brier(rows, "model_id").collect()}
        missing = sorted(set(model_ids) - per_model.keys())
        if missing:
            raise ValueError(f"no held-out observations: {missing}")
        held: dict[str, list] = {}
        for r in calibration_bins(rows, bins, by="model_id").orderBy("model_id", "bin").collect():
            held.setdefault(r["model_id"], []).append({k: v for k, v in r.asDict().items() if k not in ("model_id", "bin")})
        return {
            "measurement_kind": "simulated",
            "calibration_model": None,
            "query_count": rows.select("query_id").distinct().count(),
            "per_model": {m: {k: v for k, v in per_model[m].items() if k != "model_id"} | {"bins": held[m]} for m in sorted(model_ids)},
            "pooled": probability_diagnostics(rows, bins),
        }
    finally:
        rows.unpersist()


#: Cells between a power of two and the next, in which values are ranked.
CELLS = 256
#: Beyond the exponent of any double.
_EXPONENTS = 1100


def _cell(value: Column) -> Column:
    """A whole number that never falls as values rise: the power of two below, and the cell between it and the next."""
    size = F.abs(value)
    power = F.floor(F.log2(size))
    # Where the logarithm is rounded up to a whole number, the value is taken for the power itself.
    within = F.least(F.greatest(F.floor((size / F.pow(F.lit(2.0), power) - 1) * CELLS), F.lit(0)), F.lit(CELLS - 1))
    cell = (power + _EXPONENTS) * CELLS + within + 1
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, cell).otherwise(-cell)


def latency_percentiles(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """Exact median and 95th percentile by linear interpolation, with the count and the mean; of finite values.

    Equal values are counted first, then the values of a cell. Cells are narrow where values are
    small, so a few huge values leave the others in cells of their own. Sums over the cells say in
    which of them the wanted ranks lie, and only values of these cells are ordered.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counts = rows.where(F.col(column).isNotNull()).groupBy(key.alias("key"), F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = counts.withColumn("cell", _cell(F.col("v")))
    cells = placed.groupBy("key", "cell").agg(F.sum("n").alias("in_cell"), F.sum(F.col("v") * F.col("n")).alias("sum"))
    whole = Window.partitionBy("key")
    cells = cells.select("key", "cell", "in_cell", (F.sum("in_cell").over(whole.orderBy("cell")) - F.col("in_cell")).alias("before"), F.sum("in_cell").over(whole).alias("total"), F.sum("sum").over(whole).alias("sum"))
    ranks = {name: F.lit(share) * (F.col("total") - 1) for name, share in (("p50", 0.5), ("p95", 0.95))}
    wanted = F.array(*[end for rank in ranks.values() for end in (F.floor(rank), F.ceil(rank))])
    cells = cells.withColumn("wanted", wanted).where(F.exists("wanted", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("in_cell"))))
    cells = cells.select("key", "cell", "before", "total", (F.col("sum") / F.col("total")).alias("mean"))
    first = F.col("before") + F.sum("n").over(Window.partitionBy("key", "cell").orderBy("v")) - F.col("n")
    ranked = placed.join(cells, ["key", "cell"]).withColumn("first", first)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("first")) & (rank < F.col("first") + F.col("n")), F.col("v")))

    found = ranked.groupBy("key").agg(
        F.first("total").alias("observation_count"), F.first("mean").alias("mean"),
        *[F.struct(at(F.floor(rank)).alias("low"), at(F.ceil(rank)).alias("high"), F.first(rank - F.floor(rank)).alias("part")).alias(name) for name, rank in ranks.items()],
    )
    between = [(F.col(f"{name}.low") + (F.col(f"{name}.high") - F.col(f"{name}.low")) * F.col(f"{name}.part")).alias(name) for name in ranks]
    return found.select(*[F.col(f"key.{c}").alias(c) for c in by], "observation_count", "mean", *between)


def evaluate_policy(history: DataFrame, select: Selector, threshold: float, bins: int = 5) -> dict:
    """Metrics of a policy's choices, in all and by task type, and diagnostics of its probabilities where all have one."""
    repeated = history.groupBy("query_id", "model_id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ValueError("evaluation needs one observation for each query and model")
    outcomes = policy_outcomes(history, select(requests_of(history)), threshold).persist()
    try:
        flags = outcomes.agg(F.count("*").alias("n"), F.count("fallback_used").alias("flags"), F.count("observed_quality_score").alias("seen"), F.count("predicted_pass_probability").alias("p")).first()
        if flags["seen"] < flags["n"]:
            lost = outcomes.where("observed_quality_score IS NULL").orderBy("query_id").first()
            raise ValueError(f"unobserved choice: ({lost['query_id']}, {lost['selected_model']}); outcomes aren't imputed")
        if flags["flags"] not in (0, flags["n"]):
            raise ValueError("one policy must say for all or none of its choices whether it fell back")
        measured = outcome_metrics_by_sets(outcomes, [["task_type"], []]).orderBy("task_type").collect()
        result = {
            "measurement_kind": "simulated",
            "metrics": next({k: r[k] for k in METRICS} for r in measured if r["level"]),
            "by_task_type": {r["task_type"]: {k: r[k] for k in METRICS} for r in measured if not r["level"]},
        }
        if flags["n"] and flags["p"] == flags["n"]:
            rows = outcomes.select(F.col("quality_pass").cast("int").alias("label"), F.col("predicted_pass_probability").alias("probability"))
            result["selected_probability_diagnostics"] = probability_diagnostics(rows, bins)
        return result
    finally:
        outcomes.unpersist()


def column_selector(decide: Column) -> Selector:
    """A policy from a selection Column over query."""
    return lambda requests: requests.withColumn("selection", decide)


def python_selector(choose: Callable[[str], str]) -> Selector:
    """A policy from any Python function of a request's text that returns a model id.

    Texts go to Python workers in Arrow batches. Such a policy has no gate, so whether it fell back,
    its probability and its reason are null; a blank text is an error while running.
    """

    @F.pandas_udf("string")
    def chosen(texts: pd.Series) -> pd.Series:
        return texts.map(choose)

    return lambda requests: requests.withColumn("selection", selection(for_text(chosen("query"))))


def register_selector(spark: SparkSession, name: str, choose: Callable[[str], str]) -> Selector:
    """Make a Python function of a request's text a table function of SQL, and return it as a policy.

    ``SELECT * FROM name(TABLE(SELECT query_id, query FROM requests))`` has (query_id, selected_model) of
    every request. Rows go to Python workers in Arrow batches; a blank text is an error while running.
    """

    class Chosen:
        def eval(self, request: Row):
            if not (request["query"] or "").strip(SPACES):
                raise ValueError("query is blank")
            yield request["query_id"], choose(request["query"])

    spark.udtf.register(name, F.udtf(Chosen, returnType="query_id string, selected_model string", useArrow=True))

    def select(requests: DataFrame) -> DataFrame:
        asked = requests.select(F.col("query_id").cast("string").alias("query_id"), "query")
        chosen = spark.sql(f"SELECT * FROM {name}(TABLE(SELECT query_id, query FROM {{asked}}))", asked=asked)
        return chosen.select("query_id", selection(F.col("selected_model")).alias("selection"))

    return select
