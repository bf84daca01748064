import itertools
import math

import pytest
from pyspark.sql import functions as F

from routeloom.contracts import ESTIMATES, FeatureConfig, ModelCandidate, RoutingPolicy, TrainingConfig
from routeloom.operators.routing import route, route_long, route_one, route_rows

COST, ONLY, TIE, LAST = "QUALIFIED_MINIMUM_COST", "QUALIFIED_ONLY_MODEL", "QUALIFIED_LATENCY_COST_ID_TIEBREAK", "FALLBACK_MAX_PASS_PROBABILITY"
#: (model, probability, cost, latency), (bar, tolerance), the model chosen and the reason.
CASES = {
    "the cheapest of three that pass": ([("m", 0.72, 6.5, 3), ("n", 0.93, 4.25, 80), ("o", 0.7, 9, 1), ("p", 0.69, 0.5, 2)], (0.7, 0), "n", COST),
    "the bar itself passes": ([("m", 0.65, 12, 70), ("n", 0.6499999, 2, 3)], (0.65, 0), "m", ONLY),
    "a bar of zero lets all pass": ([("m", 0.0, 2, 5), ("n", 1.0, 3, 1)], (0.0, 0), "m", COST),
    "nobody passes a bar of one": ([("m", 0.999, 9, 9), ("n", 0.98, 1, 1)], (1.0, 0), "m", LAST),
    "the faster of equal costs": ([("m", 0.9, 7.5, 61), ("n", 0.81, 7.5, 60.5)], (0.8, 0), "n", TIE),
    "the band begins at the least cost, not at the next one": ([("m", 0.9, 20, 90), ("n", 0.9, 21.5, 45), ("o", 0.9, 23, 2)], (0.8, 1.5), "n", TIE),
    "a little beyond the band": ([("m", 0.9, 20, 90), ("n", 0.9, 21.50001, 2)], (0.8, 1.5), "m", COST),
    "costs are compared as decimals": ([("m", 0.9, 2.0, 90), ("n", 0.9, 2.3, 2)], (0.8, 0.3), "n", TIE),
    "and beyond them": ([("m", 0.9, 2.0, 90), ("n", 0.9, 2.3000001, 2)], (0.8, 0.3), "m", COST),
    "the next double is another cost": ([("m", 0.9, math.nextafter(4.0, 5), 2), ("n", 0.9, 4.0, 90)], (0.8, 0), "n", COST),
    "of equal latencies in the band the cheaper": ([("m", 0.9, 31, 8), ("z", 0.99, 30, 8)], (0.8, 2), "z", TIE),
    "of equal costs and latencies the first id": ([("q", 0.95, 5, 8), ("h", 0.85, 5, 8)], (0.8, 2), "h", TIE),
    "costs of nothing": ([("m", 0.9, 0, 400), ("n", 0.9, 0.001, 1)], (0.8, 0), "m", COST),
    "fallback: the cheaper of equal chances": ([("m", 0.31, 8, 2), ("n", 0.31, 7, 30)], (0.8, 0), "n", LAST),
    "fallback: then the faster": ([("m", 0.31, 7, 30), ("n", 0.31, 7, 29)], (0.8, 0), "n", LAST),
    "fallback: then the first id": ([("w", 0.31, 7, 30), ("k", 0.31, 7, 30)], (0.8, 0), "k", LAST),
}


def _candidates(rows):
    return tuple(ModelCandidate(r[0]) for r in rows)


@pytest.mark.parametrize("rows,policy,selected,reason", CASES.values(), ids=CASES)
def test_decisions(spark, rows, policy, selected, reason):
    d = route_one(_candidates(rows), rows, RoutingPolicy(*policy), spark)
    assert (d["selected_model"], d["decision_reason"]) == (selected, reason)
    assert d["fallback_used"] == reason.startswith("FALLBACK")
    assert d["qualified_models"] == sorted(m for m, p, *_ in rows if p >= policy[0])
    assert [e["model_id"] for e in d["candidate_estimates"]] == sorted(m for m, *_ in rows)


def test_order_of_estimates_does_not_matter(spark):
    rows = [("s", 0.87, 6.5, 14.0), ("r", 0.87, 6.5, 14.0), ("t", 0.87, 6.5, 14.0), ("u", 0.5, 1.0, 1.0)]
    frame = spark.createDataFrame([(list(x),) for x in itertools.permutations(rows)], f"estimates {ESTIMATES.simpleString()}")
    assert {r[0] for r in route_rows(frame, _candidates(rows), RoutingPolicy()).select("decision.selected_model").collect()} == {"r"}


def test_projection_has_no_shuffle_and_long_form_agrees(spark):
    rows = [(k, "ab"[j], (k * 37 + j * 11) % 100 / 100, float((k * 7 + j) % 5), float(j)) for k in range(50) for j in range(2)]
    long = spark.createDataFrame(rows, "query_id int, model_id string, pass_probability double, estimated_cost double, estimated_latency_ms double")
    candidates = (ModelCandidate("a"), ModelCandidate("b"))
    by_long = {r["query_id"]: r["decision"]["selected_model"] for r in route_long(long, candidates, RoutingPolicy(0.5)).collect()}
    held = {}
    for k, *e in rows:
        held.setdefault(k, []).append(tuple(e))
    wide = spark.createDataFrame(list(held.items()), f"query_id int, estimates {ESTIMATES.simpleString()}").withColumn("d", route(F.col("estimates"), RoutingPolicy(0.5)))
    assert {r["query_id"]: r["d"]["selected_model"] for r in wide.collect()} == by_long
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()


def test_disabled_candidates_are_left_out(spark):
    candidates = (ModelCandidate("a", False), ModelCandidate("b"))
    assert route_one(candidates, [("a", 1, 0, 0), ("b", 0.1, 1, 1)], RoutingPolicy(), spark)["selected_model"] == "b"


@pytest.mark.parametrize(
    "candidates,rows,message",
    [
        ((ModelCandidate("a"),), [("a", 0.5, 1.0, 1.0), ("x", 0.5, 1.0, 1.0)], "unknown"),
        ((ModelCandidate("a"),), [("a", 0.5, 1.0, 1.0), ("a", 0.6, 1.0, 1.0)], "duplicate"),
        ((ModelCandidate("a"), ModelCandidate("b")), [("a", 0.5, 1.0, 1.0)], "missing"),
        ((ModelCandidate("a"),), [("a", math.nan, 1.0, 1.0)], "invalid"),
        ((ModelCandidate("a"),), [("a", 0.5, math.inf, 1.0)], "invalid"),
        ((ModelCandidate("a"),), [("a", 0.5, 1.0, -0.01)], "invalid"),
        ((ModelCandidate("a"),), [("a", 1.001, 1.0, 1.0)], "invalid"),
    ],
)
def test_bad_estimates_fail(spark, candidates, rows, message):
    frame = spark.createDataFrame([(rows,)], f"estimates {ESTIMATES.simpleString()}")
    with pytest.raises(Exception, match=message):
        route_rows(frame, candidates, RoutingPolicy()).collect()


def test_bad_settings_fail(spark):
    frame = spark.createDataFrame([([("a", 0.5, 1.0, 1.0)],)], f"estimates {ESTIMATES.simpleString()}")
    with pytest.raises(ValueError, match="unique"):
        route_rows(frame, (ModelCandidate("a"), ModelCandidate("a")), RoutingPolicy())
    with pytest.raises(ValueError, match="no eligible"):
        route_rows(frame, (ModelCandidate("a", False),), RoutingPolicy())
    for bad in (-0.1, 1.1, math.nan, math.inf, True):
        with pytest.raises(ValueError):
            RoutingPolicy(bad)
    for bad in (-0.1, math.nan, math.inf):
        with pytest.raises(ValueError):
            RoutingPolicy(0.8, bad)
    for bad in (lambda: FeatureConfig((3, 2)), lambda: FeatureConfig((2, 4), 0), lambda: TrainingConfig(C=0), lambda: TrainingConfig(max_iter=0), lambda: ModelCandidate(" "), lambda: ModelCandidate("a", 1)):
        with pytest.raises(ValueError):
            bad()
