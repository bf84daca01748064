import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.contracts import FeatureConfig, ModelCandidate, ModelStatistics, RoutingPolicy, TrainingConfig
from routeloom.functions import text as tx
from routeloom.learning import regression
from routeloom.learning.artifact import RoutingArtifact, check_document, decide, load_artifact, save_artifact
from routeloom.learning.features import fit_features
from routeloom.learning.predictor import NotConverged, fit_predictor
from routeloom.operators import evaluation
from routeloom.operators.baselines import Baselines
from routeloom.operators.statistics import summarize_models
from routeloom.streaming.scoring import route_stream

SPACES = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def test_strip_is_pythons(spark):
    rows = [(s + "a" + s + "b" + s,) for s in SPACES]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(tx.strip(F.col("t"))).collect()] == [r[0].strip() for r in rows]


def test_hints_and_flags(spark):
    want = {
        "Write Python": "code", "def f": "code", "undefined": "qa", "def²": "qa", "用def写": "qa", "a def.": "code", "```x": "code", "SQLite": "code", "翻译": "translation", "Translated": "translation",
        "总结": "summary", "Summarise": "summary", "a/b": "math", "\\sqrt{2}": "math", "求解": "math", "hello": "qa", "CLASS": "code", "imports": "qa",
    }
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", tx.task_type_hint(F.col("t"))).collect()
    assert dict(map(tuple, got)) == want


def test_structural_features(spark):
    texts = [" plain words ", "def f(x): return x + 2", "x² = 4", "①", "中文 and_more 3.14", "٣"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(*[c.alias(n) for n, c in tx.structural_features(F.col("t")).items()]).collect()
    for t, row in zip(texts, got):
        t = t.strip()
        segments = len(re.findall(r"[㐀-鿿]|[A-Za-z_]+|\d+(?:\.\d+)?", t))
        assert row["log_length"] == pytest.approx(math.log1p(len(t))) and row["log_segments"] == pytest.approx(math.log1p(segments))
        assert row["has_digit"] == float(any(c.isdigit() for c in t))


def test_ngrams(spark):
    for t in ("", "a", "ab", "Ab  c", "é𝒳z"):
        norm = re.sub(r"\s\s+", " ", t.strip().lower())
        want = sorted(norm[i : i + n] for n in (2, 3) for i in range(len(norm) - n + 1))
        assert sorted(spark.createDataFrame([(t,)], "t string").select(tx.char_ngrams(F.col("t"), 2, 3)).first()[0]) == want


def test_features_of_short_texts_are_structural_only(spark):
    model = fit_features(spark.createDataFrame([("a",), ("b",)], "query string"))
    own = spark.createDataFrame([("x",)], "query string").select(model.dense(F.col("query")), model.sparse(F.col("query"))).first()
    assert model.terms == () and len(own[0]) == 5 and own[1]["positions"] == []
    with pytest.raises(ValueError, match="blank"):
        fit_features(spark.createDataFrame([(" ",)], "query string"))


def _history(spark):
    """Ninety requests of three kinds; "east" does well with queries and letters, "west" with sums, and prices go with the request's number."""
    rows = []
    for i in range(90):
        kind, text = (("sum", f"add up {i} = {i % 5} * y + {i % 7}"), ("letter", f"draft letter {i} to the harbour office"), ("sql", f"sql over table {i % 11} with {i} rows"))[i % 3]
        for m, good, price in (("east", kind != "sum", 1.25), ("west", kind == "sum", 0.75)):
            rows.append((f"{m}/{i}", f"r{i:03d}", f"set{i % 15}", text, m, kind, (0.97 if good else 0.31) - 0.001 * (i % 9), price + 0.01 * (i % 6), 35.0 + 10 * (m == "west") + i % 4))
    return spark.createDataFrame(rows, "call_id string, query_id string, group_id string, query string, model_id string, task_type string, quality_score double, cost double, latency_ms double").coalesce(2).persist()


FEATURES, TRAINING = FeatureConfig((2, 3), 64), TrainingConfig(C=0.5, min_model_samples=4)


@pytest.fixture(scope="module")
def fitted(spark):
    history = _history(spark)
    return history, fit_predictor(history, ["east", "west"], FEATURES, TRAINING)


def test_predictor_learns_who_is_good_at_what(spark, fitted, tmp_path):
    history, predictor = fitted
    new = spark.createDataFrame([("x", "draft letter 200 to the harbour master"), ("y", "add up 900 = 3 * y + 2")], "query_id string, query string")
    p = {r["query_id"]: r["pass_probabilities"] for r in predictor.predict(new).collect()}
    assert p["x"]["east"] > p["x"]["west"] and p["y"]["west"] > p["y"]["east"]
    with pytest.raises(ValueError, match="unknown"):
        predictor.predict(new, ["z"])

    statistics = summarize_models(history, ["east", "west"], 0.8)
    candidates = (ModelCandidate("east"), ModelCandidate("west"))
    config = {"models": [{"model_id": m, "enabled": True} for m in ("east", "west")], "features": {"ngram_range": [2, 3], "max_features": 64}, "training": {"C": 0.5, "min_model_samples": 4}, "policy": {}, "rules": dict.fromkeys(("code", "math", "summary", "translation", "qa"), "east")}
    artifact = RoutingArtifact(predictor, statistics, candidates, RoutingPolicy(), {}, config, {})
    save_artifact(spark, artifact, f"file://{tmp_path}/art")
    again = load_artifact(spark, f"file://{tmp_path}/art")
    assert [r["decision"] for r in again.decide(new).collect()] == [r["decision"] for r in artifact.decide(new).collect()]

    (tmp_path / "in").mkdir()
    new.write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in")
    route_stream(stream, artifact, f"{tmp_path}/out", f"{tmp_path}/chk").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2

    result = evaluation.evaluate_policy(history, artifact.select, 0.8)
    assert result["metrics"]["query_count"] == 90 and result["metrics"]["quality_pass_rate"] > 0.9
    report = evaluation.evaluate_predictor(history, predictor.predict_long(evaluation.requests_of(history)), ["east", "west"], 0.8, 5)
    assert report["pooled"]["observation_count"] == 180 and sum(b["count"] for b in report["pooled"]["bins"]) == 180


def test_training_guards(spark, fitted):
    history, _ = fitted
    with pytest.raises(ValueError, match="insufficient"):
        fit_predictor(history, ["east", "z"], FEATURES, TRAINING)
    with pytest.raises(ValueError, match="single label"):
        fit_predictor(history, ["east"], FEATURES, TrainingConfig(quality_score_threshold=0.1, min_model_samples=4))
    with pytest.raises(NotConverged):
        fit_predictor(history, ["east"], FEATURES, TrainingConfig(max_iter=1, min_model_samples=4))


def test_drifted_artifacts_are_rejected():
    with pytest.raises(ValueError, match="unsupported"):
        check_document({"artifact_version": 2})


def _toy(spark):
    """Three requests of two kinds, each answered by "low" and "high"; low passes one of three, high two."""
    rows = [
        ("i", "k1", "s", "where is the tide table", "low", "qa", 0.55, 1.5, 12.0), ("ii", "k1", "s", "where is the tide table", "high", "qa", 0.85, 4.5, 18.0),
        ("iii", "k2", "t", "import a csv in python", "low", "code", 0.8, 2.5, 16.0), ("iv", "k2", "t", "import a csv in python", "high", "code", 0.95, 6.0, 25.0),
        ("v", "k3", "t", "when do ferries leave", "low", "qa", 0.1, 2.0, 11.0), ("vi", "k3", "t", "when do ferries leave", "high", "qa", 0.79, 5.25, 21.0),
    ]
    return spark.createDataFrame(rows, "call_id string, query_id string, group_id string, query string, model_id string, task_type string, quality_score double, cost double, latency_ms double")


def test_baselines_and_observed_outcomes(spark):
    history = _toy(spark)
    own = summarize_models(history, ["low", "high"], 0.8)
    rules = {"code": "low", "math": "low", "summary": "low", "translation": "low", "qa": "high"}
    base = Baselines((ModelCandidate("low"), ModelCandidate("high")), own, RoutingPolicy(), rules, spark)
    assert (base.strongest_model, base.lowest_cost_model) == ("high", "low")
    m = evaluation.evaluate_policy(history, base.rule_based, 0.8)["metrics"]
    assert (m["quality_pass_rate"], m["average_cost"], m["fallback_rate"], m["normal_query_count"]) == (pytest.approx(2 / 3), pytest.approx((4.5 + 2.5 + 5.25) / 3), None, None)
    m = evaluation.evaluate_policy(history, base.global_historical, 0.8)
    assert m["metrics"]["fallback_rate"] == 1.0 and m["metrics"]["normal_routing_actual_pass_rate"] is None and set(m["by_task_type"]) == {"code", "qa"}
    with pytest.raises(ValueError, match="unobserved"):
        evaluation.evaluate_policy(history.where("call_id <> 'vi'"), base.rule_based, 0.8)
    with pytest.raises(Exception, match="blank"):
        base.strongest(spark.createDataFrame([("x", " ")], "query_id string, query string")).collect()


def test_calibration_bins(spark):
    rows = spark.createDataFrame([(1, 0.2), (0, 0.4), (1, 0.75), (1, 0.9), (0, 0.25), (0, 1.0)], "label int, probability double")
    found = evaluation.probability_diagnostics(rows, 4)
    assert [b["count"] for b in found["bins"]] == [1, 2, 0, 3] and found["brier_score"] == pytest.approx((0.64 + 0.16 + 0.0625 + 0.01 + 0.0625 + 1) / 6)
    assert found["bins"][3]["observed_pass_rate"] == pytest.approx(2 / 3) and found["bins"][2]["observed_pass_rate"] is None
    assert [b["count"] for b in evaluation.probability_diagnostics(rows, 10)["bins"]] == [0, 0, 2, 0, 1, 0, 0, 1, 0, 2]
    with pytest.raises(ValueError):
        evaluation.probability_diagnostics(rows.where("label > 5"), 2)


def _plain_features(texts, low, high, most):
    """Vocabulary, weights and vectors of the texts in plain Python."""
    texts = [t.strip() for t in texts]
    distinct = sorted(set(texts))

    def grams(t):
        norm = re.sub(r"\s\s+", " ", t.lower())
        return [norm[i : i + n] for n in range(low, high + 1) for i in range(len(norm) - n + 1)]

    total, documents = Counter(), Counter()
    for t in distinct:
        total.update(grams(t))
        documents.update(set(grams(t)))
    terms = [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]]
    idf = np.array([math.log((1 + len(distinct)) / (1 + documents[t])) + 1 for t in terms])

    def own(t):
        hint = re.search(r"(?i)```|\b(def|class|import|return|select)\b|python|sql", t)
        sign = re.search(r"[=+*/^]", t)
        return [math.log1p(len(t)), math.log1p(len(re.findall(r"[A-Za-z_]+|\d+(?:\.\d+)?", t))), bool(hint), any(c.isdigit() for c in t), bool(sign)]

    scale = np.array([own(t) for t in distinct], float).std(axis=0)
    scale[scale == 0] = 1

    def vector(t):
        count = Counter(grams(t))
        x = np.array([count[g] for g in terms]) * idf
        return np.concatenate([np.array(own(t), float) / scale, x / (np.linalg.norm(x) or 1)])

    return {t: vector(t) for t in distinct}


def _plain_regression(x, y, c):
    """Ridge logistic regression with a free intercept, by Newton's method."""
    n, w = len(y), np.zeros(x.shape[1] + 1)
    design = np.hstack([x, np.ones((n, 1))])
    ridge = np.diag([1 / (c * n)] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design / n + ridge, design.T @ (p - y) / n + ridge @ w)
        w -= step
    return lambda v: 1 / (1 + math.exp(-(np.append(v, 1) @ w)))


def test_learned_probabilities_and_routes_are_the_plain_ones(spark, fitted):
    history, predictor = fitted
    rows = history.collect()
    ids = ("east", "west")
    vectors = _plain_features([r["query"] for r in rows], 2, 3, 64)
    want = {}
    for m in ids:
        mine = [r for r in rows if r["model_id"] == m]
        p = _plain_regression(np.array([vectors[r["query"]] for r in mine]), np.array([float(r["quality_score"] >= 0.8) for r in mine]), TRAINING.C)
        want |= {(r["query_id"], m): p(vectors[r["query"]]) for r in mine}
    got = {(r["query_id"], r["model_id"]): r["probability"] for r in predictor.predict_long(evaluation.requests_of(history)).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6

    statistics = summarize_models(history, list(ids), 0.8)
    decided = decide(evaluation.requests_of(history), predictor, statistics, tuple(map(ModelCandidate, ids)), RoutingPolicy())
    for r in decided.collect():
        gated = [m for m in ids if want[r["query_id"], m] >= 0.8]
        best = min(gated, key=lambda m: (statistics[m].mean_cost, m)) if gated else max(ids, key=lambda m: want[r["query_id"], m])
        assert r["decision"]["selected_model"] == best and r["decision"]["fallback_used"] == (not gated)


def test_scoring_is_one_projection(spark, fitted):
    _, predictor = fitted
    statistics = {m: ModelStatistics(m, 1.0, 1.0, 1, 0.5, 0.5) for m in predictor.models}
    decided = decide(spark.range(3).selectExpr("concat('letter ', id) AS query"), predictor, statistics, tuple(map(ModelCandidate, predictor.models)), RoutingPolicy())
    plan = decided._jdf.queryExecution().executedPlan().toString()
    assert "ScalaUDF" not in plan and "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_all_models_are_fitted_in_few_passes(spark, monkeypatch):
    """Correlated dense columns of large mean, rare sparse ones, and repeated texts, against Newton's method."""
    rng = np.random.default_rng(3)
    n, wide, models = 400, 30, 3
    dense = np.column_stack([base := 8 + rng.normal(size=n), base + 0.1 * rng.normal(size=n), rng.integers(0, 2, n)])
    sparse = (rng.random((n, wide)) < 0.1) * rng.random((n, wide))
    seen = rng.integers(0, 3, (n, models))
    positive = rng.binomial(seen, 1 / (1 + np.exp(-(dense[:, :1] - 8 + sparse[:, :models] * 4))))
    rows = [(int(rng.integers(1 << 60)), d.tolist(), np.flatnonzero(s).tolist(), s[s > 0].tolist(), a.tolist(), b.tolist()) for d, s, a, b in zip(dense, sparse, seen, positive)]
    frame = spark.createDataFrame(rows, regression.ROWS).repartition(20).persist()
    passes, sums = [], regression._summed
    monkeypatch.setattr(regression, "_summed", lambda *x: passes.append(1) or sums(*x))
    found = regression.fit(frame, models, 3, wide, 2.0, 100)
    assert len(passes) < 30
    x = np.hstack([dense, sparse])
    for k, (intercept, w) in enumerate(found):
        plain = np.repeat(np.arange(n), seen[:, k])
        y = np.concatenate([np.arange(a) < b for a, b in zip(seen[:, k], positive[:, k])]).astype(float)
        p = _plain_regression(x[plain], y, 2.0)
        assert max(abs(1 / (1 + math.exp(-(v @ w + intercept))) - p(v)) for v in x) < 1e-6
    frame.unpersist()


def test_a_policy_may_be_a_python_function(spark):
    history = _toy(spark)
    select = evaluation.python_selector(lambda text: "high" if "wh" in text else "low")
    m = evaluation.evaluate_policy(history, select, 0.8)["metrics"]
    assert (m["quality_pass_rate"], m["average_cost"], m["fallback_rate"]) == (pytest.approx(2 / 3), pytest.approx(12.25 / 3), None)


def test_percentiles_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.random(), float(rng.randint(0, 9)), 1e6 * rng.random()])) for k in ("x", "y", None) for _ in range(rng.randint(50, 400))] + [("one", 5.0), ("x", None)]
    found = evaluation.latency_percentiles(spark.createDataFrame(rows, "k string, v double"), "v", "k").collect()
    assert len(found) == 4
    for r in found:
        mine = [v for k, v in rows if k == r["k"] and v is not None]
        assert (r["observation_count"], r["mean"], r["p50"], r["p95"]) == (len(mine), pytest.approx(np.mean(mine)), pytest.approx(np.percentile(mine, 50)), pytest.approx(np.percentile(mine, 95)))
    # One huge value doesn't crowd the others into one cell, and cells follow the order of values.
    tail = spark.createDataFrame([(rng.random(),) for _ in range(4000)] + [(1e12,)], "v double")
    assert tail.groupBy(evaluation._cell(F.col("v"))).count().agg(F.max("count")).first()[0] < 40
    values = sorted([0.0, -0.0, 5e-324, 1.0, 2.0, 4.0, 1e308, -1e308, *(s * m * 2.0**e * (1 + d) for e in range(-60, 60, 7) for s in (1, -1) for m in (1.0, 1.7) for d in (0, 2e-16, -1e-16))])
    found = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(evaluation._cell(F.col("v"))).collect()]
    assert found == sorted(found)
    everything = evaluation.latency_percentiles(spark.createDataFrame(rows, "k string, v double"), "v").first()
    assert everything["p95"] == pytest.approx(np.percentile([v for _, v in rows if v is not None], 95))
