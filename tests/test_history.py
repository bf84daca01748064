import hashlib
import json

import pytest

from routeloom.contracts import OBSERVATION
from routeloom.operators import splitting, validation
from routeloom.sources import sealed
from routeloom.sources.fixtures import DEFAULT, generate, write_dataset
from routeloom.sources.history import REQUIRED, load_history, load_sealed, load_verified

NAMES = [f.name for f in OBSERVATION]
HINTS = ("code", "math", "summary", "translation", "qa")
CONFIG = {
    "models": [{"model_id": m, "enabled": True} for m in ("m1", "m2")],
    "generator": DEFAULT | {"profiles": {m: {"skill": dict.fromkeys(HINTS, 0.9 - k / 10), "price_per_1000": 0.02 + k, "first_ms": 500.0 + k, "ms_per_char": 0.5} for k, m in enumerate(("m1", "m2"))}},
}


def _row(**change):
    base = {"call_id": "c1", "query_id": "q1", "group_id": "g1", "query": "what?", "model_id": "a", "task_type": "qa", "quality_score": 0.5, "cost": 1.0, "latency_ms": 2.0}
    return base | change


def _frame(spark, *rows):
    return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], OBSERVATION)


@pytest.mark.parametrize(
    "rows,rule",
    [
        ([_row(), _row(query_id="q2", query="other")], "duplicate call_id"),
        ([_row(), _row(call_id="c2", model_id="b", group_id="g2")], "query identity"),
        ([_row(), _row(call_id="c2", query_id="q2", query=" what?\x1f ")], "text identity"),
        ([_row(query="　")], "field"),
        ([_row(quality_score=float("nan"))], "field"),
        ([_row(cost=-0.01)], "field"),
        ([_row(latency_ms=float("inf"))], "field"),
        ([_row(quality_score=1.001)], "field"),
    ],
)
def test_violations(spark, rows, rule):
    assert rule in {r["rule"] for r in validation.violations(_frame(spark, *rows)).collect()}
    with pytest.raises(ValueError, match=rule):
        validation.validate_history(_frame(spark, *rows))


def test_models_and_coverage(spark):
    frame = _frame(spark, _row(), _row(call_id="c2", model_id="b"), _row(call_id="c3", query_id="q2", query="else"))
    validation.validate_history(frame, ["a", "b"])
    with pytest.raises(ValueError, match="unknown model"):
        validation.validate_history(frame, ["a"])
    with pytest.raises(ValueError, match="coverage"):
        validation.validate_history(frame, ["a", "b"], full_coverage=True)
    with pytest.raises(ValueError, match="empty"):
        validation.validate_history(_frame(spark))


def _write(path, *lines):
    path.write_text("".join(x + "\n" for x in lines), encoding="utf-8")
    return str(path)


def test_strict_lines(spark, tmp_path):
    good = json.dumps(_row())
    assert load_history(spark, _write(tmp_path / "ok.jsonl", good)).count() == 1
    bad = [json.dumps(_row(query=123)), json.dumps({k: v for k, v in _row().items() if k != "cost"}), json.dumps(_row(extra=1)), "", "[1]", json.dumps(_row(cost="1")), json.dumps(_row(cost=True))]
    for k, line in enumerate(bad):
        with pytest.raises(ValueError, match="line 2"):
            load_history(spark, _write(tmp_path / f"bad{k}.jsonl", good, line))


def test_fixture_is_repeatable_and_verified(spark, tmp_path):
    first = sorted(map(tuple, generate(spark, CONFIG).collect()))
    assert first == sorted(map(tuple, generate(spark, CONFIG).repartition(7).collect()))
    path = write_dataset(spark, CONFIG, str(tmp_path))
    assert sealed.current(spark, str(tmp_path)) == path
    history, manifest = load_sealed(spark, path, ["m1", "m2"])
    assert sorted(map(tuple, history.select(*NAMES).collect())) == first and len(first) == manifest["observation_count"]
    with pytest.raises(ValueError, match="code must be"):
        profiles = {m: {k: v for k, v in p.items() if k != "first_ms"} | {"first_ms": 1.0, "skill": {}} for m, p in CONFIG["generator"]["profiles"].items()}
        generate(spark, CONFIG | {"generator": CONFIG["generator"] | {"profiles": profiles}})


def test_one_file_and_its_manifest(spark, tmp_path):
    data, at = tmp_path / "h.jsonl", tmp_path / "h.json"
    data.write_text("".join(json.dumps(_row(call_id=f"c{k}", model_id=m)) + "\n" for k, m in enumerate("ab")))
    manifest = dict.fromkeys(REQUIRED, "x") | {"source_kind": "synthetic", "coverage_kind": "full", "quality_score_range": [0.0, 1.0], "latency_unit": "ms", "sha256": hashlib.sha256(data.read_bytes()).hexdigest()}
    at.write_text(json.dumps(manifest))
    assert load_verified(spark, str(data), str(at), ["a", "b"])[0].count() == 2
    at.write_text(json.dumps({k: v for k, v in manifest.items() if k != "seed"}))
    with pytest.raises(ValueError, match="lacks"):
        load_verified(spark, str(data), str(at), ["a", "b"])
    at.write_text(json.dumps(manifest))
    data.write_text(data.read_text() + "\n")
    with pytest.raises(ValueError, match="SHA-256"):
        load_verified(spark, str(data), str(at), ["a", "b"])


@pytest.mark.parametrize("split", [splitting.group_split, splitting.group_split_by_hash])
def test_splits_keep_groups_whole(spark, split):
    history = generate(spark, CONFIG)
    rows = split(history).select("group_id", "split", "call_id").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in groups.values()) and len(rows) == history.count()
    sizes = {name: sum(s == {name} for s in groups.values()) for name in splitting.SPLITS}
    assert sizes["train"] == int(0.6 * len(groups)) and all(sizes.values())
    assert sorted(map(tuple, split(history.repartition(3)).select("group_id", "split").distinct().collect())) == sorted((g, *s) for g, s in groups.items())
    with pytest.raises(ValueError):
        split(history, train_fraction=0.9, validation_fraction=0.2)


def test_experiment_reports_all_policies(spark, tmp_path):
    from routeloom.plans.experiment import run_experiment

    skills = {"m1": 0.75, "m2": 0.45}
    config = {
        "models": CONFIG["models"], "rules": dict.fromkeys(HINTS, "m1"), "policy": {"router_probability_threshold": 0.5}, "features": {"ngram_range": [2, 2], "max_features": 40},
        "training": {"quality_score_threshold": 0.5, "C": 0.05, "min_model_samples": 4}, "split": {"train_fraction": 0.6, "validation_fraction": 0.2, "seed": 3},
        "evaluation": {"probability_bins": 5, "timing_warmup_queries": 1, "timing_queries": 3},
        "generator": DEFAULT | {"profiles": {m: {"skill": dict.fromkeys(HINTS, x), "price_per_1000": 1.0, "first_ms": 100.0, "ms_per_char": 0.5} for m, x in skills.items()}},
    }
    report = run_experiment(spark, generate(spark, config), config, {"source_kind": "synthetic"}, str(tmp_path))
    held = report["held_out"]["test"]
    assert set(held["policies"]) == {"query_aware_router", "always_strongest", "always_lowest_cost", "rule_based", "global_historical_router"}
    assert held["runtime"]["single"]["query_count"] == 3 and 0 < held["runtime"]["single"]["p50_ms"] <= held["runtime"]["single"]["p95_ms"]
    assert held["runtime"]["batch"]["query_count"] == held["policies"]["rule_based"]["metrics"]["query_count"]
    assert json.loads((tmp_path / "report.json").read_text())["data"]["splits"] == report["data"]["splits"]
    with pytest.raises(ValueError, match="numeric_threads"):
        run_experiment(spark, generate(spark, config), config | {"evaluation": {"probability_bins": 5, "numeric_threads": 0}}, {})
