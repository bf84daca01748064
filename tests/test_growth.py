"""Steps whose work or memory once grew faster than their input."""

import random
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routeloom.contracts import FeatureConfig, TrainingConfig
from routeloom.functions import text as tx
from routeloom.learning import features, predictor, regression
from routeloom.plans import observations, queries


def test_the_driver_gets_one_sample_whatever_the_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(regression, "SAMPLE", 64)
    wide, n = 400, 2_000
    rows = spark.range(0, n, 1, 25).select(
        F.xxhash64("id").alias("draw"), F.array(F.rand(1)).alias("dense"), F.sequence(F.lit(0), F.lit(wide - 1)).alias("positions"),
        F.transform(F.sequence(F.lit(1), F.lit(wide)), lambda k: F.rand(2) * k).alias("weights"), F.array(F.lit(1).cast("long")).alias("seen"), F.array((F.col("id") % 2)).alias("positive"),
    )
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    # 64 rows are 0.3 MB; 64 of each of 25 tasks are 8.
    conf.set("spark.driver.maxResultSize", "2m")
    try:
        found = regression._Curvature(rows, n, 1, np.zeros(1 + wide), np.ones(1 + wide), 1.0, 1.0)
    finally:
        conf.set("spark.driver.maxResultSize", before)
    assert 32 < len(found.half) <= 64 and np.isfinite(found.half).all()


def test_a_sample_without_rows_leaves_each_column_for_itself(spark):
    rows = spark.createDataFrame([(1, [1.0], [0], [1.0], [1], [k % 2]) for k in range(20)], regression.ROWS)
    found = regression._Curvature(rows, 10**9, 1, np.zeros(2), np.ones(2), 1.0, 1.0)
    assert np.isfinite(found(np.ones(3), 1.0)).all()


def test_a_text_is_held_once_for_all_models(spark, monkeypatch):
    rows = [(f"letter {i} of the harbour" + " " * k, m, (i * 7 + k) % 10 / 10) for i in range(40) for k, m in enumerate("abcde")]
    held, fit = [], regression.fit
    monkeypatch.setattr(predictor, "fit_distinct", lambda texts, config, f=features.fit_distinct: held.append((texts.is_cached, texts.count())) or f(texts, config))
    monkeypatch.setattr(regression, "fit", lambda rows, *x: held.append((rows.is_cached, rows.count())) or fit(rows, *x))
    history = spark.createDataFrame(rows, "query string, model_id string, quality_score double")
    found = predictor.fit_predictor(history, list("abcde"), FeatureConfig((2, 3), 40), TrainingConfig(min_model_samples=4))
    assert held == [(True, 40), (True, 40)]
    passed = sum(q >= 0.8 for _, m, q in rows if m == "c")
    assert found.training_counts["c"] == {"observation_count": 40, "positive_count": passed, "negative_count": 40 - passed, "positive_rate": passed / 40}


@pytest.mark.parametrize("low, high", [(1, 3), (2, 4), (3, 12)])
def test_ngrams_are_counted_and_found_as_one_by_one(low, high, monkeypatch):
    rng = random.Random(high)
    for _ in range(30):
        texts = ["".join(rng.choice("ab c\0é𝒳汉") for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))) for _ in range(rng.randint(1, 9))]
        own, plain = ({t: (int(n), int(d)) for t, n, d in zip(*count(texts, low, high))} for count in (features.count_ngrams, features._counted_singly))
        assert own == plain
        places = {t: k for k, t in enumerate(t for t in plain if rng.random() < 0.5)}
        for most in (features.TABLE, 1):
            monkeypatch.setattr(features, "TABLE", most)
            weigh = features.Weigh(low, high, places, np.ones(len(places)))
            for t in texts:
                assert sorted(weigh.found(t)) == sorted(places[g] for n in range(low, high + 1) for i in range(len(t) - n + 1) if (g := t[i : i + n]) in places)


def test_ngrams_are_counted_in_less_than_half_the_time():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3_000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(200)]

    def seconds(count):
        began = time.process_time()
        count(texts, 2, 4)
        return time.process_time() - began

    assert seconds(features.count_ngrams) < seconds(features._counted_singly) / 2


def test_texts_are_dealt_by_their_number_and_never_sorted(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(i, f"text {i % 70}", "s", "l", 9) for i in range(90)], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(features, "TASK_TEXTS", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = queries._dealt_texts(spark, str(tmp_path))
        plan = texts._jdf.queryExecution().executedPlan().toString()
        assert texts.rdd.getNumPartitions() == 18 and texts.count() == 70
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    assert {r["query_id"] for r in queries.tfidf_weights(spark, str(tmp_path)).collect()} == set(range(70))


#: The hints as patterns, without regard to case as Java has it.
WORD = tx.WORD
PATTERNS = {
    "code": rf"(?iu)```|(?<!{WORD})(?:def|class|import|return|SELECT)(?!{WORD})|代码|编程|Python|SQL",
    "translation": r"(?iu)翻译|译成|译为|translate",
    "summary": r"(?iu)摘要|总结|概括|提炼|summari",
    "math": r"[=+*/^∑∫√≤≥×÷]|\\(?:frac|sum|sqrt)|计算|求解|证明|概率|方程|几何|数列",
}


def _by_patterns(text):
    hint = F.when(F.lit(False), "")
    for name, pattern in PATTERNS.items():
        hint = hint.when(text.rlike(pattern), name)
    return hint.otherwise("qa")


def test_hints_are_those_of_the_patterns(spark):
    rng = random.Random(8)
    parts = ["def", "DEF", "claſs", "İmport", "ımport", "return", "SELECT", "ſelect", "ſQL", "python", "```", "代码", "翻译", "Tranſlate", "译为", "ſUMMARİ", "summar", "概括", "\\frac", "\\Frac", "\\sum", "=", "×", "数列", "_", "9", "é", "²", " ", " ", ".", "\n", "σΣ", "K", "import"]
    texts = [("".join(rng.choices(parts, k=rng.randint(0, 4))),) for _ in range(4_000)] + [(None,)]
    rows = spark.createDataFrame(texts, "t string").select("t", tx.task_type_hint(F.col("t")).alias("hint"), _by_patterns(F.col("t")).alias("want"), tx.is_code(F.col("t")).alias("code"), F.col("t").rlike(PATTERNS["code"]).alias("want_code")).collect()
    assert [r for r in rows if r["hint"] != r["want"] or r["code"] != r["want_code"]] == []
    assert {r["hint"] for r in rows} == {*PATTERNS, "qa"}


def _as_before(text):
    """The same hints as they once were: every text that isn't ASCII is replaced character by character, then patterns are tried."""
    low = F.lower(F.when(tx.is_ascii(text), text).otherwise(F.translate(text, tx.FOLDS, tx.FOLDED)))
    some = F.lit(False)
    for word in (*tx.CODE_WORDS, *tx.KEYWORDS):
        some = some | low.contains(word)
    hint = F.when(some & text.rlike(PATTERNS["code"]), "code")
    for name in ("translation", "summary", "math"):
        hint = hint.when(text.rlike(PATTERNS[name]), name)
    return hint.otherwise("qa")


def test_hints_take_less_time_than_before(spark):
    body = "an important é word of the classes that undefined returns selected " * 2_000
    rows = spark.range(0, 64, 1, 4).select(F.concat(F.lit(body), F.col("id").cast("string")).alias("t")).persist()
    rows.count()

    def seconds(hint):
        began = time.monotonic()
        rows.select(hint).write.format("noop").mode("overwrite").save()
        return time.monotonic() - began

    try:
        assert min(seconds(tx.task_type_hint(F.col("t"))) for _ in range(3)) < 0.75 * min(seconds(_as_before(F.col("t"))) for _ in range(3))
    finally:
        rows.unpersist()


def test_packed_rows_are_the_rows_as_arrays_and_a_quarter_of_them():
    rng = np.random.default_rng(4)
    for wide, most in ((300, 200), (300, 400), (70_000, 3)):
        counts = [rng.integers(1, most, k) for k in (0, 40, 7, 90)]
        positions = [np.sort(rng.choice(wide, len(c), replace=False)).astype(np.int32) for c in counts]
        scale, factor = rng.random(4), rng.random(wide)
        common = {"dense": pa.array(rng.random((4, 2)).tolist()), "seen": pa.array(rng.integers(1, 3, (4, 2)).tolist()), "positive": pa.array([[1, 0]] * 4)}
        weights = [c * s * factor[p] for c, s, p in zip(counts, scale, positions)]
        plain = pa.record_batch(common | {"positions": pa.array(positions), "weights": pa.array(weights)})
        made = [regression.pack(p, c, wide) for p, c in zip(positions, counts)]
        packed = pa.record_batch(common | {"positions": pa.array([x[0] for x in made]), "counts": pa.array([x[1] for x in made]), "scale": pa.array(scale)})
        if most == 200:
            assert 4 * sum(len(x) for row in made for x in row) == sum(map(len, counts)) * 12
        weighed = SimpleNamespace(value=(rng.normal(size=(2, 2 + wide)), rng.normal(size=2)))
        for of in (regression._moments, lambda factor: regression._losses(factor, weighed)):
            for batches in ((plain, packed), (plain.slice(1), packed.slice(1))):
                a, b = (of(f)(regression._Block(batch, wide)) for batch, f in zip(batches, (np.ones(wide), factor)))
                assert np.allclose(a, b, rtol=1e-12, atol=1e-12)


def test_many_rows_take_few_passes(spark, monkeypatch):
    """Columns that go with each other, of more directions than a sample of 1,024 rows shows, and little ridge."""
    rng = np.random.default_rng(6)
    n, wide = 6_000, 600
    x = np.exp(rng.normal(size=(n, 300)) @ rng.normal(size=(300, wide)) / 20) * (rng.random((n, wide)) < 0.3)
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    y = (rng.random(n) < 0.2).astype(int)
    rows = [(int(rng.integers(1 << 60)), [1.0 * (i % 2)], np.flatnonzero(r).tolist(), r[r > 0].tolist(), [1], [int(k)]) for i, (r, k) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(rows, regression.ROWS).repartition(4).persist()
    passes, sums = [], regression._summed
    monkeypatch.setattr(regression, "_summed", lambda *x: passes.append(1) or sums(*x))
    regression.fit(frame, 1, 1, wide, 500.0, 200)
    frame.unpersist()
    assert len(passes) < 20


def test_a_text_is_scored_once_for_all_models(spark):
    models = {m: predictor.LinearModel(0.5, (0.1,) * 5) for m in ("east", "west")}
    own = predictor.QualityPredictor(features.FeatureModel(FeatureConfig(), (1.0,) * 5, (), ()), TrainingConfig(), models)
    found = own.predict_long(spark.range(3).selectExpr("id AS query_id", "concat('letter ', id) AS query"))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert found.count() == 6


def test_requests_are_scored_by_the_features_of_the_fit(spark, tmp_path):
    """Texts that differ in white space only, some of it not ASCII, are several requests and one text of the fit."""
    texts = [f"letter {i} of {'x = y ' * (i % 4)} the harbour {'abc'[i % 3] * 3}" for i in range(120)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, t + " ", "en", "s", 9 + i) for i, t in enumerate(texts[:20])] + [(2000 + i, " " + t, "en", "s", 7) for i, t in enumerate(texts[:9])] + [(3000, " \n", "en", "s", 2), (3001, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = observations.documents(spark, str(tmp_path))
    history = observations.request_texts(docs).join(observations.observations(docs), "query_id").select("query", "model_id", "quality_score")
    plain = predictor.fit_predictor(history, observations.MODEL_IDS).predict_long(observations.request_texts(docs))
    want = {(r["query_id"], r["model_id"]): r["probability"] for r in plain.collect()}
    found = queries.learned_pass_probability(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "documents.parquet" not in plan
    got = {(r["query_id"], r["model_id"]): r["probability"] for r in found.collect()}
    assert len(want) == 140 * 5 and got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6
    assert queries.learned_route(spark, str(tmp_path)).count() == 140
