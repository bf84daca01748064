"""Sealed data sets, line numbers, as-of joins, grouping sets and streams of outcomes."""

import bisect
import datetime
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from routeloom.contracts import OBSERVATION
from routeloom.operators import evaluation, sketches
from routeloom.operators.as_of import as_of_join
from routeloom.operators.statistics import model_statistics
from routeloom.sources import sealed
from routeloom.sources.history import first_problem, load_history
from routeloom.streaming.outcomes import decisions_with_outcomes, model_estimates, windowed_sums

START = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)


def _observations(n, seed=1):
    rng = random.Random(seed)
    return [(f"c{i}", f"q{i}", f"g{i % 5}", f"text {i}", rng.choice("xxxyz"), "qa", round(rng.random(), 3), round(rng.random() * 9, 4), float(rng.randint(1, 900))) for i in range(n)]


# Sealed data sets.


def test_changed_files_are_named(spark, tmp_path):
    rows = spark.createDataFrame(_observations(90), OBSERVATION).repartition(6)
    path = sealed.seal(rows, str(tmp_path), {"note": "first"}, file_rows=5)
    assert sealed.current(spark, str(tmp_path)) == path and sealed.verify(spark, path)["note"] == "first"
    assert load_history(spark, f"{path}/data/part-*").count() == 90
    files = sorted((tmp_path / path / "data").glob("part-*"))
    assert len(files) > 12
    # Local files have checksums of Hadoop's own, which would notice first.
    for own in (tmp_path / path / "data").glob(".*.crc"):
        own.unlink()
    kept = {f.name: f.read_bytes() for f in files}

    def problems():
        with pytest.raises(sealed.ChangedData, match="SHA-256") as caught:
            sealed.verify(spark, path)
        return caught.value.problems

    changed = files[4]
    changed.write_bytes(kept[changed.name].replace(b"text", b"tExt", 1))
    assert problems() == [(changed.name, "was changed")]
    changed.write_bytes(kept[changed.name])
    files[7].unlink()
    (files[0].parent / "part-extra.json").write_bytes(b"{}\n")
    assert problems() == sorted([(files[7].name, "is missing"), ("part-extra.json", "wasn't there")])
    files[7].write_bytes(kept[files[7].name])
    (files[0].parent / "part-extra.json").unlink()
    sealed.verify(spark, path)
    # Swapped contents are two changes, and a table of digests that was made to fit them isn't the manifest's.
    files[1].write_bytes(kept[files[2].name])
    files[2].write_bytes(kept[files[1].name])
    assert [f for f, _ in problems()] == [files[1].name, files[2].name]
    for old in (tmp_path / path / "digests").iterdir():
        old.unlink()
    sealed.leaves(spark, f"{path}/data/part-*").write.mode("append").parquet(f"{path}/digests")
    assert problems() == [("digests", "was changed")]


def test_a_failed_write_leaves_the_current_data_set(spark, tmp_path):
    first = sealed.seal(spark.createDataFrame(_observations(5), OBSERVATION), str(tmp_path), {})
    bad = spark.createDataFrame(_observations(5), OBSERVATION).withColumn("query", F.raise_error(F.lit("no more")).cast("string"))
    with pytest.raises(Exception, match="no more"):
        sealed.seal(bad, str(tmp_path), {})
    assert sealed.current(spark, str(tmp_path)) == first
    second = sealed.seal(spark.createDataFrame(_observations(6), OBSERVATION), str(tmp_path), {})
    assert sealed.current(spark, str(tmp_path)) == second != first and not list(tmp_path.glob("CURRENT.*"))


def test_first_bad_line_of_many_files(spark, tmp_path):
    names = [f.name for f in OBSERVATION]
    lines = [json.dumps(dict(zip(names, r))) for r in _observations(3000)]
    for k in range(3):
        own = lines[k * 1000 : (k + 1) * 1000]
        if k > 0:
            own[700 + k], own[900] = "{}", "[]"
        (tmp_path / f"h{k}.jsonl").write_text("\n".join(own) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        file, number, problem = first_problem(spark, str(tmp_path))
        assert (file.rsplit("/", 1)[-1], number, problem) == ("h1.jsonl", 702, "missing key")
        assert first_problem(spark, f"{tmp_path}/h2.jsonl")[1] == 703 and first_problem(spark, f"{tmp_path}/h0.jsonl") is None
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "empty.jsonl").write_text("")
    assert first_problem(spark, f"{tmp_path}/empty.jsonl") is None


# As-of joins.


@pytest.mark.parametrize("cuts", [1, 7, 64])
def test_as_of_by_brute_force(spark, cuts):
    rng = random.Random(cuts)
    keys = ["hot"] * 6 + ["a", "b", None]
    rows = [(i, rng.choice(keys), rng.choice([None, *range(40)] + list(range(500)))) for i in range(600)] + [(1, "hot", 3), (1, "hot", 3)]
    states = [(rng.choice(keys), rng.choice([None, *range(20, 520)]), float(i), None if i % 9 == 0 else f"s{i}") for i in range(200)]
    left = spark.createDataFrame(rows, "n int, k string, t long").repartition(5)
    right = spark.createDataFrame(states, "k string, t long, v double, w string").repartition(3)
    held = defaultdict(list)
    for k, t, v, w in states:
        if k is not None and t is not None:
            held[k].append((t, v, w or "", w))
    want = []
    for n, k, t in rows:
        own = sorted(held[k], key=lambda s: s[:3]) if k is not None and t is not None else []
        at = bisect.bisect_right([s[0] for s in own], t) if own else 0
        want.append((n, k, t, *((own[at - 1][1], own[at - 1][3]) if at else (None, None))))
    got = as_of_join(left, right, ["k"], "t", cuts)
    assert got.columns == ["n", "k", "t", "v", "w"] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert as_of_join(left, right.limit(0), ["k"], "t", cuts).where("v IS NOT NULL").isEmpty() and as_of_join(left.limit(0), right, ["k"], "t", cuts).isEmpty()
    with pytest.raises(ValueError, match="both"):
        as_of_join(left, right.withColumn("n", F.lit(1)), ["k"], "t")


def test_a_hot_key_is_dealt_to_many_tasks(spark):
    left = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    right = spark.range(0, 20_000, 10).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = as_of_join(left, right, ["k"], "t")
        assert found.where("v <> t - t % 10").isEmpty()
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 12 and max(sizes) < 20_000 / 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# Grouping sets.


def test_grouping_sets_are_the_groupings_from_one_scan(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["m", "n", None]), rng.choice(["qa", "code"]), rng.random() < 0.5, rng.random(), rng.random(), rng.random(), rng.choice([True, False])) for _ in range(200)]
    frame = spark.createDataFrame(rows, "selected_model string, task_type string, fallback_used boolean, observed_quality_score double, observed_cost double, observed_latency_ms double, quality_pass boolean")
    found = evaluation.outcome_metrics_by_sets(frame, [[], ["selected_model"], ["selected_model", "task_type"]])
    for level, by in ((3, []), (1, ["selected_model"]), (0, ["selected_model", "task_type"])):
        columns = [*by, *evaluation.METRICS]
        own = {tuple(r[c] for c in by): r for r in found.where(F.col("level") == level).collect()}
        want = {tuple(r[c] for c in by): r for r in evaluation.outcome_metrics(frame, *by).collect()}
        assert own.keys() == want.keys()
        assert all(own[k][c] == (pytest.approx(want[k][c]) if isinstance(want[k][c], float) else want[k][c]) for k in own for c in columns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Scan") == 1


# Policies as table functions.


def test_a_policy_through_sql_and_through_evaluation(spark):
    rows = [(f"c{i}{m}", f"q{i}", "g", f"{'long' if i % 3 else 'short'} text {i}", m, "qa", 0.9 if (m == "x") == (i % 3 > 0) else 0.2, 1.0, 2.0) for i in range(30) for m in "xy"]
    history = spark.createDataFrame(rows, OBSERVATION)

    def choose(text):
        return "x" if text.startswith("long") else "y"

    select = evaluation.register_selector(spark, "by_length", choose)
    evaluation.requests_of(history).createOrReplaceTempView("asked_requests")
    told = spark.sql("SELECT selected_model, count(*) AS n FROM by_length(TABLE(SELECT query_id, query FROM asked_requests)) GROUP BY ALL").collect()
    assert {tuple(r) for r in told} == {("x", 20), ("y", 10)}
    metrics = evaluation.evaluate_policy(history, select, 0.8)["metrics"]
    other = evaluation.evaluate_policy(history, evaluation.python_selector(choose), 0.8)["metrics"]
    assert metrics == {k: v if v is None else pytest.approx(v) for k, v in other.items()} and metrics["quality_pass_rate"] == 1.0
    with pytest.raises(Exception, match="blank"):
        select(spark.createDataFrame([("z", " ")], "query_id string, query string")).collect()


# Streams.


def _stream(spark, folder, batches, schema):
    """A stream with one file a micro-batch, in this order."""
    folder.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder / f"b{k:02d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(folder))


def _run(stream, tmp_path, name):
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return stream.sparkSession.read.parquet(str(tmp_path / name))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_gives_the_batch_statistics(spark, tmp_path, seed):
    rng = random.Random(seed)
    schema = "call_id string, model_id string, quality_score double, cost double, latency_ms double, observed_at timestamp"
    rows = [(r[0], r[4], r[6], r[7], r[8], START + datetime.timedelta(minutes=rng.randint(0, 3 * 24 * 60))) for r in _observations(120, seed)]
    sent = rows + rng.sample(rows, 15)
    rng.shuffle(sent)
    # A last row much later lets the watermark pass all the others' windows.
    last = [("end", "x", 0.5, 1.0, 1.0, START + datetime.timedelta(days=30))]
    stream = _stream(spark, tmp_path / "in", [sent[k::4] for k in range(4)] + [last], schema)
    found = _run(windowed_sums(stream, 0.5, late="4 days"), tmp_path, "out")
    want = windowed_sums(spark.createDataFrame(sent, schema), 0.5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    batch = model_statistics(spark.createDataFrame(rows, schema), 0.5).select("model_id", "observation_count", "mean_cost", "mean_latency_ms", "mean_quality", "pass_rate")
    assert sorted(map(tuple, model_estimates(found).collect())) == sorted(map(tuple, batch.collect()))


def test_decisions_meet_late_missing_and_repeated_outcomes(spark, tmp_path):
    def at(minutes):
        return START + datetime.timedelta(minutes=minutes)

    decisions = [("q1", "a", at(0)), ("q2", "a", at(1)), ("q3", "b", at(2)), ("q4", "b", at(3)), ("q5", "a", at(4))]
    outcomes = [
        ("q1", "a", at(30), 0.5), ("q1", "a", at(31), 0.7),  # repeated
        ("q2", "b", at(5), 0.1),  # another model's
        ("q3", "b", at(62), 0.9),  # in time by no minute
        ("q4", "b", at(64), 0.9),  # too late
    ]
    sides = {"decisions": ("query_id string, selected_model string, decided_at timestamp", decisions), "outcomes": ("query_id string, model_id string, observed_at timestamp, quality double", outcomes)}
    end = {"decisions": [("end", "a", at(9_000))], "outcomes": [("end", "b", at(9_000), 0.0)]}
    streams = {k: _stream(spark, tmp_path / k, [rows[:2], rows[2:], end[k], [(f"{end[k][0][0]}2", *end[k][0][1:])]], schema) for k, (schema, rows) in sides.items()}
    found = _run(decisions_with_outcomes(streams["decisions"], streams["outcomes"], late="2 hours"), tmp_path, "out").where("query_id LIKE 'q%'").collect()
    want = {"q1": (0.5, True), "q2": (None, False), "q3": (0.9, True), "q4": (None, False), "q5": (None, False)}
    assert {r["query_id"]: (r["quality"], r["observed"]) for r in found} == want and len(found) == 5
    tables = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in sides.items()}
    assert {r["query_id"]: (r["quality"], r["observed"]) for r in decisions_with_outcomes(tables["decisions"], tables["outcomes"]).collect()} == want


# Sketches.

SHARES = {"least": 0.0, "quarter": 0.25, "middle": 0.5, "most": 0.95, "nearly_all": 0.999, "largest": 1.0}


def _share_near(values, estimate, share):
    values = sorted(values)
    below, to = bisect.bisect_left(values, estimate) / len(values), bisect.bisect_right(values, estimate) / len(values)
    return below <= share + sketches.RANK_ERROR and to >= share - sketches.RANK_ERROR


def test_merged_sketches_keep_ranks_on_heavy_tails(spark):
    """Key x has most rows; values grow far beyond what a mean could show, and days differ in size and place."""
    rng = random.Random(11)
    rows = [(rng.choice("xxxxxxy"), int(rng.random() ** 3 * 20), rng.paretovariate(0.6)) for _ in range(40_000)] + [("x", 3, 1e300), ("y", 3, -5.0), ("z", 1, 4.5)]
    table = spark.createDataFrame(rows, "model string, day int, v double").repartition(12)
    daily = sketches.value_sketches(table, "v", "model", "day").persist()
    assert daily.count() == len({r[:2] for r in rows})
    # By way of weeks, or all at once.
    weekly = sketches.merge_sketches(daily.withColumn("week", F.expr("day div 7")), "model", "week")
    for merged in (sketches.merge_sketches(daily, "model"), sketches.merge_sketches(weekly, "model"), sketches.value_sketches(table, "v", "model")):
        # Sketches that are made again differ, so the values are kept.
        kept = sketches.sketch_percentiles(merged, SHARES, "model").collect()
        found, estimates = {r["model"]: r.asDict() for r in kept}, spark.createDataFrame(kept)
        for model in "xyz":
            values = [v for m, _, v in rows if m == model]
            got = found[model]
            assert (got["observation_count"], got["least"], got["largest"]) == (len(values), min(values), max(values))
            assert all(_share_near(values, got[name], share) for name, share in SHARES.items())
        ranks = {r["model"]: r for r in sketches.ranks_of(table, estimates, "v", ["middle"], "model").collect()}
        values = [v for m, _, v in rows if m == "x"]
        assert ranks["x"]["middle_below"] == pytest.approx(sum(v < found["x"]["middle"] for v in values) / len(values))
        assert ranks["x"]["middle_to"] == pytest.approx(sum(v <= found["x"]["middle"] for v in values) / len(values))
    daily.unpersist()


def test_sketches_of_odd_rows(spark):
    """Null, infinite and undefined values are no values; null keys are a key; columns may be named as the operator's own."""
    inf, nan = float("inf"), float("nan")
    table = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", nan), ("b", inf), ("b", -inf), ("b", 7.0)] * 3, "key string, v double")
    made = sketches.value_sketches(table, "v", "key")
    found = {r["key"]: (r["observation_count"], r["least"], r["largest"]) for r in sketches.sketch_percentiles(made, SHARES, "key").collect()}
    assert found == {None: (6, 1.0, 3.0), "b": (3, 7.0, 7.0)}
    ranks = {r["key"]: (r["largest_below"], r["largest_to"]) for r in sketches.ranks_of(table, sketches.sketch_percentiles(made, SHARES, "key"), "v", ["largest"], "key").collect()}
    assert ranks == {None: (0.5, 1.0), "b": (0.0, 1.0)}
    whole = sketches.sketch_percentiles(sketches.merge_sketches(made), SHARES).collect()
    assert [(r["observation_count"], r["least"], r["largest"]) for r in whole] == [(9, 1.0, 7.0)]
    assert sketches.value_sketches(table.limit(0), "v", "key").count() == sketches.value_sketches(table.limit(0), "v").count() == 0
    assert sketches.merge_sketches(made.limit(0)).count() == 0
    missing = made.select("key", F.lit(None).cast("binary").alias("sketch"))
    assert sketches.merge_sketches(missing.unionByName(made), "key").count() == 2 and sketches.merge_sketches(missing, "key").count() == 0
    with pytest.raises(ValueError, match="share"):
        sketches.percentile(1.5)


def test_a_hot_key_is_sketched_before_the_shuffle(spark):
    plan = sketches.value_sketches(spark.createDataFrame([("a", 1.0)], "k string, v double"), "v", "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("kll_sketch_agg") >= 2 and "partial_kll_sketch_agg" in plan
