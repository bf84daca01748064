"""A synthetic table of observations for development, made by Spark from hashes of a seed.

Every draw is a hash of the seed and of what it is for, so the table is the same for any number of
partitions. Requests are put together from our own templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.contracts import COUNT, HINTS, OBSERVATION, ORDINAL, POSITIVE, SHARE
from routeloom.sources import sealed

TOPICS = ("a sorting routine", "a bus timetable", "the harbour at dawn", "a bread recipe", "tidal forces", "a lease agreement")
TEMPLATES = {
    "code": ("Write a Python function for {t} that takes {n} items.", "This SQL about {t} returns {n} rows too many; find out why."),
    "math": ("Let x = {n} + {k}. How does {t} change if x doubles?", "Solve {n} = {k} * y and relate y to {t}."),
    "summary": ("Summarise the notes on {t} in {k} points.", "Please summarize {n} pages about {t}."),
    "translation": ("Translate the paragraph on {t} into French, part {n}.", "Please translate {k} sentences about {t}, set {n}."),
    "qa": ("Why do people care about {t}? Case {n}.", "What should a beginner know about {t} by day {n}?"),
}
#: Who the answer is for and in which form, with the skill that takes and the characters of an answer.
FORMS = (
    ("Answer in a single word.", 0.05, 30),
    ("Write for a child of nine.", 0.45, 600),
    ("Write it as a table of four columns.", 0.55, 1100),
    ("Write for a colleague who will check every step.", 0.7, 1900),
    ("Write it as a letter that a court may read.", 0.8, 2600),
)
#: Settings of the generator, and of a model's profile beside its skills.
SETTINGS = {"seed": ORDINAL, "variants_per_group": COUNT, "softness": POSITIVE, "luck": SHARE, "spread": SHARE}
PROFILE = {"price_per_1000": POSITIVE, "first_ms": POSITIVE, "ms_per_char": POSITIVE}
DEFAULT = {"seed": 7, "variants_per_group": 8, "softness": 0.12, "luck": 0.1, "spread": 0.25}


def check_generator(config: dict) -> tuple[dict, list[str]]:
    """The generator's settings and the models' ids; every model needs a profile with a skill for every kind of request."""
    settings, ids = config["generator"], sorted(m["model_id"] for m in config["models"])
    if set(settings["profiles"]) != set(ids):
        raise ValueError("the generator needs one profile for each model")
    wanted = [(settings, SETTINGS)] + [(settings["profiles"][m], PROFILE) for m in ids] + [(settings["profiles"][m]["skill"], dict.fromkeys(HINTS, SHARE)) for m in ids]
    for given, domains in wanted:
        for name, domain in domains.items():
            domain.check(given.get(name), name)
    return settings, ids


def _uniform(seed: int, what: str, *keys: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *keys), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def _around(seed: int, what: str, width: float, *keys: Column) -> Column:
    """In (-width, width), small values likelier: the mean of two uniform draws."""
    return (_uniform(seed, what + " 1", *keys) + _uniform(seed, what + " 2", *keys) - 1) * width


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def generate(spark: SparkSession, config: dict) -> DataFrame:
    """Observations of full coverage: groups are a template with a topic, each asked in several variants of every model."""
    settings, ids = check_generator(config)
    seed, variants = settings["seed"], settings["variants_per_group"]
    per_task = max(len(t) for t in TEMPLATES.values()) * len(TOPICS)
    rows = spark.range(len(HINTS) * per_task * variants).select(
        (F.col("id") % variants).alias("variant"), (F.floor(F.col("id") / variants) % per_task).alias("family"), F.floor(F.col("id") / (variants * per_task)).alias("task")
    )
    family = F.concat(F.lit("f"), F.lpad(F.hex(F.col("task") * per_task + F.col("family")), 4, "0"))
    rows = rows.withColumns({"task_type": _pick(HINTS, F.col("task")), "group_id": family, "query_id": F.concat(family, F.lit("."), F.col("variant"))})
    # Forms are drawn, so a family may have one twice and lack another.
    forms = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(d).alias("demand"), F.lit(float(c)).alias("answer")) for t, d, c in FORMS])
    rows = rows.withColumn("form", F.get(forms, F.floor(_uniform(seed, "form", F.col("query_id")) * len(FORMS)).cast("int")))
    texts = F.create_map(*[x for t, forms in TEMPLATES.items() for x in (F.lit(t), F.array(*[F.lit(f) for f in forms]))])
    query = F.element_at(texts[F.col("task_type")], (F.col("family") % 2 + 1).cast("int"))
    drawn = {"{n}": F.floor(3 + 500 * _uniform(seed, "n", F.col("query_id"))), "{k}": F.floor(2 + 9 * _uniform(seed, "k", F.col("query_id")))}
    for mark, value in {"{t}": _pick(TOPICS, F.floor(F.col("family") / 2)), **drawn}.items():
        query = F.replace(query, F.lit(mark), value.cast("string"))
    rows = rows.withColumn("query", F.concat_ws(" ", query, "form.text", F.format_string("Reference %d.%d.", F.col("family"), F.col("variant"))))
    profiles = [(m, settings["profiles"][m]) for m in ids]
    skills = [F.create_map(*[x for t in HINTS for x in (F.lit(t), F.lit(float(p["skill"][t])))]) for _, p in profiles]
    models = F.array(*[F.struct(F.lit(m).alias("model_id"), *[F.lit(float(p[c])).alias(c) for c in PROFILE], skill.alias("skill")) for (m, p), skill in zip(profiles, skills)])
    rows = rows.withColumn("m", F.explode(models))
    pair, m = (F.col("query_id"), F.col("m.model_id")), F.col("m")
    # A request succeeds by as much as the model's skill exceeds what it demands, which varies with its group, itself and luck.
    demand = F.col("form.demand") + _around(seed, "group", 0.1, F.col("group_id")) + _around(seed, "request", 0.1, F.col("query_id"))
    margin = m["skill"][F.col("task_type")] - demand + _around(seed, "luck", settings["luck"], *pair)
    quality = 1 / (1 + F.exp(-margin / settings["softness"]))
    # Price and time go with the characters that are read and written.
    answer = F.col("form.answer") * (1 + _around(seed, "answer", settings["spread"], *pair))
    cost = m["price_per_1000"] * (F.length("query") + answer) / 1000
    latency = m["first_ms"] * (1 + _around(seed, "wait", settings["spread"], *pair)) + m["ms_per_char"] * answer
    return rows.select(
        F.concat_ws("--", "query_id", "m.model_id").alias("call_id"), "query_id", "group_id", "query", m["model_id"].alias("model_id"), "task_type",
        F.round(quality, 6).alias("quality_score"), F.round(cost, 8).alias("cost"), F.round(latency, 3).alias("latency_ms"),
    )


def write_dataset(spark: SparkSession, config: dict, folder: str) -> str:
    """Make the observations and seal them as the current data set of ``folder``; returns its path."""
    rows = generate(spark, config)
    counts = rows.agg(F.count("*").alias("observation_count"), F.count_distinct("query_id").alias("query_count"), F.count_distinct("group_id").alias("group_count")).first()
    manifest = {
        "source_kind": "synthetic", "data_version": 1, "generator_version": 2, "seed": config["generator"]["seed"], "quality_score_range": [0.0, 1.0],
        "cost_unit": "synthetic_cost_unit", "latency_unit": "ms", "coverage_kind": "full", "quality_definition": "Simulated; no model was asked.",
        **counts.asDict(), "model_ids": sorted(m["model_id"] for m in config["models"]), "generator_config": config["generator"],
    }
    return sealed.seal(rows.select(*[f.name for f in OBSERVATION]), folder, manifest)
