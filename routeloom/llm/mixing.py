"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells of one source, one language and one topic. The token weights of the cells
are raked: scaled to the targets of the sources, then of the languages, then of the topics, and so
on until no weight moves. Inclusion probabilities follow the weights, calibrated so that the expected
tokens are the wanted share, and each document is drawn by a hash of its identifier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .storage import discard, settle

DIMENSIONS = ("source", "lang", "topic")
#: Topics by the first pattern that a text matches; the patterns read alike in Java and RE2. The rest is "prose".
TOPICS = {"legal": r"[Ll]icen[cs]ed? |copyright", "table": r" \| [^|]+ \| ", "contact": r"@[a-z0-9]+\.|\+[0-9] ", "loud": r"!!", "markup": r"[$%&*#]{3}"}
#: One of these is in whatever a topic's pattern matches; looking for them is cheaper than the pattern.
SIGNS = {"legal": ("icen", "copyright"), "table": (" | ",), "contact": ("@", "+"), "loud": ("!!",)}
#: A value's target share goes with its tokens to this power: 1 keeps the proportions, 0 evens them out.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Fitting ends when no weight moves by more than this part of itself in a round, or after so many rounds.
TOLERANCE = 1e-10
ROUNDS = 40
SHARE = 0.75
#: Fixed value: a token is a run of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column, topics: dict[str, str] = TOPICS) -> Column:
    """The first topic whose pattern occurs in the text; null and empty texts are prose."""

    def fits(name: str, pattern: str) -> Column:
        signs = [text.contains(sign) for sign in SIGNS.get(name, ())] if topics is TOPICS else []
        return reduce(lambda a, b: a | b, signs) & text.rlike(pattern) if signs else text.rlike(pattern)

    return F.coalesce(*[F.when(fits(name, pattern), F.lit(name)) for name, pattern in topics.items()], F.lit("prose"))


def _described(docs: DataFrame, doc_id: str, text: str, source: str, lang: str, topics: dict[str, str]) -> DataFrame:
    """(id, source, lang, topic, n_tokens) of every row; null values are the value "" of their dimension."""
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(
        docs[doc_id].alias("id"),
        F.coalesce(docs[source].cast("string"), F.lit("")).alias("source"),
        F.coalesce(docs[lang].cast("string"), F.lit("")).alias("lang"),
        topic_of(body, topics).alias("topic"),
        F.regexp_count(body, F.lit(TOKEN)).cast("long").alias("n_tokens"),
    )


def targets_by_power(cells: DataFrame, powers: dict[str, float] = POWERS) -> dict[str, DataFrame]:
    """For each dimension (value, target): tokens that each value should weigh, all together as many as there are."""
    out = {}
    for name in DIMENSIONS:
        seen = Observation()
        sums = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("tokens")).withColumn("raised", F.pow("tokens", F.lit(powers[name])))
        sums = settle(sums.observe(seen, F.sum("tokens").alias("tokens"), F.sum("raised").alias("raised")), f"sums-of-{name}")
        scale = (seen.get["tokens"] or 0.0) / seen.get["raised"] if seen.get["raised"] else 0.0
        out[name] = sums.select(name, (F.col("raised") * F.lit(scale)).alias("target"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (dimensions, tokens) with the weight by which each one's tokens count after fitting.

    Sums by a dimension's value meet the targets after its turn. Values without a target keep their
    weight, and so do values without tokens. Each turn is one sum and one join of tables as long as
    the cells, and is written out, which cuts lineage. Fitting ends with the first round that moves no
    weight by more than ``tolerance`` of itself: all targets are met then to that precision. Targets
    that contradict each other are met by none, and end after ``rounds``; ``residuals`` says by how much.
    """
    fitted = cells.withColumn("weight", F.lit(1.0))
    for name, table in targets.items():
        fitted = fitted.join(table.select(name, F.col("target").alias(f"target_{name}")), name, "left")
    fitted = settle(fitted, "raked")
    for _ in range(rounds):
        most = 0.0
        for name in targets:
            moved = Observation()
            now = F.sum(F.col("weight") * F.col("tokens"))
            sums = fitted.groupBy(name).agg(now.alias("now"), F.max(f"target_{name}").alias("target"))
            factors = sums.select(name, F.when(F.col("now") > 0, F.coalesce(F.col("target") / F.col("now"), F.lit(1.0))).otherwise(1.0).alias("factor"))
            turned = fitted.join(factors, name).withColumn("weight", F.col("weight") * F.col("factor"))
            turned = turned.observe(moved, F.max(F.abs(F.col("factor") - 1)).alias("most")).drop("factor")
            last, fitted = fitted, settle(turned, "raked")
            discard(last)
            most = max(most, moved.get["most"] or 0.0)
        if most <= tolerance:
            break
    return fitted.select(*cells.columns, "weight")


def residuals(fitted: DataFrame, targets: dict[str, DataFrame]) -> dict[str, float]:
    """For each dimension, the largest part by which a value's weighed tokens miss its target."""
    out = {}
    for name, table in targets.items():
        sums = fitted.groupBy(name).agg(F.sum(F.col("weight") * F.col("tokens")).alias("now")).join(table, name)
        miss = sums.where("now > 0").agg(F.max(F.abs(F.col("now") / F.col("target") - 1)).alias("miss")).first()["miss"]
        out[name] = miss or 0.0
    return out


def calibrate(fitted: DataFrame, share: float = SHARE) -> DataFrame:
    """Cells with inclusion probabilities in proportion to their weights, at most 1, that keep ``share`` of the tokens.

    Cells at probability 1 are set aside and the scale of the others is raised, until no other cell reaches 1.
    """
    total = fitted.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    scale, bound = 0.0, float("inf")
    while True:
        free = F.col("weight") < bound
        row = fitted.agg(F.sum(F.when(free, F.col("weight") * F.col("tokens"))).alias("free"), F.sum(F.when(~free, F.col("tokens"))).alias("full")).first()
        scale = (share * total - (row["full"] or 0)) / row["free"] if row["free"] else scale
        if scale <= 0 or 1 / scale >= bound:
            break
        bound = 1 / scale
    return fitted.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(float(scale))) if scale > 0 else F.lit(1.0))


def uniform(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the identifier only; null counts as empty."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topics: dict[str, str] = TOPICS, targets: dict[str, DataFrame] | None = None, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """Weigh and draw documents so that their tokens mix to the targets.

    Returns one row for each input row: id, source, lang, topic, n_tokens, weight, probability,
    sampled. Null sources and languages are the value "". Documents without tokens weigh nothing and
    go with their cell. Rows with equal ids are drawn alike. ``targets`` may hold, by dimension, a
    table (dimension, target) in tokens; else targets go with powers of the tokens. An empty table
    gives no rows. Other columns are ignored.
    """
    rows = settle(_described(docs, doc_id, text, source, lang, topics), "described")
    return _drawn(rows, _fitted(rows, targets, share, rounds))


def _fitted(rows: DataFrame, targets: dict[str, DataFrame] | None, share: float, rounds: int) -> DataFrame:
    cells = settle(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    return settle(calibrate(rake(cells, targets or targets_by_power(cells), rounds), share), "calibrated")


def _drawn(rows: DataFrame, cells: DataFrame) -> DataFrame:
    drawn = rows.join(cells.select(*DIMENSIONS, "weight", "probability"), list(DIMENSIONS))
    return drawn.select("id", *DIMENSIONS, "n_tokens", "weight", "probability", (uniform(F.col("id")) < F.col("probability")).alias("sampled"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topics: dict[str, str] = TOPICS, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """The drawn documents in their own columns, with mix_topic, mix_weight and mix_probability after them.

    Cells are joined to the documents themselves, so equal ids and null ids need no care.
    """
    described = _described(docs, doc_id, text, source, lang, topics)
    cells = _fitted(described, None, share, rounds).select(*[F.col(c).alias(f"__{c}") for c in DIMENSIONS], F.col("weight").alias("mix_weight"), F.col("probability").alias("mix_probability"))
    keys = {
        "source": F.coalesce(docs[source].cast("string"), F.lit("")),
        "lang": F.coalesce(docs[lang].cast("string"), F.lit("")),
        "topic": topic_of(F.coalesce(docs[text], F.lit("")), topics),
    }
    joined = docs.join(cells, reduce(lambda a, b: a & b, [keys[c] == F.col(f"__{c}") for c in DIMENSIONS]))
    kept = joined.where(uniform(docs[doc_id]) < F.col("mix_probability"))
    return kept.select(*[docs[c] for c in docs.columns], F.col("__topic").alias("mix_topic"), "mix_weight", "mix_probability")


def oracle(share: float = SHARE, rounds: int = ROUNDS, clips: int = 12) -> str:
    """The mixture in SQL: every round of fitting and of calibration is a table."""
    topic = " ".join(f"WHEN regexp_matches(t, '{pattern}') THEN '{name}'" for name, pattern in TOPICS.items())
    parts = [
        "d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE " + topic + f" ELSE 'prose' END AS topic, CAST(len(regexp_extract_all(t, '{TOKEN}')) AS BIGINT) AS n_tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(1 AS DOUBLE) AS weight FROM d GROUP BY ALL)",
    ]
    for name in DIMENSIONS:
        power = f"pow(sum(tokens), CAST({POWERS[name]} AS DOUBLE))"
        parts.append(f"t_{name} AS MATERIALIZED (SELECT {name}, {power} * (SELECT sum(tokens) FROM w0) / sum({power}) OVER () AS target FROM w0 GROUP BY {name})")
    last = "w0"
    for k in range(rounds * len(DIMENSIONS)):
        name, new = DIMENSIONS[k % len(DIMENSIONS)], f"w{k + 1}"
        total = f"sum(weight * tokens) OVER (PARTITION BY {name})"
        parts.append(f"{new} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * CASE WHEN {total} > 0 THEN target / {total} ELSE 1 END AS weight FROM {last} JOIN t_{name} USING ({name}))")
        last = new
    parts.append(f"s0 AS MATERIALIZED (SELECT CAST({share} AS DOUBLE) * sum(tokens) / sum(weight * tokens) AS s FROM {last})")
    for k in range(clips):
        parts.append(
            f"s{k + 1} AS MATERIALIZED (SELECT CASE WHEN free > 0 THEN greatest(s, (CAST({share} AS DOUBLE) * total - filled) / free) ELSE s END AS s FROM (SELECT any_value(s) AS s, sum(tokens) AS total, coalesce(sum(tokens) FILTER (WHERE weight >= 1 / s), 0) AS filled, coalesce(sum(weight * tokens) FILTER (WHERE weight < 1 / s), 0) AS free FROM {last}, s{k}))"
        )
    draw = "CAST(('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE)"
    return (
        "WITH " + ",\n".join(parts) + f"""
        SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(least(CAST(1 AS DOUBLE), weight * s), 6) AS probability,
            {draw} < least(CAST(1 AS DOUBLE), weight * s) AS sampled
        FROM d JOIN {last} USING (source, lang, topic), s{clips}"""
    )
