"""Integrity rules of observation tables, as one table of violations.

Every rule is a grouping or an anti-join, so the check is a few shuffles however large the table. The
report is ordered by rule and key, since a DataFrame has no first row to blame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.contracts import OBSERVATION, OBSERVED, distinct_ids
from routeloom.functions.text import strip


def _violation(rows: DataFrame, rule: str, key, detail) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def field_violations(history: DataFrame) -> DataFrame:
    """Fields outside their domain: blank texts, and numbers that are null, NaN, infinite or out of bounds."""
    bad = [F.when(~domain.of_column(F.col(c)), c) for c, domain in OBSERVED.items() if c in history.columns]
    names = F.array_compact(F.array(*bad))
    return _violation(history.where(F.size(names) > 0), "field", F.col("call_id"), F.array_join(names, ","))


def duplicate_keys(history: DataFrame, key: str = "call_id") -> DataFrame:
    found = history.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return _violation(found, "duplicate " + key, F.col(key), F.col("n"))


def inconsistent_identities(history: DataFrame) -> DataFrame:
    """Query ids with more than one (query, group, task type)."""
    found = history.groupBy("query_id").agg(F.count_distinct(F.struct("query", "group_id", "task_type")).alias("n")).where("n > 1")
    return _violation(found, "query identity", F.col("query_id"), F.col("n"))


def shared_texts(history: DataFrame) -> DataFrame:
    """Stripped texts with more than one query id; texts are compared by their digests."""
    keyed = history.select(F.sha2(strip(F.col("query")).cast("binary"), 256).alias("digest"), "query_id")
    found = keyed.groupBy("digest").agg(F.count_distinct("query_id").alias("n"), F.min("query_id").alias("first")).where("n > 1")
    return _violation(found, "text identity", F.col("first"), F.col("n"))


def unknown_models(history: DataFrame, model_ids: list[str]) -> DataFrame:
    found = history.where(~F.col("model_id").isin(list(model_ids))).groupBy("model_id").agg(F.count("*").alias("n"))
    return _violation(found, "unknown model", F.col("model_id"), F.col("n"))


def coverage_gaps(history: DataFrame, model_ids: list[str]) -> DataFrame:
    """(query_id, model_id, n) for every query and expected model that doesn't have exactly one observation.

    A query's counts by model are one row, from which the expected models are read off: no cross
    join. The models are a list of the configuration.
    """
    counts = [F.count_if(F.col("model_id") == m).alias(f"m{k}") for k, m in enumerate(model_ids)]
    wide = history.groupBy("query_id").agg(*counts)
    pairs = F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(f"m{k}").alias("n")) for k, m in enumerate(model_ids)])
    return wide.select("query_id", F.explode(F.filter(pairs, lambda p: p["n"] != 1)).alias("gap")).select("query_id", "gap.model_id", "gap.n")


def violations(history: DataFrame, model_ids: list[str] | None = None, full_coverage: bool = False) -> DataFrame:
    """(rule, key, detail) of everything that is wrong with a table of observations.

    Without ``model_ids`` the models are those of the table, so none is unknown.
    """
    parts = [field_violations(history), duplicate_keys(history), inconsistent_identities(history), shared_texts(history)]
    if model_ids is not None:
        if not model_ids:
            raise ValueError("no model ids")
        parts.append(unknown_models(history, model_ids))
    if full_coverage:
        expected = model_ids if model_ids is not None else sorted(r[0] for r in history.select("model_id").distinct().collect())
        gaps = coverage_gaps(history, list(expected))
        parts.append(_violation(gaps, "coverage", F.concat_ws("/", "query_id", "model_id"), F.col("n")))
    return reduce(DataFrame.unionByName, parts)


def validate_history(history: DataFrame, model_ids: list[str] | None = None, full_coverage: bool = False) -> DataFrame:
    """``history`` itself if it has rows and no violation; else ValueError with the first violation."""
    missing = {f.name for f in OBSERVATION} - set(history.columns)
    if missing:
        raise ValueError(f"history lacks columns {sorted(missing)}")
    if model_ids is not None:
        distinct_ids(list(model_ids), "model ids")
    if history.isEmpty():
        raise ValueError("history is empty")
    worst = violations(history, model_ids, full_coverage).orderBy("rule", "key").first()
    if worst is not None:
        raise ValueError(f"{worst['rule']}: {worst['key']} ({worst['detail']})")
    return history
