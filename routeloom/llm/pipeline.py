"""The corpus pipeline: five stages over the documents table, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns documents in their own columns (decontamination
may shorten a text, and n_chars with it); the last adds
mix_topic, mix_weight and mix_probability. The rows of the first stage depend on a fitted model, so
there is no SQL for run(); tests/llm compares every stage, and run(), with plain versions of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact, mixing, simhash, toxicity
from .storage import discard, settle

#: Words of a benchmark item that may stand in a document in one run, if they are less than a twentieth of it.
LONGEST_SPAN = 50

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores at its threshold or above go."""
    return toxicity.reject_toxic(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for blanks, the longest stays."""
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest identifier stays."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in windows of benchmark items go; longer runs of such words are cut out of the others."""
    kept = decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"), max_words=LONGEST_SPAN)
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kept.schema["n_chars"].dataType), "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics come near their target weights."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    last: DataFrame | None = None
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
