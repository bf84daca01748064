"""Observations from the documents table: each distinct text is a request, answered by five simulated models.

Outcomes are arithmetic on ids and lengths, so the same table can be had from SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.contracts import ModelCandidate
from routeloom.functions.text import strip

#: The simulated models, with a number, a base cost and a base latency.
MODELS = (("model-a", 0, 55, 1500), ("model-b", 1, 25, 900), ("model-c", 2, 31, 1150), ("model-d", 3, 14, 700), ("model-e", 4, 6, 420))
MODEL_IDS = [m[0] for m in MODELS]
CANDIDATES = tuple(ModelCandidate(m) for m in MODEL_IDS)
RULES = {"code": "model-b", "math": "model-c", "summary": "model-d", "translation": "model-d", "qa": "model-a"}
THRESHOLD = 0.8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def request_text(text: Column) -> Column:
    """White space as single blanks; a blank that stands alone is what it should be, so it isn't replaced."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]{2,}|[\t\n\r]", " "))


def requests(docs: DataFrame) -> DataFrame:
    """(query_id, group_id, task_type, n_chars): one row for each distinct text, described by its smallest doc_id.

    Texts are grouped by digest, so what is shuffled is a few bytes for each document.
    """
    return _requests(docs)


def keyed_requests(docs: DataFrame) -> DataFrame:
    """The same with a key, the smallest query_id of those whose texts are equal once they are stripped of any white space."""
    rows = _requests(docs, F.first("stripped").alias("stripped"))
    return rows.withColumn("key", F.min("query_id").over(Window.partitionBy("stripped"))).drop("stripped")


def _requests(docs: DataFrame, *more: Column) -> DataFrame:
    text = request_text(F.col("text"))
    some = F.col("text").rlike(r"[^ \t\n\r]")
    first = F.min(F.struct("doc_id", "source", "lang", "n_chars")).alias("first")
    own = docs.where(some)
    own = own.withColumn("stripped", F.sha2(strip(text).cast("binary"), 256)) if more else own
    rows = own.groupBy(F.sha2(text.cast("binary"), 256).alias("digest")).agg(first, *more)
    return rows.select(F.col("first.doc_id").alias("query_id"), F.col("first.source").alias("group_id"), F.col("first.lang").alias("task_type"), F.col("first.n_chars").alias("n_chars"), *rows.columns[2:])


def request_texts(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """(query_id, query) of the same requests, dealt to ``tasks`` tasks if told so.

    Texts are dealt by id once. A task holds the ids of its requests in a table, as sorting its
    texts would be more work, and as the ids of all requests are too many for a broadcast.
    """
    texts = docs.select(F.col("doc_id").alias("query_id"), request_text(F.col("text")).alias("query"))
    texts = texts.repartition(tasks, "query_id") if tasks else texts
    return texts.join(requests(docs).select("query_id").hint("shuffle_hash"), "query_id", "left_semi")


def keyed_texts(docs: DataFrame, keyed: DataFrame, tasks: int) -> DataFrame:
    """(key, query, ...): the stripped text of each key of ``keyed``, and what else that has of it, dealt to ``tasks`` tasks; texts are dealt once."""
    texts = docs.select(F.col("doc_id").alias("key"), strip(request_text(F.col("text"))).alias("query")).repartition(tasks, "key")
    return texts.join(keyed.hint("shuffle_hash"), "key")


def observations(docs: DataFrame) -> DataFrame:
    """Every request with every model: call_id, ids, quality_score, cost, latency_ms, and a stand-in probability p."""
    return observed_requests(requests(docs))


def observed_requests(requests: DataFrame, *more: str) -> DataFrame:
    """The observations of ``requests``, with more of their columns."""
    models = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(j).cast("long").alias("j"), F.lit(float(c)).alias("base_cost"), F.lit(float(ms)).alias("base_latency")) for m, j, c, ms in MODELS])
    rows = requests.withColumn("m", F.explode(models))
    q, n, j = F.col("query_id"), F.col("n_chars"), F.col("m.j")
    return rows.select(
        F.concat(q.cast("string"), F.lit("--"), F.col("m.model_id")).alias("call_id"),
        "query_id",
        "group_id",
        "task_type",
        F.col("m.model_id").alias("model_id"),
        (((q * 7919 + j * 104729 + n * 31) % 1001) / F.lit(1000.0)).alias("quality_score"),
        (F.col("m.base_cost") * (n + 220) / F.lit(1000.0)).alias("cost"),
        (F.col("m.base_latency") * (n + 500) / F.lit(500.0)).alias("latency_ms"),
        (((q * 104729 + j * 7919 + n * 17) % 1001) / F.lit(1000.0)).alias("p"),
        *more,
    )


#: The same in SQL, as common table expressions q and o.
SQL = r"""
    q AS MATERIALIZED (
        SELECT min(doc_id) AS query_id, arg_min(source, doc_id) AS group_id, arg_min(lang, doc_id) AS task_type, arg_min(n_chars, doc_id) AS n_chars, query
        FROM (SELECT *, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS query FROM documents) WHERE length(query) > 0 GROUP BY query),
    m(model_id, j, base_cost, base_latency) AS (VALUES ('model-a', 0, 55, 1500), ('model-b', 1, 25, 900), ('model-c', 2, 31, 1150), ('model-d', 3, 14, 700), ('model-e', 4, 6, 420)),
    o AS MATERIALIZED (
        SELECT CAST(query_id AS VARCHAR) || '--' || model_id AS call_id, query_id, group_id, task_type, model_id,
            ((query_id * 7919 + j * 104729 + n_chars * 31) % 1001) / CAST(1000 AS DOUBLE) AS quality_score,
            CAST(base_cost AS DOUBLE) * (n_chars + 220) / CAST(1000 AS DOUBLE) AS cost,
            CAST(base_latency AS DOUBLE) * (n_chars + 500) / CAST(500 AS DOUBLE) AS latency_ms,
            ((query_id * 104729 + j * 7919 + n_chars * 17) % 1001) / CAST(1000 AS DOUBLE) AS p
        FROM q, m)"""
