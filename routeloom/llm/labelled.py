"""A bounded, repeatable sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id, folds: int):
    """crc32 of the identifier as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, label, text) of at most ``limit`` labelled documents outside the held-out fold.

    The rows with the smallest hashes of their identifier are taken, so the sample is the same for
    any partitioning. Null ids and labels are left out; of several labels of one id the largest
    counts. The identifiers are at most ``limit`` rows, so their side of the join may be broadcast.
    """
    rows = labels.select(labels[doc_id].alias("id"), labels[label].cast("int").alias("label")).dropna()
    rows = rows.where(fold(F.col("id"), folds) != held_out).groupBy("id").agg(F.max("label").alias("label"))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))
    return texts.join(F.broadcast(chosen), "id")
