"""Exact duplicates by a log-structured merge index of digests, in DataFrame operations only.

Memtable and flush: every task sorts the digests of its rows and writes them as one run, without an
exchange; runs carry Parquet's Bloom filters, which look-ups of single texts use. Compaction merges
the runs by digest: the best row stays and the counts add up. A digest of two or more rows is a hit.
Hits go into a filter of bounded size that every task gets; a row that the filter denies is alone, so
neither its digest nor its text moves. Only the texts of rows that the filter admits are verified byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .sieve import Filter, dealt_join
from .storage import new_path, settle

#: Fixed value: what is deleted before texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without blanks; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _digest(norm: Column) -> Column:
    """32 bytes: SHA-256 of the UTF-8 of the normalised text."""
    return F.unhex(F.sha2(norm.cast("binary"), 256))


#: Orders rows of one text: most code points first, then the smallest identifier.
def _best(n_chars: str = "n_chars", doc_id: str = "id") -> Column:
    return F.struct((-F.col(n_chars)).alias("less"), F.col(doc_id).alias("id"))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, n_chars) of every row."""
    raw = docs[text]
    return docs.select(docs[doc_id].alias("id"), _digest(normalised(raw)).alias("digest"), F.coalesce(F.char_length(raw), F.lit(0)).cast("long").alias("n_chars"))


def flush(rows: DataFrame, path: str) -> DataFrame:
    """Write a run for every task: its (id, digest, n_chars) rows in digest order. Returns all runs under ``path``.

    The sort is the memtable: it spills to disk when it outgrows the task's memory.
    """
    rows.sortWithinPartitions("digest").write.mode("append").option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def merged(runs: DataFrame) -> DataFrame:
    """Compaction: one row for each digest, with the best of the runs' rows and how many there are."""
    return runs.groupBy("digest").agg(F.min(_best()).alias("best"), F.count("*").alias("n"))


def look_up(runs: DataFrame, *texts: str) -> DataFrame:
    """The runs' rows of a few texts, by their digests; runs whose range or Bloom filter denies them are skipped."""
    known = runs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in texts])).alias("text")).select(_digest(normalised(F.col("text"))).alias("d")).collect()
    return runs.where(F.col("digest").isin([bytes(r["d"]) for r in known]))


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, digest, best, n) of every row."""
    runs = flush(digests(docs, doc_id, text), new_path(docs.sparkSession, "digest-runs"))
    seen = Observation()
    table = settle(merged(runs).observe(seen, F.count_if(F.col("n") > 1).alias("hits")), "digest-index")
    hits = table.where("n > 1")
    known = Filter.of(hits, seen.get["hits"], "digest")
    found = known.admits(runs, F.col("digest"))
    alone = found.where("NOT __maybe").select("id", "digest", _best().alias("best"), F.lit(1).cast("long").alias("n"))
    met = dealt_join(found.where("__maybe").drop("__maybe"), hits.withColumn("group", F.col("n")), "digest", F.col("id"), "left")
    met = met.select("id", "digest", F.coalesce("best", _best()).alias("best"), F.coalesce("group", F.lit(1)).cast("long").alias("n"))
    clashing = settle(_clashing(docs, doc_id, text, known), "digest-clashes")
    if not clashing.isEmpty():
        met = met.join(clashing, "digest", "left_anti").unionByName(_by_bytes(docs, doc_id, text, clashing))
    return alone.unionByName(met)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Group rows whose texts are equal but for blanks, and choose the row of each group that stays.

    Returns one row for each input row: id, keep_id, group_size, kept, text_sha256. Of equal texts
    the one with most code points stays, then the smallest id. Null text is empty text, and all
    empty texts are one group. A null id counts as the smallest. Repeated rows with one id are rows
    of the group and all say what their id says. An empty table gives no rows. Other columns of
    ``docs`` are ignored.
    """
    return _grouped(docs, doc_id, text).select(
        "id",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("best.id").eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, in their own columns; of repeated rows with one id and one text, one stays.

    Rows to go, and rows of which there are several, are a filter first: the texts of other rows don't move.
    """
    found = _grouped(docs, doc_id, text).groupBy("id", "digest").agg(F.max(F.col("best.id").eqNullSafe(F.col("id"))).alias("stays"), F.count("*").alias("copies"))
    seen = Observation()
    odd = found.where("NOT stays OR copies > 1").observe(seen, F.count("*").alias("n"))
    odd = settle(odd.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("stays").alias("__stays")), "dropped-or-repeated")
    digest = _digest(normalised(docs[text]))
    near = Filter.of(odd, seen.get["n"], "__id", "__digest").admits(docs.withColumn("__own", digest), docs[doc_id], F.col("__own"))
    sure = near.where("NOT __maybe").select(*docs.columns)
    # What is odd has no size bound, so it isn't broadcast however few rows it is here.
    doubted = near.where("__maybe").join(odd.hint("merge"), F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest")), "left")
    rest = doubted.where("__stays IS NULL OR __stays").dropDuplicates([doc_id, "__own"])
    return sure.unionByName(rest.select(*docs.columns))


def _bodies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    norm = normalised(docs[text])
    return docs.select(docs[doc_id].alias("id"), norm.alias("norm"), _digest(norm).alias("digest"), F.coalesce(F.char_length(docs[text]), F.lit(0)).cast("long").alias("n_chars"))


def _clashing(docs: DataFrame, doc_id: str, text: str, known: Filter) -> DataFrame:
    """Byte verification of the hits: the digests under which different bytes were found.

    Rows are grouped by digest and bytes before anything is sent, so a hot text moves once a task.
    """
    bodies = known.admits(_bodies(docs, doc_id, text), F.col("digest")).where("__maybe").groupBy("digest", "norm").agg(F.count("*").alias("n"))
    return bodies.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def _by_bytes(docs: DataFrame, doc_id: str, text: str, clashing: DataFrame) -> DataFrame:
    """(id, digest, best, n) of the rows under clashing digests, grouped by their bytes."""
    bodies = _bodies(docs, doc_id, text).join(clashing, "digest", "left_semi")
    groups = bodies.groupBy("digest", "norm").agg(F.min(_best()).alias("best"), F.count("*").alias("n"))
    return bodies.join(groups, ["digest", "norm"]).select("id", "digest", "best", "n")
