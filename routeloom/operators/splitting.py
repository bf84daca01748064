"""Train, validation and test splits by whole groups.

A split is a column, not three copies of the table. Two ways to deal groups: by a seeded permutation
of their sorted names (for few groups; they come to the driver) and by the rank of a seeded hash (for
any number; ranks are counted in cells, without the driver).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.contracts import ORDINAL, SHARE

SPLITS = ("train", "validation", "test")
#: Groups that the seeded permutation takes at most.
MOST_GROUPS = 100_000


def check_fractions(train_fraction: float, validation_fraction: float, seed: int) -> None:
    """All three splits must get something."""
    parts = SHARE.check(train_fraction, "train_fraction"), SHARE.check(validation_fraction, "validation_fraction")
    if min(*parts, 1 - sum(parts)) <= 0:
        raise ValueError("the fractions of train, validation and test must all be positive")
    ORDINAL.check(seed, "seed")


def _halves(names: list[str], fraction: float, seed: int) -> tuple[list[str], list[str]]:
    """Chosen and other names: a permutation's first ceil((1 - fraction) n) are the others, the next are chosen."""
    chosen = math.floor(fraction * len(names))
    order = np.random.RandomState(seed).permutation(len(names))
    rest = len(names) - chosen
    return [names[i] for i in order[rest:]], [names[i] for i in order[:rest]]


def group_split(history: DataFrame, train_fraction: float = 0.6, validation_fraction: float = 0.2, seed: int = 20260906) -> DataFrame:
    """``history`` with a split column, by a seeded permutation of the sorted groups, dealt twice with one seed."""
    check_fractions(train_fraction, validation_fraction, seed)
    groups = sorted(r[0] for r in history.select("group_id").distinct().limit(MOST_GROUPS + 1).collect())
    if len(groups) < 3:
        raise ValueError("at least three groups are needed")
    if len(groups) > MOST_GROUPS:
        raise ValueError("too many groups for a permutation on the driver; use group_split_by_hash")
    train, held = _halves(groups, train_fraction, seed)
    validation, test = _halves(sorted(held), validation_fraction / (1 - train_fraction), seed)
    rows = [(g, name) for name, part in zip(SPLITS, (train, validation, test)) for g in part]
    # At most MOST_GROUPS short rows, so this side may be broadcast.
    table = history.sparkSession.createDataFrame(rows, "group_id string, split string")
    return history.join(F.broadcast(table), "group_id").select(*history.columns, "split")


def hash_split_of_groups(groups: DataFrame, train_fraction: float = 0.6, validation_fraction: float = 0.2, seed: int = 20260906) -> DataFrame:
    """(group_id, split) by the hash of seed and group: groups below the first cut train, below the second validate.

    The cuts are exact: floor(fraction x groups) groups lie below each. A group's rank is the number
    of groups in smaller cells (65,536 of them, by the hash's leading digits) and its rank in its own
    cell, so there is neither a global sort nor a step on the driver. Fewer than three groups are an
    error while running.
    """
    check_fractions(train_fraction, validation_fraction, seed)
    keyed = groups.select("group_id").distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_id")).cast("binary")))
    keyed = keyed.withColumn("cell", F.substring("h", 1, 4))
    every = Window.partitionBy(F.lit(0))
    cells = keyed.groupBy("cell").agg(F.count("*").alias("n"))
    cells = cells.select("cell", F.coalesce(F.sum("n").over(every.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(every).alias("total"))
    # At most 65,536 short rows, so this side may be broadcast.
    ranked = keyed.join(F.broadcast(cells), "cell").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("h", "group_id")) - 1)
    train, validation = (F.floor(F.lit(float(fraction)) * F.col("total")) for fraction in (train_fraction, validation_fraction))
    few = F.when(F.col("total") < 3, F.raise_error(F.lit("at least three groups are needed")).cast("string"))
    return ranked.select("group_id", few.when(F.col("rank") < train, SPLITS[0]).when(F.col("rank") < train + validation, SPLITS[1]).otherwise(SPLITS[2]).alias("split"))


def group_split_by_hash(history: DataFrame, train_fraction: float = 0.6, validation_fraction: float = 0.2, seed: int = 20260906) -> DataFrame:
    """``history`` with a split column, for any number of groups."""
    table = hash_split_of_groups(history, train_fraction, validation_fraction, seed)
    return history.join(table, "group_id").select(*history.columns, "split")


def split_summary(split: DataFrame) -> DataFrame:
    """For each split: counts of observations, queries and groups, and of queries for each task type.

    One row for each split and task type, with the split's totals, and n_task_queries. Lists of ids
    are the table itself, so they aren't gathered here.
    """
    queries = split.groupBy("split", "query_id").agg(F.count("*").alias("n"), F.min("task_type").alias("task_type"), F.min("group_id").alias("group_id"))
    totals = queries.groupBy("split").agg(F.sum("n").alias("observation_count"), F.count("*").alias("query_count"), F.count_distinct("group_id").alias("group_count"))
    tasks = queries.groupBy("split", "task_type").agg(F.count("*").alias("task_query_count"))
    return tasks.join(totals, "split").select("split", "observation_count", "query_count", "group_count", "task_type", "task_query_count")
