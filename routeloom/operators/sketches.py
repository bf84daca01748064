"""Percentiles from sketches that are kept for each key and period and merged over any periods.

A sketch is a binary value of a few kilobytes, made with partial aggregation, so a hot key is
sketched in as many tasks as hold its rows. Counts, least and largest values stay exact; a
percentile's rank is off by a part of the rows that falls with ``size`` and doesn't depend on how
values are spread. Which values a sketch keeps is left to chance, so a sketch that is made again gives
other percentiles within that bound: write sketches, and read them, where the same ones are needed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketch size. The rank of a percentile is then within RANK_ERROR of the one asked for; its standard error is about an eighth of that.
SIZE = 800
RANK_ERROR = 0.01


def _key(by: tuple[str, ...]) -> Column:
    """The keys in a struct, which equals another where both have a null; without keys, one for all rows."""
    return (F.struct(*by) if by else F.struct(F.lit(0).alias("all"))).alias("key")


def _finite(rows: DataFrame, column: str, by: tuple[str, ...]) -> DataFrame:
    """(key, v) of the rows whose value is finite."""
    valued = rows.select(_key(by), F.col(column).cast("double").alias("v"))
    return valued.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))


def value_sketches(rows: DataFrame, column: str, *by: str, size: int = SIZE) -> DataFrame:
    """(by..., sketch) of the finite values of a column; a key that has none isn't returned."""
    found = _finite(rows, column, by).groupBy("key").agg(F.kll_sketch_agg_double("v", size).alias("sketch"))
    return found.select(*[F.col(f"key.{c}").alias(c) for c in by], "sketch")


def merge_sketches(sketches: DataFrame, *by: str, size: int = SIZE) -> DataFrame:
    """(by..., sketch) of all values behind the sketches of a key, whatever they were kept by before; null sketches are skipped."""
    found = sketches.select(_key(by), "sketch").where("sketch IS NOT NULL").groupBy("key").agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))
    return found.select(*[F.col(f"key.{c}").alias(c) for c in by], "sketch")


def observation_count() -> Column:
    """How many values a sketch has seen."""
    return F.kll_sketch_get_n_double("sketch")


def percentile(share: float) -> Column:
    """The value at a share of a sketch's values; 0 and 1 are the least and the largest, exactly."""
    if not 0 <= share <= 1:
        raise ValueError("a share must be from 0 to 1")
    return F.kll_sketch_get_quantile_double("sketch", F.lit(float(share)))


def sketch_percentiles(sketches: DataFrame, shares: dict[str, float], *by: str) -> DataFrame:
    """(by..., observation_count, and a column for each named share) of tables of sketches."""
    return sketches.select(*by, observation_count().alias("observation_count"), *[percentile(p).alias(name) for name, p in shares.items()])


def ranks_of(rows: DataFrame, estimates: DataFrame, column: str, names: list[str], *by: str) -> DataFrame:
    """(by..., and for each name the shares of values below and not above the estimate): one pass over the rows, to check sketches.

    A hot key is joined in many tasks if the estimates are small enough to be broadcast, and dealt by
    adaptive execution otherwise.
    """
    asked = estimates.select(_key(by), *names)
    sums = [F.avg(F.when(test, 1.0).otherwise(0.0)).alias(f"{name}_{kind}") for name in names for test, kind in ((F.col("v") < F.col(name), "below"), (F.col("v") <= F.col(name), "to"))]
    found = _finite(rows, column, by).join(asked, "key").groupBy("key").agg(*sums)
    return found.select(*[F.col(f"key.{c}").alias(c) for c in by], *[f"{name}_{kind}" for name in names for kind in ("below", "to")])
