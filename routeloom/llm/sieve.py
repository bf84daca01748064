"""Joins of large tables by keys of which some are hot and most have no partner.

Filters of bounded size over keys tell which rows can't have a key before anything is shuffled, and
which keys are so frequent that their rows must be dealt to many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import settle

#: Bits of a filter for each of its keys, and at most (128 MB, the size that a broadcast may have). Beyond that the filter admits more rows than need be, and nothing else changes.
BITS_A_KEY = 16
MOST_BITS = 1 << 30
#: Rows of one key that meet in one task, and the most parts into which a key's rows are dealt.
KEY_ROWS = 2_000
MOST_PARTS = 4_096
#: Fixed value: the bits of one bitmap of bitmap_construct_agg.
CELL = 1 << 15


@dataclass(frozen=True)
class Filter:
    """A bitmap over hashes of keys, in rows (cell, bitmap) of CELL bits; it never denies a key that it holds."""

    cells: DataFrame
    bits: int

    @classmethod
    def of(cls, keys: DataFrame, n: int, *columns: str) -> "Filter":
        """A filter for the ``n`` rows of ``keys``."""
        bits = max(CELL, min(MOST_BITS, 1 << (BITS_A_KEY * n).bit_length()))
        at = F.pmod(F.xxhash64(*columns), F.lit(bits))
        # Dealt by cell before they are summed, so that no task holds more than its own cells.
        placed = keys.select(F.floor(at / CELL).alias("__cell"), (at % CELL).alias("bit")).repartition("__cell")
        return cls(settle(placed.groupBy("__cell").agg(F.bitmap_construct_agg("bit").alias("__bitmap")), "filter"), bits)

    def admits(self, rows: DataFrame, *keys: Column) -> DataFrame:
        """``rows`` and a column __maybe: false only for rows whose keys aren't in the filter."""
        at = F.pmod(F.xxhash64(*keys), F.lit(self.bits))
        bit = (at % CELL).cast("int")
        # At most MOST_BITS / 8 bytes, so this side may be broadcast.
        near = rows.join(F.broadcast(self.cells), F.floor(at / CELL) == F.col("__cell"), "left")
        byte = F.conv(F.hex(F.substring("__bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return near.withColumn("__maybe", F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))).drop("__cell", "__bitmap")


def dealt_join(rows: DataFrame, table: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each key and in ``n`` how many of ``rows`` have it.

    The rows of a key with more than KEY_ROWS of them are dealt into parts by ``spread``, and its row of
    the table is copied to every part; a third of all rows may have one key. ``n`` is dropped.
    """
    hot = table.where(F.col("n") > KEY_ROWS).agg(F.count("*").alias("keys"), F.max("n").alias("most")).first()
    if not hot["keys"]:
        return rows.join(table.drop("n"), key, how)
    parts = min(MOST_PARTS, 1 + hot["most"] // KEY_ROWS)
    known = Filter.of(table.where(F.col("n") > KEY_ROWS), hot["keys"], key)
    # The filter says the same of a key on both sides, so it does no harm if it takes another key for a hot one.
    dealt = known.admits(rows, F.col(key)).withColumn("__part", F.when(F.col("__maybe"), F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(F.lit(0)).cast("int")).drop("__maybe")
    every = F.when(F.col("__maybe"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    copied = known.admits(table.drop("n"), F.col(key)).withColumn("__part", F.explode(every)).drop("__maybe")
    # The copies have no size bound, so they are never broadcast, and parts stay apart.
    return dealt.join(copied.hint("merge"), [key, "__part"], how).drop("__part")
