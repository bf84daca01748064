"""As-of joins: to every row the last row of another table with the same key that isn't later.

Both tables are put together and cut by time, at quantiles, so that the rows of one key are dealt to
as many tasks as there are cuts, however hot it is. Inside a cut the last row is carried along; what
a key's row finds nothing for in its own cut has its answer at the end of an earlier one, and these
ends are one row for each key and cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Into how many cuts time is divided.
CUTS = 64


def _cut(times: list[int], time: str) -> Column:
    """How many of the rising ``times`` are not later than a row."""
    return F.size(F.filter(F.array(*[F.lit(t).cast("long") for t in times]), lambda t: t <= F.col(time))) if times else F.lit(0)


def as_of_join(rows: DataFrame, states: DataFrame, on: list[str], time: str, cuts: int = CUTS) -> DataFrame:
    """``rows`` with the other columns of the last of ``states`` whose ``on`` are equal and whose ``time`` isn't later; null if there is none.

    ``time`` is a whole number in both. Of states with the same key and time the one with the largest
    values counts. Keys that are null equal nothing; a row without a time finds nothing, and a state
    without one is never found. Every row is returned once, and repeated rows as often as they are.
    """
    names = [c for c in states.columns if c not in (*on, time)]
    clash = sorted(set(names) & set(rows.columns))
    if clash:
        raise ValueError(f"both tables have columns {clash}")
    whole = F.array(*[F.col(c).isNotNull() for c in (*on, time)])
    found = states.where(F.forall(whole, lambda x: x)).select(*on, F.col(time).cast("long").alias(time), F.struct(*names).alias("state"))
    shares = [k / cuts for k in range(1, cuts)]
    both = rows.select(F.col(time).cast("long").alias(time)).unionByName(found.select(time))
    times = sorted(set(both.agg(F.percentile_approx(time, shares).alias("t")).first()["t"] or []))
    # States come before rows of the same time.
    asked = rows.select(*[F.col(c) for c in on], F.col(time).cast("long").alias(time), F.lit(1).alias("kind"), F.lit(None).cast(found.schema["state"].dataType).alias("state"), F.struct(*rows.columns).alias("row"))
    put = found.select(*on, time, F.lit(0).alias("kind"), "state", F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    dealt = asked.unionByName(put).withColumn("cut", F.coalesce(_cut(times, time), F.lit(0)))
    so_far = Window.partitionBy(*on, "cut").orderBy(F.col(time).asc_nulls_first(), "kind", "state").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = dealt.withColumn("near", F.last("state", ignorenulls=True).over(so_far)).where("kind = 1")
    last = found.withColumn("cut", _cut(times, time)).groupBy(*on, "cut").agg(F.max(F.struct(time, "state")).alias("end"))
    every = last.select(*on).distinct().withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(len(times)))))
    earlier = Window.partitionBy(*on).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    before = every.join(last, [*on, "cut"], "left").select(*on, "cut", F.last("end.state", ignorenulls=True).over(earlier).alias("far")).where("far IS NOT NULL")
    answered = known.join(before, [*on, "cut"], "left")
    state = F.when(F.col(time).isNotNull(), F.coalesce("near", "far"))
    return answered.select("row.*", state.alias("state")).select(*rows.columns, *[F.col(f"state.{c}").alias(c) for c in names])
