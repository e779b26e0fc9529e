"""Series by period: latest, previous, gaps, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.nulls import yoy


def gap_filled(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Every year from a key's first to its last; years without a row have null."""
    span = df.groupBy(*keys).agg(F.min(year).alias("a"), F.max(year).alias("b"))
    grid = span.select(*keys, F.explode(F.sequence("a", "b")).alias(year))
    return grid.join(df.select(*keys, year, value), [*keys, year], "left")


def change(df: DataFrame, keys: list[str], year: str, value: str, bridge: bool = False) -> DataFrame:
    """Change on the year before (adjacent only), or with ``bridge`` on the last year that has a value."""
    w = Window.partitionBy(*keys).orderBy(year)
    last = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    before = last if bridge else F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag(value).over(w))
    return df.withColumn("yoy", yoy(F.col(value), before))


def change_by_join(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Change on strictly the year before, by a self join on year - 1."""
    before = df.select(*keys, (F.col(year) + 1).alias(year), F.col(value).alias("before"))
    return df.join(before, [*keys, year], "left").withColumn("yoy", yoy(F.col(value), F.col("before")))


def latest(df: DataFrame, keys: list[str], period: str, tie: Column, last_wins: bool = True) -> DataFrame:
    """Each key's latest row; among equal periods the first or the last by ``tie``."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(period), tie if last_wins else -tie)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *(f"r.{c}" for c in rest))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, when: str, value: str, tie: str, span: int = 86_400) -> DataFrame:
    """The last right row at or before each left row's time.

    Time is cut into spans (seconds). Within a span both sides go through one
    window ordered by time (right rows first at equal times); what a span has
    none of comes from the last row of the spans before it, a window over one row
    a span. So no pair of rows is made and a hot key is sorted span by span.
    """
    cols = left.columns
    seconds = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / span).alias("__span")
    row = F.struct(F.col(when).cast("timestamp_ntz").alias("t"), F.col(value).cast("double").alias("v"))
    both = left.select(F.col(key).alias("__k"), seconds(at), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*cols).alias("__l"), F.lit(None).cast("struct<t:timestamp_ntz,v:double>").alias("__r"), F.lit(0).cast("long").alias("__tie"))
    both = both.unionByName(right.select(F.col(key).alias("__k"), seconds(when), F.col(when).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(both.schema["__l"].dataType).alias("__l"), row.alias("__r"), F.col(tie).cast("long").alias("__tie")))
    w = Window.partitionBy("__k", "__span").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    ends = both.groupBy("__k", "__span").agg(F.max_by("__r", F.when(F.col("__side") == 0, F.struct("__t", "__tie"))).alias("__last"))
    before = ends.select("__k", "__span", F.last("__last", ignorenulls=True).over(Window.partitionBy("__k").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    met = here.join(before, ["__k", "__span"], "left").withColumn("__r", F.coalesce("__r", "__before"))
    return met.select("__l.*", F.col("__r.t").alias("as_of"), F.col("__r.v").alias(value))


def recent(df: DataFrame, year: str, n: int) -> DataFrame:
    """Rows of the last n distinct years that are there."""
    years = df.select(year).distinct().orderBy(F.desc(year)).limit(n)
    return df.join(F.broadcast(years), year, "left_semi")
