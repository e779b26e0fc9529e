"""One null policy for every module: missing is null, never 0; non-finite is missing; a ratio over nothing is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The number as a double; NaN and infinities become null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def finite_sql(name: str) -> str:
    """``finite`` of a column by name, as SQL: one call where a wide table needs many."""
    d = f"CAST(`{name}` AS DOUBLE)"
    return f"CASE WHEN NOT isnan({d}) AND abs({d}) < double('infinity') THEN {d} END"


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where either is null or b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def yoy(now: Column, before: Column) -> Column:
    """Percentage change; null where the earlier value is null or 0."""
    return ratio(now - before, before) * 100


def sum_complete(c: Column) -> Column:
    """Sum that any null makes null."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def sum_or_zero(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def weighted_available(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are there; null if none is."""
    top = sum((F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in parts), F.lit(0.0))
    return ratio(top, sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts), F.lit(0.0)))


def weighted_complete(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean; null if a part with a positive weight is missing."""
    need = [(v, w) for v, w in parts if w > 0]
    return sum((v * w for v, w in need), F.lit(0.0)) / sum(w for _, w in need)


def status(done: Column, expected: Column) -> Column:
    """observed, partial or unavailable from how much of what was expected is there."""
    return F.when(done >= expected, "observed").when(done > 0, "partial").otherwise("unavailable")


def merged_status(c: Column) -> Column:
    """Aggregate: all unavailable -> unavailable; any other than observed -> partial."""
    return F.when(F.bool_and(c == "unavailable"), "unavailable").when(F.bool_or(c != "observed"), "partial").otherwise("observed")
