"""Amounts in the units that figures are published in; only positive ones convert."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talweg.functions.nulls import finite

#: Square metres of a ping (its inverse is the factor of a price), and of the currency's units.
PING, WAN, THOUSAND = 3.305785, 10_000.0, 1000.0


def _positive(c: Column) -> Column:
    v = finite(c).cast("double")
    return F.when(v > 0, v)


def price_per_ping(per_square_metre: Column) -> Column:
    return _positive(per_square_metre) * PING


def to_wan(amount: Column) -> Column:
    return _positive(amount) / WAN


def from_thousand(amount: Column, unit: Column) -> Column:
    """Single units of what is stated in thousands ("千元", "TWD_thousand") or already single ("元", "TWD"); null for another unit."""
    factor = F.when(unit.isin("千元", "TWD_thousand"), THOUSAND).when(unit.isin("元", "TWD"), 1.0)
    return _positive(amount) * factor
