"""Execution units, refresh and retention as tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def units(specs: DataFrame, start: str, end: str) -> DataFrame:
    """(dataset, source_period, output_key) of each unit from the month ``start`` to ``end`` (first days)."""
    months = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    key = lambda m: F.concat(F.lpad((F.year(m) - 1911).cast("string"), 3, "0"), F.lpad(F.month(m).cast("string"), 2, "0"))
    monthly = F.transform(months, key)
    yearly = F.array_distinct(F.transform(months, lambda m: F.lpad((F.year(m) - 1911).cast("string"), 3, "0")))
    periods = F.when(F.col("strategy") == "MONTHLY", monthly).when(F.col("strategy") == "ANNUAL", yearly).when(F.col("strategy") == "SNAPSHOT", F.array(F.lit("latest"))).otherwise(F.array(F.lit("all")))
    return specs.select("dataset", "strategy", F.explode(periods).alias("output_key")).withColumn("source_period", F.when(~F.col("output_key").isin("latest", "all"), F.col("output_key")))


def due(every: Column, last: Column, now: Column) -> Column:
    """Daily after 24 hours, weekly after 7 days, monthly in another calendar month; never run or unknown is due."""
    # By microseconds: a part of a second short of the time is not due.
    hours = (F.unix_micros(now) - F.unix_micros(last)) / 3_600_000_000
    month = F.date_format(now, "yyyyMM") != F.date_format(last, "yyyyMM")
    return F.coalesce(F.when(every == "daily", hours >= 24).when(every == "weekly", hours >= 168).when(every == "monthly", month), F.lit(True))


def resume_action(status: Column, has_output: Column, has_raw: Column) -> Column:
    return F.when(has_output & (status == "ok"), "reuse_output").when(has_raw & status.isin("ok", "transform_failed"), "reuse_raw").when(status == "no_data", "keep_no_data").otherwise("download")


def retained(df: DataFrame, year: Column, keep_years: int, protected: list[int] = (), newest: int | None = None) -> DataFrame:
    """Rows of the last years and of protected anchors; the newest year is the table's own unless it is given."""
    top = df.agg((F.max(year) if newest is None else F.lit(newest)).alias("__newest"))
    inside = year >= F.col("__newest") - keep_years + 1
    return df.crossJoin(F.broadcast(top)).where(inside | year.isin(*protected) if protected else inside).drop("__newest")


def orphans(artifacts: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return artifacts.join(rows.select(key).distinct(), key, "left_anti")


def with_retry[T](work: Callable[[], T], attempts: int = 3, wait: float = 1.0, on: tuple[type[BaseException], ...] = (TimeoutError,)) -> T:
    """Run driver-side work again after a timeout, anywhere in the exception's chain, waiting twice as long each time."""
    def chain(e: BaseException | None) -> Iterable[BaseException]:
        while e is not None:
            yield e
            e = e.__cause__ or e.__context__

    for k in range(attempts):
        try:
            return work()
        except Exception as e:
            if k + 1 == attempts or not any(isinstance(x, on) for x in chain(e)):
                raise
            time.sleep(wait * 2**k)
    raise AssertionError("no attempt was made")


def selected(profiles: dict[str, list[str]], name: str) -> list[str]:
    """A profile's datasets; a dataset in two profiles is an error."""
    seen: dict[str, str] = {}
    for profile, datasets in profiles.items():
        for d in datasets:
            if d in seen:
                raise ValueError(f"{d} is in {seen[d]} and {profile}")
            seen[d] = profile
    return profiles[name]


def complete(counts: DataFrame, required: list[str]) -> Column | bool:
    """Whether each required source has rows: the gate before a snapshot's pointer moves."""
    have = {r[0] for r in counts.where("n > 0").select("dataset").distinct().collect()}
    return set(required) <= have
