"""Contracts: every input row is accepted or quarantined with a reason, and counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

GEO_LEVELS = ["national", "city", "district", "village", "point"]
# Eligibility follows from the age scope.
ELIGIBILITY = {"youth_18_35": "eligible", "all_ages": "context", "proxy": "proxy", "unknown": "unknown"}


@dataclass(frozen=True)
class Split:
    accepted: DataFrame
    quarantine: DataFrame
    quality: DataFrame


def reasoned(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``reject_reason``: the first rule that a row breaks. A rule is true where it is broken; null breaks nothing."""
    return df.withColumn("reject_reason", F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in rules.items())) if rules else F.lit(None).cast("string"))


def split(df: DataFrame, rules: dict[str, Column], order: str) -> Split:
    """Accepted rows, quarantined rows (their place, the raw row, the reason) and one row of counters."""
    marked = reasoned(df, rules)
    bad = marked.where(F.col("reject_reason").isNotNull())
    quarantine = bad.select(F.col(order).alias("input_index"), F.to_json(F.struct(*df.columns)).alias("raw_record"), "reject_reason")
    return Split(marked.where(F.col("reject_reason").isNull()).drop("reject_reason"), quarantine, counters(marked))


def counters(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count("*").alias("input_rows"), F.count_if(F.col("reject_reason").isNull()).alias("accepted_rows"), F.count("reject_reason").alias("quarantined_rows"))


def observed(marked: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same counters as a side product of whatever action runs first: no second pass."""
    seen = Observation(name)
    return marked.observe(seen, F.count(F.lit(1)).alias("input_rows"), F.count("reject_reason").alias("quarantined_rows")), seen


def reasons(marked: DataFrame) -> DataFrame:
    return marked.where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("n"))


def header_violations(df: DataFrame) -> DataFrame:
    """Rows of curated data whose common header breaks the contract, with the first reason."""
    scope, low, high = F.col("age_scope"), F.col("age_min"), F.col("age_max")
    wanted = F.create_map(*(F.lit(x) for kv in ELIGIBILITY.items() for x in kv))[scope]
    rules = {
        "geo_level": ~F.col("geo_level").isin(GEO_LEVELS),
        "youth_eligibility": ~F.col("youth_eligibility").eqNullSafe(wanted),
        "age_bounds": low.isNull() != high.isNull(),
        "youth_bounds": (scope == "youth_18_35") & ~(low.eqNullSafe(F.lit(18)) & high.eqNullSafe(F.lit(35))),
        "period": F.col("period_start") > F.col("period_end"),
    }
    return reasoned(df, rules).where("reject_reason IS NOT NULL")
