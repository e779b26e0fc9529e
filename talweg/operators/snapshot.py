"""A serving snapshot: every item of a release, made by itself, in one write, a manifest of what that write observed, the pointer last.

Items are (pk, sk, body): one for each block of the dashboard, one for each
district, one for each analysis, the manifest after them. Coverage and availability are
counted while the items are written, so nothing is read back to be described. A
reader follows the pointer, which moves only after items and manifest are there
and the release is whole; whatever ends before that leaves the last release as it was.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from talweg.operators.evidence import public
from talweg.sources import scratch

# The blocks and analyses that a release has.
BLOCKS = ["KPIS", "POLICY", "SERVICE_COVERAGE", "ELECTIONS", "POPULATION_TREND", "FERTILITY_TREND", "DISTRICTS"]
ANALYSES = ["employment-scatter", "fertility-overlay", "fertility-family-friendliness", "youth-keyword-frequency", "politics-resource-io", "policy-outcomes"]
ITEM = "pk string, sk string, rows long, body string"


class Incomplete(ValueError):
    """A release that lacks items or districts."""


@dataclass(frozen=True)
class Release:
    snapshot: str
    path: str
    manifest: dict


def _body(df: DataFrame) -> Column:
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})


def listed(df: DataFrame, pk: str, sk: str) -> DataFrame:
    """One item of all rows of a small table, in the order of their JSON; an empty table is an empty list."""
    none = F.lit(None).cast("array<string>").alias("present")
    return public(df).select(_body(df).alias("b")).agg(F.array_sort(F.collect_list("b")).alias("l")).select(F.lit(pk).alias("pk"), F.lit(sk).alias("sk"), F.size("l").cast("long").alias("rows"), F.concat(F.lit("["), F.array_join("l", ","), F.lit("]")).alias("body"), none)


def summaries(districts: DataFrame, fields: list[str]) -> DataFrame:
    """One item a district, with which of ``fields`` it has."""
    present = F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields)))
    return public(districts).select(F.concat(F.lit("DISTRICT#"), F.col("district_id").cast("string")).alias("pk"), F.lit("SUMMARY").alias("sk"), F.lit(1).cast("long").alias("rows"), _body(districts).alias("body"), present.alias("present"))


def items(blocks: dict[str, DataFrame], districts: DataFrame, analyses: dict[str, DataFrame], fields: list[str]) -> DataFrame:
    """Every item but the manifest, with ``present``. Each is written first: one plan of all parts would be the driver's to hold."""
    rows = summaries(districts, fields)
    for name, df in blocks.items():
        rows = rows.unionByName(scratch.kept(listed(df, "DASHBOARD", name), "item"))
    for name, df in analyses.items():
        rows = rows.unionByName(scratch.kept(listed(df, f"ANALYSIS#{name}", "DATA"), "item"))
    return rows


def availability(present: int, expected: int) -> str:
    return "unavailable" if not present else "partial" if present < expected else "available"


def publish(spark: SparkSession, root: str, snapshot: str, blocks: dict[str, DataFrame], districts: DataFrame, analyses: dict[str, DataFrame], fields: list[str], expected: int, candidate: bool = False) -> Release:
    """Write a release: items, then the manifest, then (but for a candidate) the pointer.

    ``expected`` districts are wanted; an item too many or too few, a district
    twice or one missing is ``Incomplete``, and the pointer stays.
    """
    path = f"{root}/snapshot_id={snapshot}"
    seen = Observation("items")
    is_ = lambda prefix: F.startswith("pk", F.lit(prefix))
    counts = {
        "dashboard_items": F.count_if(F.col("pk") == "DASHBOARD"),
        "district_items": F.count_if(is_("DISTRICT#")),
        "analysis_items": F.count_if(is_("ANALYSIS#")),
        "filled_items": F.count_if(~is_("DISTRICT#") & (F.col("rows") > 0)),
        "district_hash": F.bit_xor(F.when(is_("DISTRICT#"), F.xxhash64("pk"))),
        **{f"has_{f}": F.count_if(F.array_contains("present", f)) for f in fields},
    }
    rows = items(blocks, districts, analyses, fields).observe(seen, *(c.alias(n) for n, c in counts.items()))
    rows.drop("present").write.mode("overwrite").parquet(f"{path}/items")
    n = seen.get
    wanted = {"dashboard_items": len(BLOCKS), "analysis_items": len(ANALYSES), "district_items": expected}
    manifest = {
        "schema_version": 1,
        "snapshot_id": snapshot,
        "items": {k: n[k] for k in wanted},
        "coverage": {"district_count": n["district_items"], "expected_district_count": expected, "ratio": n["district_items"] / expected if expected else None},
        "availability": {f: availability(n[f"has_{f}"], expected) for f in fields},
        "filled_items": n["filled_items"],
    }
    spark.createDataFrame([("MANIFEST", "LATEST", 1, json.dumps(manifest, sort_keys=True))], ITEM).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    missing = {k: (n[k], want) for k, want in wanted.items() if n[k] != want}
    if missing or set(blocks) != set(BLOCKS) or set(analyses) != set(ANALYSES):
        raise Incomplete(f"{snapshot}: " + "; ".join([f"{k}: {a} of {b}" for k, (a, b) in missing.items()] or ["other blocks or analyses than a release has"]))
    if not candidate:
        point(spark, root, snapshot)
    return Release(snapshot, path, manifest)


def point(spark: SparkSession, root: str, snapshot: str) -> None:
    """Move the pointer: a row is added, so a reader meets the release before or this one, never none."""
    moved = spark.createDataFrame([(snapshot,)], "snapshot_id string").withColumn("at", F.current_timestamp())
    moved.coalesce(1).write.mode("append").parquet(f"{root}/current")


def current(spark: SparkSession, root: str) -> str:
    return spark.read.parquet(f"{root}/current").agg(F.max_by("snapshot_id", "at").alias("s")).first().s


def read(spark: SparkSession, root: str, snapshot: str | None = None) -> DataFrame:
    """All items of a release, the manifest among them; by default the one that the pointer names."""
    path = f"{root}/snapshot_id={snapshot or current(spark, root)}"
    return spark.read.schema(ITEM).parquet(f"{path}/items").unionByName(spark.read.schema(ITEM).parquet(f"{path}/manifest"))
