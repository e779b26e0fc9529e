"""The homepage from one plan: inputs that count themselves, figures that say what stands in for what, one write.

Every input is a node that carries its own quality through the plan: how many
rows it has, how many have no district, how many are whole and how many may not
be used. The counts are observed while the plan's one write reads the inputs, so
no input is read again to be counted. An input that can't be opened is an empty
one of the stated schema; its reason is recorded, and the figures behind it are
unavailable or stand-ins, which are recorded for each district.

The result is a table of facts: section, key (a district, a year or a dataset),
field, value (a number) and note (a text).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from talweg.operators import opportunity
from talweg.sources import scratch

FACT = "section string, key string, field string, value double, note string"
#: Counts of an input: all rows, rows without a district, whole rows, rows that may be used.
COUNTS = ["total_rows", "unmapped_rows", "complete_rows", "verified_rows"]
# Why a figure is a stand-in.
STAND_INS = {"rent": "city_minimum_rent", "house_price": "cheapest_district_median", "courses": "imputed_minimum", "national_youth": "homepage_fallback_constant"}
SECONDS = 5.0


@dataclass
class Inputs:
    """The inputs of one run by name."""

    spark: SparkSession
    seen: dict[str, Observation] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, open_: Callable[[], DataFrame], schema: str, complete: str = "true", verified: str = "true", place: str | None = "district_id") -> DataFrame:
        """The input's columns of ``schema``; ``complete`` and ``verified`` are SQL over them."""
        columns = [c.strip().split()[0] for c in schema.split(",")]
        try:
            df = open_().select(*columns)
        except (AnalysisException, ValueError, OSError) as e:
            self.failed[name] = str(e).split("\n")[0][:200]
            return self.spark.createDataFrame([], schema)
        self.seen[name] = Observation(f"input-{name}")
        count = lambda test: F.count_if(F.coalesce(F.expr(test), F.lit(False)))
        counts = [F.count(F.lit(1)), count(f"{place} IS NULL") if place else F.lit(0).cast("long"), count(complete), count(verified)]
        return df.observe(self.seen[name], *(c.alias(n) for n, c in zip(COUNTS, counts)) if place else (c.alias(n) for n, c in zip(COUNTS, counts) if n != "unmapped_rows"))

    def quality(self, written: Observation) -> list[tuple]:
        """Facts of the section "input", once the write that ``written`` observed has ended.

        Counts come with that write's own; an input whose counts don't come was empty, so that its part of the plan never ran.
        """
        total = written.get["facts"]
        assert total is not None
        until = time.monotonic() + SECONDS
        while time.monotonic() < until and not all(o._jo.future().isCompleted() for o in self.seen.values()):
            time.sleep(0.05)
        rows = []
        for name, o in self.seen.items():
            counts = o.get if o._jo.future().isCompleted() else {}
            rows += [("input", name, c, float(counts.get(c) or 0), "observed") for c in COUNTS]
            rows.append(("excluded", name, "excluded_rows", float((counts.get("total_rows") or 0) - (counts.get("verified_rows") or 0)), None))
        rows += [("input", name, "total_rows", 0.0, f"unavailable: {why}") for name, why in self.failed.items()]
        return rows


def facts(df: DataFrame, section: str, key: Column, values: list[str], notes: list[str] = ()) -> DataFrame:
    """Each row's values (numbers) and notes (texts) as facts."""
    one = [F.struct(F.lit(n).alias("field"), F.col(n).cast("double").alias("value"), F.lit(None).cast("string").alias("note")) for n in values]
    one += [F.struct(F.lit(n).alias("field"), F.lit(None).cast("double").alias("value"), F.col(n).cast("string").alias("note")) for n in notes]
    return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), F.explode(F.array(*one)).alias("f")).select("section", "key", "f.*")


def districts(index: DataFrame, attached: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """Facts of the districts and of what stands in for them; ``attached`` are further figures: name to (table by district_id, column)."""
    for name, (df, column) in attached.items():
        index = index.join(df.select("district_id", F.col(column).cast("double").alias(name)), "district_id", "left")
    own = facts(index, "district", F.col("district_id"), [*opportunity.FEATURES, *opportunity.COMPONENTS, "opportunity_index", *attached], ["district_name", "risk", "status"])
    missing = [("z_" + c, c) for c in opportunity.FEATURES]
    reasons = F.create_map(*(F.lit(x) for kv in STAND_INS.items() for x in kv))
    proxies = index.select("district_id", F.explode("proxies").alias("field")).select(F.lit("proxy").alias("section"), F.col("district_id").cast("string").alias("key"), "field", F.lit(None).cast("double").alias("value"), reasons[F.col("field")].alias("note"))
    gone = index.select("district_id", F.explode(F.array_compact(F.array(*(F.when(F.col(z).isNull(), F.lit(c)) for z, c in missing)))).alias("field"))
    return own, proxies.unionByName(gone.select(F.lit("unavailable").alias("section"), F.col("district_id").cast("string").alias("key"), "field", F.lit(None).cast("double").alias("value"), F.lit("missing_input").alias("note")))


def orchestrated(inputs: Inputs, index: DataFrame, attached: dict[str, tuple[DataFrame, str]], figures: DataFrame, wage: DataFrame, demand: DataFrame, policy: DataFrame, points: DataFrame, blocking: DataFrame | None = None) -> DataFrame:
    """All facts of the homepage from one write.

    ``index``: the opportunity index; ``figures``, ``wage``, ``demand``,
    ``policy``: one row each, as ``recipes`` makes them; ``points``: budget points
    by year; ``blocking``: one row with ``status`` and an array ``reasons``.
    """
    none = F.lit("")
    own, stand_ins = districts(index, attached)
    proxy = lambda df, name, test, reason: df.where(test).select(F.lit("proxy").alias("section"), none.alias("key"), F.lit(name).alias("field"), F.lit(None).cast("double").alias("value"), reason.alias("note"))
    parts = [
        own,
        stand_ins,
        facts(figures, "kpi", none, ["national_youth", "city_youth", "city_share", "city_yoy", "year"], ["national_quality"]),
        proxy(figures, "national_youth", F.col("national_quality") == "proxy", F.lit(STAND_INS["national_youth"])),
        facts(wage, "kpi", none, ["latest_wage"]),
        proxy(wage, "adjusted_youth_wage", F.col("quality") != "observed", F.col("quality")),
        facts(demand, "kpi", none, ["talent_demand_yoy"]),
        facts(policy, "policy", none, ["current_budget", "budget_yoy", "execution_rate", "execution_year"], ["execution_failure"]),
        facts(points, "budget", F.col("year"), ["amount", "yoy"], ["document_status", "status"]),
    ]
    if blocking is not None:
        parts.append(facts(blocking, "service", none, [], ["status"]))
        parts.append(blocking.select(F.explode("reasons").alias("note")).select(F.lit("blocking").alias("section"), none.alias("key"), F.lit("service_coverage").alias("field"), F.lit(None).cast("double").alias("value"), "note"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    done = Observation("homepage")
    out = scratch.kept(whole.observe(done, F.count(F.lit(1)).alias("facts")), "homepage")
    # A few rows an input.
    return out.unionByName(inputs.spark.createDataFrame(inputs.quality(done), FACT))
