"""Runs: a state table of units, reports, and the pass that brings landed datasets to curated ones.

State and reports are Parquet tables that are only added to: a unit's state is its
latest row, so a reader never meets a half-written one. The pass is a loop over
units (datasets by periods, bounded by the request), each a Spark job.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.operators import planner
from talweg.operators.quality import Split
from talweg.sources import tables

STATE = "dataset string, output_key string, status string, at timestamp, message string"


class State:
    """What became of each unit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/state"

    def record(self, dataset: str, key: str, status: str, message: str | None = None) -> None:
        now = datetime.datetime.now(datetime.timezone.utc)
        self.spark.createDataFrame([(dataset, key, status, now, message)], STATE).coalesce(1).write.mode("append").parquet(self.path)

    def history(self) -> DataFrame:
        try:
            return self.spark.read.schema(STATE).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], STATE)

    def current(self) -> DataFrame:
        """Each unit's latest row."""
        return self.history().groupBy("dataset", "output_key").agg(F.max_by(F.struct("status", "at", "message"), F.struct("at", "status")).alias("s")).select("dataset", "output_key", "s.*")


def report(df: DataFrame, root: str, kind: str) -> None:
    """Add a report's rows to the table of its kind."""
    df.withColumn("reported_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/reports/{kind}")


@dataclass(frozen=True)
class Source:
    """A dataset that a pass can bring: how its periods follow, how one is opened (landed rows with ``_ord``), how it is transformed."""

    dataset: str
    strategy: str
    open: Callable[[SparkSession, str], DataFrame]
    transform: Callable[[DataFrame], Split]


@dataclass
class Outcome:
    done: list[tuple[str, str]] = field(default_factory=list)
    kept: list[tuple[str, str]] = field(default_factory=list)
    failed: list[tuple[str, str, str]] = field(default_factory=list)


def wanted(spark: SparkSession, sources: list[Source], start: str, end: str, state: State, force: bool = False, failed_only: bool = False) -> DataFrame:
    """Units of the request that are to be run: all by ``force``, failed ones by ``failed_only``, else those not done."""
    specs = spark.createDataFrame([(s.dataset, s.strategy) for s in sources], "dataset string, strategy string")
    units = planner.units(specs, start, end).join(state.current().select("dataset", "output_key", "status"), ["dataset", "output_key"], "left")
    if failed_only:
        return units.where("status = 'failed'")
    return units if force else units.where("status IS NULL OR status <> 'ok'")


def run(spark: SparkSession, root: str, sources: list[Source], start: str, end: str, force: bool = False, failed_only: bool = False, strict: bool = False) -> Outcome:
    """Bring every unit to curated, quarantine and quality tables; a failure is recorded and, by ``strict``, ends the pass."""
    state, by_name, out = State(spark, root), {s.dataset: s for s in sources}, Outcome()
    units = wanted(spark, sources, start, end, state, force, failed_only).orderBy("dataset", "output_key").collect()
    for u in units:
        try:
            got = by_name[u.dataset].transform(by_name[u.dataset].open(spark, u.output_key))
            tables.write_triple(got.accepted, got.quarantine, got.quality, root, u.dataset, u.output_key)
            state.record(u.dataset, u.output_key, "ok")
            out.done.append((u.dataset, u.output_key))
        except Exception as e:
            state.record(u.dataset, u.output_key, "failed", str(e)[:500])
            out.failed.append((u.dataset, u.output_key, str(e)))
            if strict:
                raise
    asked = {(s.dataset, r.output_key) for s in sources for r in wanted(spark, [s], start, end, state, force=True).select("output_key").collect()}
    out.kept = sorted(asked - set(out.done) - {(d, k) for d, k, _ in out.failed})
    rows = [("done", *x, None) for x in out.done] + [("kept", *x, None) for x in out.kept] + [("failed", *x) for x in out.failed]
    report(spark.createDataFrame(rows, "outcome string, dataset string, output_key string, message string"), root, "collection")
    return out


def replay(spark: SparkSession, listing: DataFrame, sources: list[Source], read: Callable[[SparkSession, str], DataFrame], root: str) -> DataFrame:
    """Transform the newest landed file of each (dataset, output_key) again into another root; (dataset, output_key, rows)."""
    by_name = {s.dataset: s for s in sources}
    newest = tables.newest(listing.withColumn("unit", F.struct("dataset", "output_key")), "unit").select("unit.*", "path").orderBy("dataset", "output_key").collect()
    sizes = []
    for u in newest:
        got = by_name[u.dataset].transform(read(spark, u.path))
        tables.write_triple(got.accepted, got.quarantine, got.quality, root, u.dataset, u.output_key)
        sizes.append((u.dataset, u.output_key, got.accepted.count()))
    return spark.createDataFrame(sizes, "dataset string, output_key string, rows long")


#: The queries that make up each metric of the analytics run.
METRICS = {
    "homepage": ["q20_homepage", "q01_population_annual", "q02_fertility_annual", "q03_budget_execution", "q04_opportunity_index", "q05_key_figures", "q06_budget_points", "q06_policy_block", "q12_service_coverage"],
    "employment": ["q17_employment_scatter", "q17_two_scatters", "g26_vacancy_summary"],
    "fertility": ["q02_fertility_annual", "q18_family_index", "q18_family_page"],
    "youth_participation": ["q10_candidacy_by_type", "q11_representation_ratio", "q13_proposal_funnel", "q14_grants_scope"],
    "policy_support": ["q19_complete_trend", "q19_whole_months", "q19_wage_trend", "q15_allocation_reasons"],
    "youth_keyword_frequency": ["q16_keyword_ranking", "q16_policy_terms"],
}


def analytics(spark: SparkSession, sf_dir: str, root: str, metric: str = "all", snapshot: str | None = None, publish: bool = False) -> list[str]:
    """Run a metric's queries (or all) and write them as one snapshot; the pointer moves only if asked. The queries' names."""
    from talweg.plans import registry

    queries = registry.queries()
    names = list(dict.fromkeys(q for m, of in METRICS.items() if metric in ("all", m) for q in of))
    if not names:
        raise ValueError(f"unknown metric: {metric}")
    snapshot = snapshot or datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    tables.publish({n: queries[n](spark, sf_dir) for n in names}, root, snapshot, candidate=not publish)
    return names
