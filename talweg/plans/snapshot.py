"""A whole release from the registered queries: its items, and what its manifest says of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talweg.operators import snapshot
from talweg.plans import basics, datasets, evidence_text, homepage, indicators, opportunity, places, recipes, relational  # noqa: F401  their queries are the release's parts
from talweg.plans.base import ORACLES, QUERIES, query
from talweg.sources import scratch

BLOCKS = {"KPIS": "q05_key_figures", "POLICY": "q06_policy_block", "SERVICE_COVERAGE": "q12_service_coverage", "ELECTIONS": "q10_candidacy_by_type", "POPULATION_TREND": "q01_population_annual", "FERTILITY_TREND": "q02_fertility_annual", "DISTRICTS": "q04_opportunity_index"}
ANALYSES = {"employment-scatter": "q17_two_scatters", "fertility-overlay": "q17_employment_scatter", "fertility-family-friendliness": "q18_family_index", "youth-keyword-frequency": "q16_keyword_ranking", "politics-resource-io": "q15_allocation_reasons", "policy-outcomes": "q19_wage_trend"}
FIELDS = ["opportunity_index", "rail_density", "training_per_10k_youth"]


def _sql() -> str:
    n = lambda name: f"(SELECT count(*) FROM ({ORACLES[name]}))"
    blocks = " UNION ALL ".join(f"SELECT 'DASHBOARD' AS pk, '{k}' AS sk, {n(q)} AS rows, NULL AS manifest" for k, q in BLOCKS.items())
    analyses = " UNION ALL ".join(f"SELECT 'ANALYSIS#{k}', 'DATA', {n(q)}, NULL" for k, q in ANALYSES.items())
    status = lambda f: f"CASE WHEN count({f}) = 0 THEN 'unavailable' WHEN count({f}) < count(*) THEN 'partial' ELSE 'available' END"
    return f"""{blocks} UNION ALL {analyses} UNION ALL SELECT 'DISTRICT#' || n_nationkey, 'SUMMARY', 1, NULL FROM nation
    UNION ALL SELECT 'MANIFEST', 'LATEST', 1, concat_ws(' ', '{len(BLOCKS)}', count(*), '{len(ANALYSES)}', '1.0', {", ".join(status(f) for f in FIELDS)}) FROM ({ORACLES["q04_opportunity_index"]})"""


def release(spark, sf_dir: str, root: str, name: str, candidate: bool = False) -> snapshot.Release:
    """Run every part of a release over a directory of tables and publish it: items, manifest, pointer."""
    part = lambda query_name: QUERIES[query_name](spark, sf_dir)
    districts = scratch.kept(part(BLOCKS["DISTRICTS"]), "districts")
    blocks = {k: districts if k == "DISTRICTS" else part(q) for k, q in BLOCKS.items()}
    expected = spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    return snapshot.publish(spark, root, name, blocks, districts, {k: part(q) for k, q in ANALYSES.items()}, FIELDS, expected, candidate)


@query(_sql())
def q23_release_items(t):
    """The items of a release, read where the pointer points: 7 blocks, a district each, 6 analyses, the manifest."""
    spark = t._spark
    root = f"{scratch.folder(spark)}/published-{uuid.uuid4().hex}"
    release(spark, t._dir, root, "s1")
    field = lambda path: F.get_json_object("body", path)
    manifest = F.concat_ws(" ", field("$.items.dashboard_items"), field("$.items.district_items"), field("$.items.analysis_items"), field("$.coverage.ratio"), *(field(f"$.availability.{f}") for f in FIELDS))
    return snapshot.read(spark, root).select("pk", "sk", "rows", F.when(F.col("pk") == "MANIFEST", manifest).alias("manifest"))
