"""The fertility page and whole-month trends, from registered queries and whole tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.operators import family
from talweg.plans import indicators, opportunity, places  # noqa: F401  their queries are the page's parts
from talweg.plans.base import ORACLES, QUERIES, query, r
from talweg.sources import scratch


def _level(c: str, q: str) -> str:
    return f"CASE WHEN {c} <= {q}1 THEN 'low' WHEN {c} >= {q}3 THEN 'high' WHEN {c} IS NOT NULL THEN 'medium' END"


def _scaled(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 100 ELSE 50 END"


@query(f"""WITH a AS (SELECT k, rate, births * 1.0 AS youth, coverage = 1 AS whole FROM ({ORACLES["q02_fertility_annual"]}) WHERE y = 1996), s AS (SELECT * FROM ({ORACLES["q12_service_coverage"]})), x AS (SELECT * FROM ({ORACLES["q04_opportunity_index"]})),
d AS (SELECT n_nationkey AS district_id, n_name AS district_name, rate, CASE WHEN n_nationkey <> 7 THEN youth END AS youth, coalesce(whole, false) AS whole, s.value AS daycare, x.opportunity_index AS o, x.housing, x.salary_median_shrunk AS salary FROM nation LEFT JOIN a ON k = n_nationkey LEFT JOIN s ON s.district_id = n_nationkey LEFT JOIN x ON x.district_id = n_nationkey),
z AS (SELECT *, CASE WHEN rate IS NULL AND youth IS NULL THEN 'unavailable' WHEN rate IS NOT NULL AND youth IS NOT NULL AND whole THEN 'observed' ELSE 'partial' END AS status, {_scaled("daycare")} AS zd, {_scaled("salary")} AS zs FROM d),
f AS (SELECT *, (zd + housing + zs) / 3 AS fafi FROM z), q AS (SELECT quantile_cont(fafi, 0.25) AS f1, quantile_cont(fafi, 0.75) AS f3, quantile_cont(rate, 0.25) AS r1, quantile_cont(rate, 0.75) AS r3 FROM f),
c AS (SELECT CASE WHEN bool_and(status = 'unavailable') THEN 'unavailable' WHEN bool_or(status <> 'observed') THEN 'partial' ELSE 'observed' END AS ys, CASE WHEN count(fafi) = 0 THEN 'unavailable' WHEN count(fafi) < count(*) THEN 'partial' ELSE 'observed' END AS fs, regr_count(rate, o) AS n, regr_slope(rate, o) AS slope, regr_r2(rate, o) AS r2 FROM f)
SELECT district_id, district_name, round(rate, 4) AS fertility_rate, round(daycare, 4) AS daycare, round(fafi, 4) AS fafi, {_level('fafi', 'f')} AS fafi_level, {_level('rate', 'r')} AS fertility_level, status, NULL AS daycare_status, NULL AS fafi_status, NULL AS reasons, NULL AS n, NULL AS slope, NULL AS r2 FROM f, q
UNION ALL SELECT NULL, NULL, NULL, round(s.value, 4), NULL, NULL, NULL, 'partial', s.status, 'partial', 'daycare_coverage_partial' || CASE WHEN fs <> 'observed' THEN ',fafi_component_missing' ELSE '' END, n, round(slope, 6), round(r2, 6) FROM c, s WHERE s.district_id IS NULL""")
def q18_family_page(t):
    """Nations are districts: births of a year, service coverage as daycare, the index's housing and salaries."""
    # A row a district, read by the districts and by the city: each part runs once, in a plan of its own.
    part = lambda name: scratch.kept(QUERIES[name](t._spark, t._dir), name)
    births = part("q02_fertility_annual").where("y = 1996")
    annual = births.select(F.col("k").alias("district_id"), F.col("rate").alias("fertility_rate"), F.when(F.col("k") != 7, F.col("births")).alias("youth_ratio"), (F.col("coverage") == 1).alias("complete"))
    index = part("q04_opportunity_index").select("district_id", "opportunity_index", "housing", F.col("salary_median_shrunk").alias("salary"))
    districts = t.nation.select(F.col("n_nationkey").alias("district_id"), F.col("n_name").alias("district_name"))
    out = family.page(districts, annual, part("q12_service_coverage"), index)
    return out.select("district_id", "district_name", *(r(F.col(c)).alias(c) for c in ("fertility_rate", "daycare", "fafi")), "fafi_level", "fertility_level", "status", "daycare_status", "fafi_status", F.array_join("reasons", ",").alias("reasons"), "n", r(F.col("slope"), 6).alias("slope"), r(F.col("r2"), 6).alias("r2"))


@query("""WITH v AS (SELECT year(o_orderdate) AS y, c_nationkey AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE month(o_orderdate) = 7 AND NOT (year(o_orderdate) = 1996 AND c_nationkey = 5) GROUP BY 1, 2),
s AS (SELECT y, sum(v) AS v, count(*) AS n FROM v GROUP BY y), g AS (SELECT unnest(range(1993, 2001))::INT AS year), w AS (SELECT year, CASE WHEN n = (SELECT count(*) FROM nation) THEN v END AS v, coalesce(n, 0) AS n FROM g LEFT JOIN s ON y = year)
SELECT a.year, round(a.v, 2) AS value, round((a.v - b.v) / b.v * 100, 6) AS yoy, a.n AS districts FROM w a LEFT JOIN w b ON b.year = a.year - 1""")
def q19_whole_months(t):
    """July's totals of each year; a year in which a district is missing has none, nor has the year after a change."""
    rows = t.orders.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("district_id")), F.col("o_custkey") == F.col("c_custkey"))
    year = F.year("o_orderdate")
    records = rows.where(~((year == 1996) & (F.col("district_id") == 5))).select("district_id", year.alias("year"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("_ord"))
    out = family.monthly_trend(records, list(range(1993, 2001)), t.nation.select(F.col("n_nationkey").alias("district_id")))
    return out.select("year", r(F.col("value"), 2).alias("value"), r(F.col("yoy"), 6).alias("yoy"), "districts")
