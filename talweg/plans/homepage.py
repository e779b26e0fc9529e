"""The homepage of one plan on the standard tables as stand-ins, with what it says of its inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.operators import homepage, opportunity, recipes
from talweg.plans import opportunity as base
from talweg.plans.base import order_year, query, r

_NUMBERS = [*base._NAMES, *base._PARTS, "opportunity_index"]
_LONG = ", ".join(f"('{c}', {c}::DOUBLE)" for c in _NUMBERS)
_MISSING = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in base._NAMES)

_FIRST = """dem AS (SELECT (a.n - b.n) * 100.0 / b.n AS yoy FROM (SELECT sum(o_orderkey % 10) AS n FROM orders WHERE year(o_orderdate) = 1997) a, (SELECT sum(o_orderkey % 10) AS n FROM orders WHERE year(o_orderdate) = 1996) b),
w AS (SELECT o_totalprice AS v FROM orders WHERE o_orderkey % 3 = 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 1)"""
#: Orders without a district count for the city alone, sales where they are verified; nobody trains.
_INDEX = base.index_sql(district="CASE WHEN o_custkey % 9 <> 0 THEN c_nationkey END", line="WHERE l_returnflag = 'A' OR l_linestatus = 'F'", wage="(SELECT v FROM w)", training="NULL::DOUBLE", demand="(SELECT yoy FROM dem)", digits=(12, 12))

SQL = f"""
WITH {_FIRST}, idx AS MATERIALIZED ({_INDEX}),
cand AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1),
d AS (SELECT district_id::VARCHAR AS key, f.field, f.value, NULL AS note FROM idx, LATERAL (SELECT * FROM (VALUES {_LONG}) v(field, value)) f
  UNION ALL SELECT n_nationkey::VARCHAR, 'candidates', n::DOUBLE, NULL FROM nation LEFT JOIN cand ON k = n_nationkey
  UNION ALL SELECT district_id::VARCHAR, u.f, NULL, u.v FROM idx, LATERAL (SELECT * FROM (VALUES ('district_name', district_name), ('risk', risk), ('status', CASE WHEN opportunity_index IS NULL THEN 'unavailable' ELSE 'observed' END)) v(f, v)) u),
pr AS (SELECT district_id::VARCHAR AS key, unnest(string_split(proxies, ',')) AS field FROM idx WHERE proxies <> ''),
gone AS (SELECT district_id::VARCHAR AS key, unnest(list_filter([{_MISSING}], lambda x: x IS NOT NULL)) AS field FROM idx),
c AS (SELECT year(o_orderdate) AS y, count(*) AS people, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS youth FROM orders GROUP BY 1),
kp AS (SELECT a.youth, a.youth * 100.0 / a.people AS share, (a.youth - b.youth) * 100.0 / b.youth AS yoy FROM c a, c b WHERE a.y = 1996 AND b.y = 1995),
b AS (SELECT year(o_orderdate) AS y, sum(CAST(round(o_totalprice) AS BIGINT))::DOUBLE AS amount FROM orders WHERE year(o_orderdate) <> 1995 AND o_orderstatus = 'F' GROUP BY 1),
g AS (SELECT unnest(range((SELECT min(y) FROM b), (SELECT max(y) + 1 FROM b))) AS y), j AS (SELECT g.y, amount, last_value(amount IGNORE NULLS) OVER (ORDER BY g.y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM g LEFT JOIN b ON g.y = b.y),
bp AS (SELECT y, amount, (amount - prior) / prior * 100 AS yoy FROM j),
inp AS (SELECT 'population' AS k, count(*) AS t, 0 AS u, count(*) AS w, count(*) AS v FROM customer UNION ALL
  SELECT 'job_vacancies', count(*), count(*) FILTER (WHERE o_custkey % 9 = 0), count(*), count(*) FROM orders UNION ALL
  SELECT 'job_vacancy_salaries', count(*), count(*) FILTER (WHERE o_custkey % 9 = 0), count(*) FILTER (WHERE o_orderstatus <> 'P'), count(*) FROM orders UNION ALL
  SELECT 'rentals', count(*), 0, count(*), count(*) FROM lineitem WHERE l_returnflag = 'A' UNION ALL
  SELECT 'house_prices', count(*), 0, count(*), count(*) FILTER (WHERE l_linestatus = 'F') FROM lineitem WHERE l_returnflag = 'R' UNION ALL
  SELECT 'college_majors', count(*), 0, count(*), count(*) FROM supplier UNION ALL
  SELECT 'stops', count(*), 0, count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'view')), count(*) FROM events)
SELECT 'district' AS section, key, field, round(value, 6) AS value, note FROM d
UNION ALL SELECT 'proxy', key, field, NULL, CASE field WHEN 'rent' THEN 'city_minimum_rent' WHEN 'house_price' THEN 'cheapest_district_median' ELSE 'imputed_minimum' END FROM pr
UNION ALL SELECT 'unavailable', key, field, NULL, 'missing_input' FROM gone
UNION ALL SELECT 'kpi', '', u.f, round(u.v, 6), NULL FROM kp, w, dem, LATERAL (SELECT * FROM (VALUES ('national_youth', 4820000.0::DOUBLE), ('city_youth', youth::DOUBLE), ('city_share', share::DOUBLE), ('city_yoy', kp.yoy::DOUBLE), ('year', 1996::DOUBLE), ('latest_wage', w.v::DOUBLE), ('talent_demand_yoy', dem.yoy::DOUBLE)) v(f, v)) u
UNION ALL SELECT 'kpi', '', 'national_quality', NULL, 'proxy'
UNION ALL SELECT 'proxy', '', 'national_youth', NULL, 'homepage_fallback_constant' UNION ALL SELECT 'proxy', '', 'adjusted_youth_wage', NULL, 'proxy_outside_window'
UNION ALL SELECT 'policy', '', u.f, round(u.v, 6), NULL FROM (SELECT arg_max(amount, y) AS a, arg_max(yoy, y) AS q FROM bp WHERE amount IS NOT NULL), LATERAL (SELECT * FROM (VALUES ('current_budget', a), ('budget_yoy', q), ('execution_rate', NULL::DOUBLE), ('execution_year', NULL::DOUBLE)) v(f, v)) u
UNION ALL SELECT 'policy', '', 'execution_failure', NULL, 'missing_settlement'
UNION ALL SELECT 'budget', y::VARCHAR, u.f, round(u.v, 6), u.n FROM bp, LATERAL (SELECT * FROM (VALUES ('amount', amount, NULL), ('yoy', yoy, NULL), ('document_status', NULL, CASE WHEN amount IS NOT NULL THEN 'legal_budget' END), ('status', NULL, CASE WHEN amount IS NULL THEN 'unavailable' ELSE 'observed' END)) v(f, v, n)) u
UNION ALL SELECT 'input', k, u.f, u.v, 'observed' FROM inp, LATERAL (SELECT * FROM (VALUES ('total_rows', t::DOUBLE), ('unmapped_rows', u::DOUBLE), ('complete_rows', w::DOUBLE), ('verified_rows', v::DOUBLE)) v(f, v)) u
UNION ALL SELECT 'excluded', k, 'excluded_rows', (t - v)::DOUBLE, NULL FROM inp
UNION ALL SELECT 'input', 'training_numbers', 'total_rows', 0, 'unavailable'
"""


def not_published(name: str):
    raise FileNotFoundError(f"{name}: no period is published")


@query(SQL)
def q20_homepage(t):
    """Figures of every district, the city and the policy, what stands in for what, and how whole each input was."""
    spark = t.region.sparkSession
    inputs = homepage.Inputs(spark)
    placed = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    orders = placed.select(F.when(F.col("o_custkey") % 9 != 0, F.col("c_nationkey")).alias("district_id"), (1 + F.col("o_orderkey") % 3).alias("positions"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("category"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("salary"))
    lines = t.lineitem.join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("district_id")), F.col("l_suppkey") == F.col("s_suppkey")).select("district_id", F.col("l_extendedprice").alias("price"), "l_linestatus", "l_returnflag")
    stop = F.when(F.col("event_type") == "click", "bus").when(F.col("event_type") == "purchase", "rail").when(F.col("event_type") == "view", "bike")
    people = inputs.add("population", lambda: t.customer.select(F.col("c_nationkey").alias("district_id"), F.col("c_mktsegment").alias("segment")), "district_id int, segment string")
    vacancies = inputs.add("job_vacancies", lambda: orders, "district_id int, positions int, category string")
    salaries = inputs.add("job_vacancy_salaries", lambda: orders, "district_id int, positions int, salary double", "salary IS NOT NULL")
    rents = inputs.add("rentals", lambda: lines.where("l_returnflag = 'A'"), "district_id int, price double")
    houses = inputs.add("house_prices", lambda: lines.where("l_returnflag = 'R'"), "district_id int, price double, l_linestatus string", verified="l_linestatus = 'F'")
    schools = inputs.add("college_majors", lambda: t.supplier.withColumnRenamed("s_nationkey", "district_id"), "district_id int, s_acctbal double")
    stops = inputs.add("stops", lambda: t.events.select((F.col("user_id") % 25).alias("district_id"), stop.alias("kind")), "district_id int, kind string", "kind IS NOT NULL")
    training = inputs.add("training_numbers", lambda: not_published("training_numbers"), "district_id int, people double")

    dated = t.orders.select(order_year().alias("year"), "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    k = F.col("o_orderkey")
    wage = recipes.latest_wage(dated.select(F.when(k % 3 == 0, "25-29歲").otherwise("30-34歲").alias("age_group"), F.lit("中位數").alias("method"), F.col("o_totalprice").alias("value"), F.col("day").alias("period_start"), k.alias("_ord")), [1990])
    demand = recipes.demand_yoy(dated.select("year", (k % 10).alias("new_demand_count")), [1995, 1996, 1997])
    budgets = dated.where("year <> 1995 AND o_orderstatus = 'F'").groupBy("year").agg(F.sum(F.round("o_totalprice").cast("long")).cast("double").alias("amount"), F.min("o_orderkey").alias("_ord"))
    points = recipes.budget_points(budgets.withColumns({"row_type": F.lit("total"), "document_status": F.lit("legal_budget"), "unit": F.lit("TWD_thousand")}), 1990)
    policy = recipes.policy_block(points.select("year", F.col("amount").alias("budget"), "yoy", F.lit(None).cast("double").alias("execution"), F.lit("missing_settlement").alias("failure")))
    city = dated.groupBy("year").agg(F.count("*").alias("people"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("youth"), F.max("day").alias("period"))
    figures = recipes.key_figures(city, spark.createDataFrame([], "period_start string, value double, quality_flags array<string>"), 1996)

    n, segment = F.col("n_nationkey"), lambda *names: F.count_if(F.col("segment").isin(*names))
    population = people.groupBy("district_id").agg(F.count("*").alias("people"), segment("BUILDING", "MACHINERY").alias("youth"), segment("BUILDING", "FURNITURE").alias("youth_before"))
    made = opportunity.features(
        t.nation.select(n.alias("district_id"), F.col("n_name").alias("district_name"), F.when(n > 0, 100.0 + 7 * n).alias("area_km2")),
        population,
        vacancies,
        salaries,
        rents.where("district_id <> 3").select("district_id", (F.col("price") / 100).alias("rent")),
        houses.where("district_id <> 4 AND l_linestatus = 'F'").select("district_id", "price"),
        schools.select("district_id", F.greatest("s_acctbal", F.lit(0.0)).alias("students")),
        schools.where("district_id <> 5").groupBy("district_id").agg(F.count("*").alias("courses")),
        stops,
        wage.select("latest_wage").crossJoin(demand).crossJoin(training.agg(F.sum("people").alias("training_people"))),
    )
    candidates = t.customer.where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("district_id")).agg(F.count("*").alias("n"))
    out = homepage.orchestrated(inputs, opportunity.index(made), {"candidates": (candidates, "n")}, figures, wage, demand, policy, points)
    return out.select("section", "key", "field", r(F.col("value"), 6).alias("value"), F.regexp_replace("note", "unavailable: .*", "unavailable").alias("note"))
