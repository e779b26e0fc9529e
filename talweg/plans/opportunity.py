"""The opportunity index in full, on the standard tables as stand-ins: nations are districts."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.operators import opportunity
from talweg.plans.base import query, r

#: The SQL's own features (those of which less is better with their sign turned), components and weights.
_UP = "youth_ratio youth_yoy vacancies_per_10k_youth vacancies_per_km2 occupation_entropy talent_demand_yoy salary_median salary_median_shrunk high_salary_ratio adjusted_youth_wage college_student_density course_count training_per_10k_youth bus_per_10k_youth rail_density bike_density".split()
_DOWN = "rent_median house_price_median rent_wage_ratio".split()
_NAMES = _UP + _DOWN
_PARTS = {
    "job": "vacancies_per_km2 0.6 occupation_entropy 0.4",
    "salary": "salary_median_shrunk 0.6 high_salary_ratio 0.4",
    "talent": "youth_ratio 0.4 youth_yoy 0.4 college_student_density 0.2",
    "housing": "rent_median 0.35 house_price_median 0.35 rent_wage_ratio 0.3",
    "transport": "bus_per_10k_youth 0.35 rail_density 0.4 bike_density 0.25",
}
_INDEX = "job 0.25 salary 0.25 talent 0.15 housing 0.2 transport 0.15"


def _weighted(parts: str) -> str:
    names, weights = parts.split()[::2], parts.split()[1::2]
    top = " + ".join(f"coalesce({c} * {w}, 0)" for c, w in zip(names, weights))
    bottom = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for c, w in zip(names, weights))
    return f"CASE WHEN {' AND '.join(f'{c} IS NULL' for c in names)} THEN NULL ELSE ({top}) / ({bottom}) END"


_RAW = ", ".join(f"{c} AS own_{c}" for c in _NAMES)
_SCALED = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL WHEN max({c}) OVER () > min({c}) OVER () THEN {'100 - ' if c in _DOWN else ''}({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 100 ELSE 50 END AS {c}" for c in _NAMES)
def index_sql(before: str = "", district: str = "c_nationkey", line: str = "", wage: str = "(SELECT max(o_totalprice) FROM orders)", training: str = "(SELECT count(*) FROM part)", demand: str = "12.5::DOUBLE", digits: tuple[int, int] = (4, 7)) -> str:
    """The whole index over the standard tables; the arguments are what another plan takes otherwise."""
    return f"""WITH {before} ord AS (SELECT {district} AS k, 1 + o_orderkey % 3 AS positions, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority ELSE 'unknown' END AS category, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS salary FROM orders JOIN customer ON o_custkey = c_custkey),
line AS (SELECT s_nationkey AS k, l_returnflag AS flag, l_extendedprice AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey {line}),
pop AS (SELECT c_nationkey AS k, count(*) AS people, count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS youth, count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')) AS before FROM customer GROUP BY 1),
job AS (SELECT k, sum(positions) AS positions, median(salary) AS salary, count(salary) AS salary_n FROM ord GROUP BY 1),
ent AS (SELECT k, -sum(n / s * log2(n / s)) AS entropy FROM (SELECT k, category, sum(positions)::DOUBLE AS n, sum(sum(positions)) OVER (PARTITION BY k)::DOUBLE AS s FROM ord GROUP BY 1, 2) GROUP BY 1),
citysal AS (SELECT median(salary) AS m FROM ord),
high AS (SELECT k, sum(positions) FILTER (WHERE salary > 1.5 * m) AS n FROM ord, citysal GROUP BY 1),
rent AS (SELECT k, median(price / 100) AS m FROM line WHERE flag = 'A' AND k <> 3 GROUP BY 1), leastrent AS (SELECT min(price / 100) AS m FROM line WHERE flag = 'A' AND k <> 3),
house AS (SELECT k, median(price) AS m FROM line WHERE flag = 'R' AND k <> 4 GROUP BY 1), cityhouse AS (SELECT median(price) AS m FROM line WHERE flag = 'R' AND k <> 4), cheap AS (SELECT min(m) AS m FROM house),
stu AS (SELECT s_nationkey AS k, sum(greatest(s_acctbal, 0)) AS n FROM supplier GROUP BY 1),
cou AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey <> 5 GROUP BY 1),
sto AS (SELECT user_id % 25 AS k, count(*) FILTER (WHERE event_type = 'click') AS bus, count(*) FILTER (WHERE event_type = 'purchase') AS rail, count(*) FILTER (WHERE event_type = 'view') AS bike FROM events GROUP BY 1),
city AS (SELECT {wage} AS wage, {training} AS training, (SELECT sum(youth) FROM pop) AS youth),
f AS (SELECT n_nationkey AS k, n_name AS name, pop.youth * 100.0 / people AS youth_ratio, (pop.youth - before) * 100.0 / nullif(before, 0) AS youth_yoy,
  coalesce(positions, 0) * 10000.0 / nullif(pop.youth, 0) AS vacancies_per_10k_youth, coalesce(positions, 0) * 1.0 / area AS vacancies_per_km2, coalesce(entropy, 0) AS occupation_entropy, {demand} AS talent_demand_yoy,
  salary AS salary_median, CASE WHEN salary IS NULL THEN citysal.m ELSE (salary_n * salary + 30 * citysal.m) / (salary_n + 30) END AS salary_median_shrunk, coalesce(high.n, 0) * 1.0 / positions AS high_salary_ratio,
  wage * coalesce(house.m, cheap.m) / cityhouse.m AS adjusted_youth_wage, coalesce(stu.n, 0) / area AS college_student_density, coalesce(cou.n, (SELECT min(n) FROM cou))::DOUBLE AS course_count, training * 10000.0 / city.youth AS training_per_10k_youth,
  coalesce(rent.m, leastrent.m) AS rent_median, coalesce(house.m, cheap.m) AS house_price_median, coalesce(rent.m, leastrent.m) / salary AS rent_wage_ratio,
  coalesce(bus, 0) * 10000.0 / nullif(pop.youth, 0) AS bus_per_10k_youth, coalesce(rail, 0) / area AS rail_density, coalesce(bike, 0) / area AS bike_density, concat_ws(',', CASE WHEN rent.m IS NULL THEN 'rent' END, CASE WHEN house.m IS NULL THEN 'house_price' END, CASE WHEN cou.n IS NULL THEN 'courses' END) AS proxies
  FROM (SELECT *, CASE WHEN n_nationkey > 0 THEN 100.0 + 7 * n_nationkey END AS area FROM nation) LEFT JOIN pop ON pop.k = n_nationkey LEFT JOIN job ON job.k = n_nationkey LEFT JOIN ent ON ent.k = n_nationkey LEFT JOIN high ON high.k = n_nationkey
  LEFT JOIN rent ON rent.k = n_nationkey LEFT JOIN house ON house.k = n_nationkey LEFT JOIN stu ON stu.k = n_nationkey LEFT JOIN cou ON cou.k = n_nationkey LEFT JOIN sto ON sto.k = n_nationkey, citysal, leastrent, cityhouse, cheap, city),
z AS (SELECT k, name, proxies, {_RAW}, {_SCALED} FROM f),
c AS (SELECT k, name, proxies, {", ".join(f"own_{c}" for c in _NAMES)}, {", ".join(f"{_weighted(parts)} AS {name}" for name, parts in _PARTS.items())} FROM z),
w AS (SELECT *, {_weighted(_INDEX)} AS raw FROM c),
i AS (SELECT *, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) * 100, 6) AS idx FROM w)
SELECT k AS district_id, name AS district_name, {", ".join(f"round({c}, {digits[0]}) AS {c}" for c in _PARTS)}, {", ".join(f"round(own_{c}, {digits[1]}) AS {c}" for c in _NAMES)}, round(idx, {digits[0]}) AS opportunity_index, CASE WHEN idx <= q1 THEN 'high' WHEN idx >= q3 THEN 'low' WHEN idx IS NOT NULL THEN 'medium' ELSE 'unavailable' END AS risk,
  proxies FROM i, (SELECT quantile_cont(idx, 0.25) AS q1, quantile_cont(idx, 0.75) AS q3 FROM i)"""


@query(index_sql())
def q04_opportunity_index(t):
    """Orders are vacancies and salaries, customers people, lines rents and sales, suppliers students and courses, events stops."""
    k = F.col("n_nationkey")
    ord_ = t.orders.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("district_id")), F.col("o_custkey") == F.col("c_custkey"))
    known, positions = F.col("o_orderstatus") != "P", (1 + F.col("o_orderkey") % 3).alias("positions")
    line = t.lineitem.join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("district_id")), F.col("l_suppkey") == F.col("s_suppkey"))
    of = lambda flag, without: line.where((F.col("l_returnflag") == flag) & (F.col("district_id") != without))
    segment = lambda *names: F.count_if(F.col("c_mktsegment").isin(*names))
    population = t.customer.groupBy(F.col("c_nationkey").alias("district_id")).agg(F.count("*").alias("people"), segment("BUILDING", "MACHINERY").alias("youth"), segment("BUILDING", "FURNITURE").alias("youth_before"))
    schools = t.supplier.withColumnRenamed("s_nationkey", "district_id")
    kind = F.when(F.col("event_type") == "click", "bus").when(F.col("event_type") == "purchase", "rail").when(F.col("event_type") == "view", "bike")
    city = t.orders.agg(F.max("o_totalprice").alias("latest_wage"), F.lit(12.5).alias("talent_demand_yoy")).crossJoin(t.part.agg(F.count("*").alias("training_people")))
    made = opportunity.features(
        t.nation.select(k.alias("district_id"), F.col("n_name").alias("district_name"), F.when(k > 0, 100.0 + 7 * k).alias("area_km2")),
        population,
        ord_.select("district_id", positions, F.when(known, F.col("o_orderpriority")).alias("category")),
        ord_.select("district_id", positions, F.when(known, F.col("o_totalprice")).alias("salary")),
        of("A", 3).select("district_id", (F.col("l_extendedprice") / 100).alias("rent")),
        of("R", 4).select("district_id", F.col("l_extendedprice").alias("price")),
        schools.select("district_id", F.greatest("s_acctbal", F.lit(0.0)).alias("students")),
        schools.where("district_id <> 5").groupBy("district_id").agg(F.count("*").alias("courses")),
        t.events.select((F.col("user_id") % 25).alias("district_id"), kind.alias("kind")),
        city,
    )
    out = opportunity.index(made)
    return out.select("district_id", "district_name", *(r(F.col(c)).alias(c) for c in opportunity.COMPONENTS), *(r(F.col(c), 7).alias(c) for c in opportunity.FEATURES), r(F.col("opportunity_index")).alias("opportunity_index"), "risk", F.array_join("proxies", ",").alias("proxies"))
