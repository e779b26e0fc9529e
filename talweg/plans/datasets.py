"""The dataset transforms over landed tables that are made of whole standard tables.

A landed table is one list of SQL expressions, the same for both engines, that
turns rows into the strings a source would land: malformed months, unknown
districts, stand-ins for missing, repeats. The transforms' results are stated in
SQL of their own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.operators import transforms as X
from talweg.plans.base import query, r


class Landed:
    """Columns by name as SQL expressions over a table; STRING is each engine's name for text."""

    def __init__(self, table: str, **cols: str):
        self.table, self.cols = table, cols

    def frame(self, t):
        return getattr(t, self.table).selectExpr(*(f"{e} AS `{n}`" for n, e in self.cols.items()))

    @property
    def sql(self) -> str:
        return "(SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in self.cols.items()).replace("STRING", "VARCHAR") + f" FROM {self.table})"


def registry(t):
    """Districts and their two-digit codes."""
    return t.nation.select(F.col("n_nationkey").alias("district_id"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"))


AGES = range(18, 36)
MEN, WOMEN = ([f"people_age_{a:03d}_{s}" for a in AGES] for s in "mf")
VILLAGES = Landed(
    "customer",
    _ord="c_custkey",
    district_code="CASE WHEN c_custkey % 50 = 0 THEN 'X9' ELSE lpad(CAST(c_nationkey AS STRING), 2, '0') || '0' || CAST(c_custkey % 7 AS STRING) END",
    statistic_yyymm="CASE WHEN c_custkey % 40 = 1 THEN '11313' ELSE '113' || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') END",
    site_id="'S' || CAST(c_nationkey AS STRING)",
    village="'V' || CAST(c_custkey % 3 AS STRING)",
    people_total="CASE WHEN c_custkey % 301 = 0 THEN '-' ELSE CAST(1000 + c_custkey % 900 AS STRING) END",
    in_total="CAST(c_custkey % 31 AS STRING)",
    out_m="CAST(c_custkey % 17 AS STRING)",
    out_f="CASE WHEN c_custkey % 211 = 0 THEN 'x' ELSE CAST(c_custkey % 13 AS STRING) END",
    marry_pair="CASE WHEN c_custkey % 90 = 7 THEN '?' ELSE CAST(c_custkey % 11 AS STRING) END",
    **{c: f"CAST((c_custkey + {a}) % 9 AS STRING)" for a, c in zip(AGES, MEN)},
    **{c: f"CASE WHEN c_custkey % 97 = {a} THEN NULL ELSE CAST((2 * c_custkey + {a}) % 9 AS STRING) END" for a, c in zip(AGES, WOMEN)},
)
_SUM = lambda cols: " + ".join(f"try_cast({c} AS BIGINT)" for c in cols)
_WHOLE = lambda c: f"CASE WHEN count({c}) = count(*) THEN sum({c}) END::BIGINT"
MONTHS = f"""(SELECT *, CASE WHEN regexp_full_match(statistic_yyymm, '[0-9]{{3}}(0[1-9]|1[0-2])') THEN make_date(1911 + substr(statistic_yyymm, 1, 3)::INT, substr(statistic_yyymm, 4, 2)::INT, 1) END AS month,
try_cast(people_total AS BIGINT) AS total, {_SUM(MEN)} AS male, {_SUM(WOMEN)} AS female, CASE WHEN district_code NOT LIKE 'X%' THEN substr(district_code, 1, 2)::INT END AS district_id FROM {VILLAGES.sql})"""


@query(f"""WITH s AS (SELECT district_id, month, {_WHOLE("total")} AS population_total, {_WHOLE("male")} AS youth_male, {_WHOLE("female")} AS youth_female FROM {MONTHS} WHERE month IS NOT NULL AND district_id IS NOT NULL GROUP BY ALL)
SELECT district_id, strftime(month, '%Y-%m-%d') AS period_start, strftime(last_day(month), '%Y-%m-%d') AS period_end, unnest(['population_total', 'youth_male', 'youth_female', 'youth_total']) AS metric_id, unnest([population_total, youth_male, youth_female, youth_male + youth_female])::DOUBLE AS value FROM s""")
def t01_population(t):
    out = X.population(VILLAGES.frame(t), registry(t)).accepted
    return out.select("district_id", *(F.col(c).cast("string").alias(c) for c in ("period_start", "period_end")), "metric_id", "value")


@query(f"""WITH m AS (SELECT *, first_value(district_code || '|' || village) OVER (PARTITION BY site_id, statistic_yyymm ORDER BY _ord) AS first FROM {MONTHS})
SELECT site_id, strftime(month, '%Y-%m-%d') AS month_text, arg_min(village, _ord) AS village, {_WHOLE("total")} AS population_total, {_WHOLE("(male + female)")} AS youth_total FROM m WHERE month IS NOT NULL AND district_code || '|' || village = first GROUP BY site_id, month""")
def t02_population_villages(t):
    out = X.village_population(VILLAGES.frame(t)).accepted
    return out.select("site_id", F.col("month").cast("string").alias("month_text"), "village", "population_total", "youth_total")


@query(f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY site_id, month ORDER BY _ord) AS p FROM {MONTHS} WHERE month IS NOT NULL AND total IS NOT NULL)
SELECT strftime(month, '%Y-%m-%d') AS month_text, sum(total)::BIGINT AS population_total, {_WHOLE("(male + female)")} AS youth_total, count(*) AS villages, (SELECT count(*) FROM {MONTHS} WHERE month IS NULL OR total IS NULL) > 0 AS flagged FROM m WHERE p = 1 GROUP BY month""")
def t03_national_population(t):
    out = X.national_population(VILLAGES.frame(t)).accepted
    return out.select(F.col("month").cast("string").alias("month_text"), "population_total", "youth_total", "villages", (F.size("quality_flags") > 0).alias("flagged"))


@query(f"""SELECT district_id, strftime(month, '%Y-%m-%d') AS month_text, {_WHOLE("i")} AS moved_in, {_WHOLE("o")} AS moved_out, {_WHOLE("i")} - {_WHOLE("o")} AS net
FROM (SELECT *, try_cast(in_total AS BIGINT) AS i, try_cast(out_m AS BIGINT) + try_cast(out_f AS BIGINT) AS o FROM {MONTHS}) WHERE month IS NOT NULL AND district_id IS NOT NULL GROUP BY district_id, month""")
def t04_movement(t):
    out = X.movement(VILLAGES.frame(t), registry(t)).accepted
    return out.select("district_id", F.col("month").cast("string").alias("month_text"), "moved_in", "moved_out", "net")


BIRTHS = Landed(
    "orders",
    _ord="o_orderkey",
    site_id="'S' || CAST(o_custkey % 25 AS STRING)",
    statistic_yyy="CASE WHEN o_orderkey % 60 = 0 THEN '11x' ELSE '1' || CAST(10 + o_orderkey % 4 AS STRING) END",
    mother_age="CASE WHEN o_orderkey % 70 = 0 THEN 'n/a' ELSE CAST(14 + o_custkey % 30 AS STRING) || ' years' END",
    birth_sex="CASE WHEN o_orderkey % 3 = 0 THEN 'total' WHEN o_orderkey % 3 = 1 THEN 'm' ELSE 'f' END",
    birth_count="CASE WHEN o_orderkey % 80 = 0 THEN '-3' ELSE CAST(o_orderkey % 19 AS STRING) END",
)


@query(f"""WITH l AS (SELECT *, try_cast(nullif(regexp_extract(mother_age, '([0-9]+)', 1), '') AS INT) AS age, CASE WHEN regexp_full_match(statistic_yyy, '[0-9]{{2,3}}') THEN statistic_yyy::INT + 1911 END AS y, CASE WHEN regexp_full_match(birth_count, '[0-9]+') THEN birth_count::BIGINT END AS n, row_number() OVER (PARTITION BY site_id, statistic_yyy, mother_age, birth_sex ORDER BY _ord) AS p FROM {BIRTHS.sql}),
e AS (SELECT site_id, y, age, coalesce(max(n) FILTER (WHERE birth_sex = 'total'), sum(n) FILTER (WHERE birth_sex <> 'total')) AS n FROM l WHERE age BETWEEN 18 AND 35 AND y IS NOT NULL AND n IS NOT NULL AND p = 1 GROUP BY ALL)
SELECT site_id, y AS year, sum(n)::BIGINT AS births FROM e GROUP BY ALL""")
def t05_births(t):
    return X.births(BIRTHS.frame(t)).accepted.select("site_id", "year", "births")


@query(f"""SELECT site_id, year(month)::INT AS year, sum(n)::BIGINT AS pairs FROM (SELECT *, CASE WHEN regexp_full_match(marry_pair, '[0-9]+') THEN marry_pair::BIGINT END AS n, row_number() OVER (PARTITION BY statistic_yyymm, site_id, village ORDER BY _ord) AS p FROM {MONTHS}) WHERE month IS NOT NULL AND n IS NOT NULL AND p = 1 GROUP BY 1, 2""")
def t06_marriages(t):
    return X.marriages(VILLAGES.frame(t)).accepted.select("site_id", "year", "pairs")


PRICES = Landed(
    "lineitem",
    _ord="l_orderkey * 10 + l_linenumber",
    price="CASE WHEN l_orderkey % 15 = 0 THEN ' - ' ELSE CAST(CAST(floor(l_extendedprice) AS INT) AS STRING) END",
    area="CASE WHEN l_orderkey % 15 = 0 OR l_linenumber = 2 THEN 'N/A' ELSE CAST(CAST(floor(l_quantity) AS INT) AS STRING) || '.5' END",
    sold="CASE WHEN l_linenumber = 3 THEN '1130230' WHEN l_linenumber = 4 THEN '1130229' WHEN l_linenumber = 5 THEN '2024/2/9' ELSE '2024-01-31' END",
    low="CASE WHEN l_linenumber % 3 = 0 THEN '0' ELSE CAST(CAST(floor(l_quantity) AS INT) AS STRING) END",
    high="CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE CAST(CAST(floor(l_quantity) AS INT) * 2 AS STRING) END",
    scope="CASE WHEN l_linenumber = 6 THEN 'country' WHEN l_linenumber = 1 THEN 'county' ELSE 'district' END",
    people="CASE WHEN l_linenumber = 7 THEN 'many' ELSE CAST(l_linenumber AS STRING) END",
)


@query(f"""WITH p AS (SELECT _ord, try_cast(price AS DOUBLE) AS price, try_cast(area AS DOUBLE) AS area, CASE sold WHEN '1130230' THEN NULL WHEN '1130229' THEN '2024-02-29' WHEN '2024/2/9' THEN '2024-02-09' ELSE sold END AS sold FROM {PRICES.sql})
SELECT _ord, price, area, sold, sold IS NULL AS flagged FROM p WHERE price IS NOT NULL OR area IS NOT NULL""")
def t07_house_prices(t):
    out = X.priced(PRICES.frame(t), "house_prices", "sold", {"price": "TWD", "area": "sqm"}).accepted
    return out.select("_ord", "price", "area", F.col("sold").cast("string").alias("sold"), (F.size("quality_flags") > 0).alias("flagged"))


@query(f"""WITH p AS (SELECT *, try_cast(nullif(low, '0') AS DOUBLE) AS lo, try_cast(high AS DOUBLE) AS hi, try_cast(people AS BIGINT) AS n FROM {PRICES.sql})
SELECT _ord, CASE scope WHEN 'county' THEN 'city' ELSE scope END AS geo_level, n AS positions, coalesce((lo + hi) / 2, lo, hi) AS salary, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN 'midpoint' WHEN lo IS NOT NULL THEN 'lower_bound' WHEN hi IS NOT NULL THEN 'upper_bound' ELSE 'missing' END AS salary_estimate FROM p WHERE scope IN ('county', 'district') AND n IS NOT NULL""")
def t08_job_vacancies(t):
    landed = PRICES.frame(t).withColumnsRenamed({"low": "NT_L(lower)", "high": "NT_U（upper）", "scope": "geo_scope", "people": "JOB_PERSON"})
    return X.vacancies(landed).accepted.select("_ord", "geo_level", "positions", "salary", "salary_estimate")


WAGES = Landed(
    "part",
    _ord="p_partkey",
    method="CASE p_partkey % 3 WHEN 0 THEN 'mean' WHEN 1 THEN 'median' ELSE 'mode' END",
    wage="CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '4' || CAST(p_size AS STRING) || ',000' END",
    age="CASE WHEN p_partkey % 2 = 0 THEN '25-29' ELSE '30 ~ 34' END",
    year="CAST(100 + p_size AS STRING)",
)


@query(f"""SELECT _ord, CASE method WHEN 'mean' THEN 'wage_mean' ELSE 'wage_median' END AS metric_id, replace(wage, ',', '')::DOUBLE AS value, CASE WHEN age = '25-29' THEN 25 ELSE 30 END AS age_min, CASE WHEN age = '25-29' THEN 29 ELSE 34 END AS age_max, year::INT + 1911 AS period FROM {WAGES.sql} WHERE method <> 'mode' AND wage <> ''""")
def t09_wages(t):
    return X.wages(WAGES.frame(t), {"mean": "wage_mean", "median": "wage_median"}).accepted.select("_ord", "metric_id", "value", "age_min", "age_max", "period")


OVERVIEW = Landed("supplier", school_code="CAST(s_suppkey AS STRING)", major="CAST(s_suppkey % 7 AS STRING)", students="CAST(floor(s_acctbal) AS INT)")
DETAIL = Landed("lineitem", school_code="CAST(l_suppkey + 5 AS STRING)", major="CAST((l_suppkey + 5) % 7 AS STRING)", men="CASE WHEN l_linenumber = 7 AND l_suppkey % 4 = 0 THEN '-' ELSE CAST(l_linenumber AS STRING) END", women="CAST(l_linenumber + 1 AS STRING)")


@query(f"""WITH d AS (SELECT school_code, major, CASE WHEN count(try_cast(men AS BIGINT)) = count(*) THEN sum(try_cast(men AS BIGINT)) END::BIGINT AS men, sum(women::BIGINT)::BIGINT AS women FROM (SELECT DISTINCT * FROM {DETAIL.sql}) GROUP BY 1, 2)
SELECT coalesce(o.school_code, d.school_code) AS school_code, coalesce(o.major, d.major) AS major, students, men, women, CASE WHEN d.school_code IS NULL THEN 'detail_missing' WHEN o.school_code IS NULL THEN 'overview_missing' ELSE 'matched' END AS match, s_nationkey AS district_id
FROM {OVERVIEW.sql} o FULL JOIN d ON o.school_code = d.school_code AND o.major = d.major LEFT JOIN supplier ON s_suppkey::VARCHAR = coalesce(o.school_code, d.school_code)""")
def t10_college_majors(t):
    places = t.supplier.select(F.col("s_suppkey").cast("string").alias("school_code"), F.col("s_nationkey").alias("district_id"))
    return X.majors(OVERVIEW.frame(t), DETAIL.frame(t), places, ["school_code", "major"], ["men", "women"]).select("school_code", "major", "students", "men", "women", "match", "district_id")


GRADUATES = Landed("part", _ord="p_partkey", school_year="CASE WHEN p_partkey % 13 = 0 THEN '年' ELSE CAST(100 + p_size % 20 AS STRING) END", graduates_male="CASE WHEN p_partkey % 5 = 0 THEN '-' WHEN p_partkey % 17 = 0 THEN 'ten' ELSE CAST(p_size AS STRING) END", graduates_female="CAST(p_partkey % 50 AS STRING)")


@query(f"""SELECT _ord, strftime(make_date(y, 8, 1), '%Y-%m-%d') AS period_start, strftime(make_date(y + 1, 7, 31), '%Y-%m-%d') AS period_end, try_cast(graduates_male AS BIGINT) + graduates_female::BIGINT AS graduates FROM (SELECT *, try_cast(school_year AS INT) + 1911 AS y FROM {GRADUATES.sql}) WHERE y IS NOT NULL AND graduates_male <> 'ten'""")
def t11_graduate_majors(t):
    out = X.graduates(GRADUATES.frame(t)).accepted
    return out.select("_ord", *(F.col(c).cast("string").alias(c) for c in ("period_start", "period_end")), "graduates")


@query("SELECT o_custkey % 25 AS district_id, count(DISTINCT o_orderkey % 997) AS courses, array_to_string(list_sort(list(DISTINCT o_orderkey % 997)), ',') AS ids FROM orders GROUP BY 1")
def t12_vt_courses(t):
    out = X.courses(t.orders.select((F.col("o_custkey") % 25).alias("district_id"), (F.col("o_orderkey") % 997).alias("course_id")))
    return out.select("district_id", "courses", F.array_join("ids", ",").alias("ids"))


TRAINING = Landed(
    "orders",
    _ord="o_orderkey",
    county="CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE ' C' || CAST(o_custkey % 25 AS STRING) END",
    people="CASE WHEN o_orderkey % 31 = 0 THEN '1.5' ELSE CAST(o_orderkey % 40 AS STRING) END",
    hours="CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE CAST(o_orderkey % 60 AS STRING) || '.25' END",
    fee="CAST(o_orderkey % 9000 AS STRING)",
    opened="'2024/03/0' || CAST(1 + o_orderkey % 9 AS STRING)",
    closed="CASE WHEN o_orderkey % 53 = 0 THEN '2024-13-01' WHEN o_orderkey % 8 = 0 THEN '' ELSE '20240415' END",
    period="CASE WHEN o_orderkey % 29 = 0 THEN '本年' ELSE CAST(105 + o_orderkey % 9 AS STRING) || '年' END",
    new_demand="CAST(o_orderkey % 100 AS STRING)",
    new_hired="CASE WHEN o_orderkey % 37 = 0 THEN '-1' ELSE CAST(o_orderkey % 20 AS STRING) END",
    valid_hired="CASE WHEN o_orderkey % 6 = 0 THEN '—' ELSE CAST(o_orderkey % 10 AS STRING) END",
)


@query(f"""SELECT _ord, nullif(trim(county), '') AS county_name, people::BIGINT AS training_people, try_cast(hours AS DOUBLE) AS training_hours, fee::DOUBLE AS fee_per_person, replace(opened, '/', '-') AS period_start, CASE WHEN closed <> '' THEN '2024-04-15' END AS period_end FROM {TRAINING.sql} WHERE people <> '1.5' AND closed <> '2024-13-01'""")
def t13_training_numbers(t):
    out = X.trainings(TRAINING.frame(t)).accepted
    return out.select("_ord", "county_name", "training_people", "training_hours", "fee_per_person", *(F.col(c).cast("string").alias(c) for c in ("period_start", "period_end")))


@query(f"""SELECT year, count(*) AS n, sum(new_demand::BIGINT)::BIGINT AS new_demand, sum(new_hired::BIGINT)::BIGINT AS new_hired, sum(try_cast(valid_hired AS BIGINT))::BIGINT AS valid_hired FROM (SELECT *, try_cast(replace(period, '年', '') AS INT) + 1911 AS year FROM {TRAINING.sql}) WHERE year IS NOT NULL AND new_hired <> '-1' GROUP BY 1""")
def t13_talent_demand(t):
    out = X.talent_demand(TRAINING.frame(t)).accepted
    return out.groupBy("year").agg(F.count("*").alias("n"), *(F.sum(f"{c}_count").alias(c) for c in ("new_demand", "new_hired", "valid_hired")))


STOPS = Landed("customer", _ord="c_custkey", lon="CASE WHEN c_custkey % 19 = 0 THEN 'east' WHEN c_custkey % 23 = 0 THEN '200' ELSE CAST(c_custkey * 7 % 100 AS STRING) || '.5' END", lat="CAST(c_custkey * 13 % 90 AS STRING) || '.25'")
#: Two boxes that overlap between x = 40 and x = 60.
BOXES = [(0, 0.0, 60.0, 80.0), (1, 40.0, 100.0, 80.0)]


@query(f"""WITH p AS (SELECT _ord, try_cast(lon AS DOUBLE) AS x, lat::DOUBLE AS y FROM {STOPS.sql}) SELECT _ord, CASE WHEN y <= 80 AND x < 40 THEN 0 WHEN y <= 80 AND x > 60 THEN 1 END AS district_id FROM p WHERE x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90""")
def t14_stops(t):
    ring = lambda a, b, h: [[(a, 0.0), (b, 0.0), (b, h), (a, h)]]
    areas = t.region.sparkSession.createDataFrame([(k, ring(a, b, h)) for k, a, b, h in BOXES], "district_id int, rings array<array<struct<x:double,y:double>>>")
    return X.stops(STOPS.frame(t), areas).accepted.select("_ord", "district_id")


POINTS = Landed("customer", point_id="'p' || CAST(c_custkey AS STRING)", longitude="CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '121.5' END", latitude="CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '25.' || CAST(c_custkey % 10 AS STRING) END", geocode_status="CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'matched' END")
OVERRIDES = Landed("supplier", _ord="s_suppkey", point_id="'p' || CAST(s_suppkey * 6 % 50 AS STRING)", longitude="121.0 + CAST(s_suppkey % 8 AS DOUBLE) / 8", latitude="24.5")


@query(f"""WITH o AS (SELECT point_id, arg_max(longitude, _ord) AS lon, arg_max(latitude, _ord) AS lat FROM {OVERRIDES.sql} GROUP BY 1)
SELECT point_id, CASE WHEN coalesce(o.lon, try_cast(p.longitude AS DOUBLE)) IS NOT NULL AND (o.lon IS NOT NULL OR geocode_status = 'matched') THEN 'matched' ELSE 'excluded_no_verified_coordinate' END AS geocode_status, coalesce(o.lon, try_cast(p.longitude AS DOUBLE))::DOUBLE AS longitude, coalesce(o.lat, try_cast(p.latitude AS DOUBLE))::DOUBLE AS latitude FROM {POINTS.sql} p LEFT JOIN o USING (point_id)""")
def t15_service_points(t):
    return X.service_points(POINTS.frame(t), OVERRIDES.frame(t)).select("point_id", "geocode_status", "longitude", "latitude")


CANDIDATES = Landed(
    "customer",
    _ord="c_custkey",
    election_type="CASE WHEN c_custkey % 2 = 0 THEN 'V1' ELSE 'T1' END",
    district_id="CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END",
    mark="CASE WHEN c_custkey % 6 = 0 THEN '*' ELSE NULL END",
    held="CASE WHEN c_custkey % 5 = 0 THEN 'Y' ELSE 'N' END",
    birth="CASE WHEN c_custkey % 7 = 0 THEN 'unknown' WHEN c_custkey % 7 = 1 THEN '0' || CAST(60 + c_custkey % 30 AS STRING) || '0715' ELSE '19' || CAST(60 + c_custkey % 40 AS STRING) || '-12-01' END",
    age="CASE WHEN c_custkey % 14 = 0 THEN '44' ELSE NULL END",
    election_date="CASE WHEN c_custkey % 33 = 0 THEN '' ELSE '2022/11/26' END",
)


@query(f"""SELECT _ord, coalesce(mark = '*', false) AS elected, held = 'Y' AS incumbent, CASE WHEN birth = 'unknown' THEN age::INT WHEN birth LIKE '0%' THEN 2022 - (1911 + substr(birth, 1, 3)::INT) ELSE 2021 - substr(birth, 1, 4)::INT END AS age, birth = 'unknown' AS warned FROM {CANDIDATES.sql} WHERE NOT (election_type = 'V1' AND district_id IS NULL) AND election_date <> ''""")
def t16_elections(t):
    return X.candidates(CANDIDATES.frame(t)).accepted.select("_ord", "elected", "incumbent", "age", (F.size("warnings") > 0).alias("warned"))


SHAPES = Landed("orders", _ord="o_orderkey", code="CASE WHEN o_custkey % 5 = 0 THEN '10' ELSE '65' END || CAST(o_custkey AS STRING)", type="CASE WHEN o_orderkey % 12 = 0 THEN 'Point' WHEN o_orderkey % 2 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END")


@query(f"""SELECT code, _ord, type FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY _ord) AS p FROM {SHAPES.sql}) WHERE p = 1 AND code LIKE '65%' AND type <> 'Point'""")
def t17_village_boundaries(t):
    return X.boundaries(SHAPES.frame(t), ["65"]).accepted.select("code", "_ord", "type")


BUDGETS = Landed(
    "orders",
    _ord="o_orderkey",
    row_type="CASE o_orderkey % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'allocation' ELSE 'total' END",
    unit_label="CASE WHEN o_orderkey % 41 = 0 THEN '億' WHEN o_orderkey % 2 = 0 THEN '千元' ELSE '元' END",
    budget_year_roc="CASE WHEN o_orderkey % 43 = 0 THEN '113年' ELSE CAST(110 + o_orderkey % 5 AS STRING) END",
    budget_amount="CAST(o_orderkey % 1000 AS STRING) || ',000'",
    work_plan="CASE WHEN o_custkey % 8 = 0 THEN '無' ELSE 'w' END",
    allocation_code="'0' || CAST(o_custkey % 6 AS STRING)",
    surplus_amount="CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN '(5)' WHEN o_orderkey % 4 = 0 THEN '-1,200' ELSE '+30' END",
)


@query(f"""WITH b AS (SELECT *, CASE unit_label WHEN '千元' THEN 1000.0 WHEN '元' THEN 1.0 END AS f FROM {BUDGETS.sql})
SELECT _ord, budget_year_roc::INT + 1911 AS year, (replace(budget_amount, ',', '')::DOUBLE * f)::DOUBLE AS amount, (replace(surplus_amount, ',', '')::DOUBLE * f)::DOUBLE AS surplus FROM b
WHERE budget_year_roc <> '113年' AND f IS NOT NULL AND NOT (row_type = 'plan' AND work_plan = '無') AND NOT (row_type = 'allocation' AND allocation_code NOT IN ('01', '02', '03', '04')) AND coalesce(surplus_amount, '') <> '(5)'""")
def t18_youth_budgets(t):
    return X.budgets(BUDGETS.frame(t)).accepted.select("_ord", "year", "amount", "surplus")


GRANTS = Landed(
    "orders",
    _ord="o_orderkey",
    project_location="CASE WHEN o_orderkey % 3 = 0 THEN 'at NATION_1, hall' ELSE NULL END",
    recipient_address="CASE WHEN o_orderkey % 2 = 0 THEN 'NATION_2 road' ELSE 'abroad' END",
    recipient_name="CASE WHEN o_orderkey % 5 = 0 THEN 'club of NATION_3' ELSE '' END",
    year_roc="CAST(110 + o_orderkey % 4 AS STRING)",
    coverage_end_month="CAST(o_orderkey % 14 AS INT)",
)


@query(f"""SELECT _ord, CASE WHEN project_location IS NOT NULL THEN 'NATION_1' WHEN recipient_address LIKE 'N%' THEN 'NATION_2' WHEN recipient_name <> '' THEN 'NATION_3' END AS district_name, CASE WHEN project_location IS NOT NULL THEN 'project_location' WHEN recipient_address LIKE 'N%' THEN 'recipient_address' WHEN recipient_name <> '' THEN 'recipient_name' END AS geo_basis,
strftime(CASE WHEN coverage_end_month BETWEEN 1 AND 12 THEN last_day(make_date(year_roc::INT + 1911, coverage_end_month, 1)) END, '%Y-%m-%d') AS period_end, CASE WHEN coverage_end_month = 12 THEN 'full_year' WHEN coverage_end_month BETWEEN 1 AND 11 THEN 'year_to_date' END AS coverage_scope FROM {GRANTS.sql}""")
def t19_youth_grants(t):
    out = X.grants(GRANTS.frame(t), ["NATION_1", "NATION_2", "NATION_3"])
    return out.select("_ord", "district_name", "geo_basis", F.col("period_end").cast("string").alias("period_end"), "coverage_scope")


PROPOSALS = Landed(
    "documents",
    _ord="doc_id",
    proposal_id="CASE WHEN doc_id % 21 = 0 THEN ' ' ELSE 'P' || CAST(doc_id AS STRING) END",
    title="lang",
    content="text",
    category="source",
    agency="CASE WHEN doc_id % 4 = 0 THEN 'youth office' ELSE NULL END",
    submitted_at="CASE WHEN doc_id % 25 = 0 THEN 'soon' WHEN doc_id % 3 = 0 THEN '112年5月' WHEN doc_id % 3 = 1 THEN '1130401' ELSE '2023-09-08' END",
    endorsement_count="CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 1200 AS STRING) END",
)


@query(f"""SELECT proposal_id, CASE WHEN submitted_at LIKE '113%' THEN 2024 ELSE 2023 END AS year, coalesce(endorsement_count, '0')::BIGINT AS endorsements, CASE WHEN agency IS NOT NULL THEN 'agency:youth;' ELSE '' END || CASE WHEN contains(title || ' ' || coalesce(content, '') || ' ' || coalesce(category, ''), 'the') THEN 'keyword:the;' ELSE '' END || CASE WHEN contains(title || ' ' || coalesce(content, '') || ' ' || coalesce(category, ''), 'und') THEN 'keyword:und;' ELSE '' END AS reasons FROM {PROPOSALS.sql} WHERE trim(proposal_id) <> '' AND submitted_at <> 'soon'""")
def t20_join_proposals(t):
    out = X.proposals(PROPOSALS.frame(t), ["youth"], ["the", "und"]).accepted
    return out.select("proposal_id", "year", "endorsements", F.array_join(F.transform("proxy_reasons", lambda x: F.concat(x, F.lit(";"))), "").alias("reasons"))


MINUTES_SQL = """WITH m AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id AS meeting_id, s AS section, ((s = 'second')::INT * n + i)::BIGINT AS item, 'item ' || i AS title, 'talk ' || i AS body, CASE WHEN i % 2 = 1 THEN '決議:列管 ' || i ELSE '' END AS resolution, i % 2 = 0 AS needs_review, i % 2 = 1 AS escalated
FROM m, (VALUES ('first'), ('second')) v(s), unnest(range(1, m.n + 1)) u(i)"""


def meetings(t):
    """Every conversation is a meeting with as many items in each of two sections as it has turns."""
    n = t.conversations.groupBy(F.col("conv_id").alias("meeting_id")).agg(F.count("*").alias("n"))
    line = lambda i: F.concat(F.lit("一、item "), i, F.lit("\ntalk "), i, F.when(i % 2 == 1, F.concat(F.lit("\n決議:列管 "), i)).otherwise(F.lit("")))
    items = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), line), "\n")
    return n.select("meeting_id", F.array(F.concat(F.lit("壹、first\n"), items), F.concat(F.lit("貳、second\n"), items)).alias("page_texts"))


@query(MINUTES_SQL)
def t21_council_minutes(t):
    return X.minutes_items(meetings(t)).select("meeting_id", "section", "item", "title", "body", "resolution", "needs_review", "escalated")


@query(MINUTES_SQL)
def x05_minutes_by_table_function(t):
    """The same rows from SQL: a table function over each meeting's lines in order."""
    from talweg.functions import sql

    spark = t.region.sparkSession
    sql.register(spark)
    lines = meetings(t).select(F.col("meeting_id").cast("string").alias("meeting_id"), F.posexplode(F.split(F.array_join("page_texts", "\n"), "\n")).alias("n", "line"))
    out = spark.sql("SELECT * FROM minutes_items(TABLE({lines}) PARTITION BY meeting_id ORDER BY n)", lines=lines)
    kind = dict(t.conversations.dtypes)["conv_id"]
    return out.withColumn("meeting_id", F.col("meeting_id").cast(kind))


@query(f"""WITH a AS (SELECT 'population' AS dataset, CASE WHEN month IS NULL THEN 'invalid_period' WHEN district_id IS NULL THEN 'unmapped_district' END AS reason FROM {MONTHS} UNION ALL
SELECT 'youth_budgets', CASE WHEN budget_year_roc = '113年' THEN 'invalid_year' WHEN unit_label = '億' THEN 'unknown_unit' WHEN row_type = 'plan' AND work_plan = '無' THEN 'missing_plan' WHEN row_type = 'allocation' AND allocation_code NOT IN ('01', '02', '03', '04') THEN 'missing_code' WHEN surplus_amount = '(5)' THEN 'invalid_surplus' END FROM {BUDGETS.sql} UNION ALL
SELECT 'training_numbers', CASE WHEN people = '1.5' THEN 'invalid_value' WHEN closed = '2024-13-01' THEN 'invalid_date' END FROM {TRAINING.sql})
SELECT dataset, reason AS reject_reason, count(*) AS n FROM a WHERE reason IS NOT NULL GROUP BY 1, 2""")
def t23_quarantine_reasons(t):
    """What the transforms reject, by their first reason."""
    from talweg.operators.sets import union_all

    parts = {"population": X.population(VILLAGES.frame(t), registry(t)), "youth_budgets": X.budgets(BUDGETS.frame(t)), "training_numbers": X.trainings(TRAINING.frame(t))}
    rows = union_all([p.quarantine.select(F.lit(name).alias("dataset"), "reject_reason") for name, p in parts.items()])
    return rows.groupBy("dataset", "reject_reason").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT _ord, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_extendedprice END AS stated, l_extendedprice AS total, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE l_quantity END AS area FROM (SELECT *, l_orderkey * 10 + l_linenumber AS _ord FROM lineitem))
SELECT _ord, round(coalesce(stated, CASE WHEN area > 0 THEN total / area END), 9) AS rent, CASE WHEN stated IS NOT NULL THEN 'source' WHEN area > 0 THEN 'derived' ELSE 'missing' END AS basis FROM p""")
def f19_rent_per_sqm(t):
    """A stated figure, else one derived, with where it comes from."""
    line = F.col("l_linenumber")
    value, basis = X.rent_per_sqm(F.when(line % 4 != 0, F.col("l_extendedprice")), F.col("l_extendedprice"), F.when(line % 5 == 0, 0).otherwise(F.col("l_quantity")))
    return t.lineitem.select((F.col("l_orderkey") * 10 + line).alias("_ord"), r(value, 9).alias("rent"), basis.alias("basis"))
