"""The opportunity index: nineteen features of a district, five weighted components, one index, a risk level.

Inputs are narrow tables by ``district_id``; rows without a district count for
the city alone. Each input is aggregated once and the districts, a small
dimension, collect the features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions import nulls as N
from talweg.operators import stats
from talweg.sources import scratch

#: Features (whether less is better), components with their features' weights, the components' weights.
FEATURES = {
    "youth_ratio": False, "youth_yoy": False, "vacancies_per_10k_youth": False, "vacancies_per_km2": False, "occupation_entropy": False,
    "talent_demand_yoy": False, "salary_median": False, "salary_median_shrunk": False, "high_salary_ratio": False, "adjusted_youth_wage": False,
    "college_student_density": False, "course_count": False, "training_per_10k_youth": False, "rent_median": True, "house_price_median": True,
    "rent_wage_ratio": True, "bus_per_10k_youth": False, "rail_density": False, "bike_density": False,
}
COMPONENTS = {
    "job": {"vacancies_per_km2": 0.6, "occupation_entropy": 0.4},
    "salary": {"salary_median_shrunk": 0.6, "high_salary_ratio": 0.4},
    "talent": {"youth_ratio": 0.4, "youth_yoy": 0.4, "college_student_density": 0.2},
    "housing": {"rent_median": 0.35, "house_price_median": 0.35, "rent_wage_ratio": 0.3},
    "transport": {"bus_per_10k_youth": 0.35, "rail_density": 0.4, "bike_density": 0.25},
}
WEIGHTS = {"job": 0.25, "salary": 0.25, "talent": 0.15, "housing": 0.2, "transport": 0.15}
#: Units of evidence at which a district's median salary and the city's weigh alike; a high salary, in city medians; courses where none are observed.
SHRINKAGE, HIGH, COURSES = 30.0, 1.5, 32.0


def named(df: DataFrame, *names: str) -> DataFrame:
    """(district_id, name, value) of the columns."""
    return df.select("district_id", *(F.col(n).cast("double").alias(n) for n in names)).unpivot(["district_id"], list(names), "name", "value")


def pivoted(long: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """A column for each name: one grouping of narrow rows in place of a join for each input."""
    return long.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))


def narrow(inputs: dict[str, tuple[DataFrame, str, str | None]]) -> DataFrame:
    """(kind, district_id, v, weight) of each input's values, written once: percentiles and what they decide read these alone."""
    rows = None
    for kind, (df, value, weight) in inputs.items():
        part = df.select(F.lit(kind).alias("kind"), "district_id", F.col(value).cast("double").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("weight"))
        rows = part if rows is None else rows.unionByName(part)
    return scratch.kept(rows, "narrow")


def middles(rows: DataFrame) -> DataFrame:
    """(kind, district_id, city, middle, least, n) of the values, by district and (``city``) for all, in the same two passes."""
    both = F.array(F.struct(F.col("district_id").alias("d"), F.lit(False).alias("city")), F.struct(F.lit(None).alias("d"), F.lit(True).alias("city")))
    return scratch.kept(stats.percentiles(rows.select("kind", "v", F.explode(both).alias("g")).select("kind", "v", F.col("g.d").alias("district_id"), "g.city"), ["kind", "district_id", "city"], F.col("v"), {"middle": 0.5, "least": 0.0}, "n"), "middles")


def features(districts: DataFrame, population: DataFrame, vacancies: DataFrame, salaries: DataFrame, rents: DataFrame, houses: DataFrame, students: DataFrame, courses: DataFrame, stops: DataFrame, city: DataFrame) -> DataFrame:
    """One row a district with the columns of ``FEATURES`` and proxies (what had to stand in).

    districts: district_name, area_km2; population: youth, people, youth_before
    (one row a district); vacancies: positions, category; salaries: positions,
    salary; rents: rent; houses: price, residential sales only; students:
    students; courses: courses (one row a district); stops: kind (bus, rail,
    bike); city: one row of latest_wage, talent_demand_yoy, training_people.
    """
    values = narrow({"salary": (salaries, "salary", "positions"), "rent": (rents, "rent", None), "house": (houses, "price", None)})
    found = middles(values)
    own = found.where("NOT city")
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, F.col(value)))
    whole = found.where("city").agg(of("salary", "middle").alias("salary_median_city"), of("house", "middle").alias("house_own_city"), of("rent", "least").alias("least_rent"))
    high = values.where("kind = 'salary'").crossJoin(F.broadcast(whole)).where(F.col("v") > HIGH * F.col("salary_median_city")).groupBy("district_id").agg(F.sum("weight").alias("high_positions"))
    n = vacancies.groupBy("district_id", F.coalesce(F.col("category"), F.lit("unknown")).alias("c")).agg(F.sum(F.coalesce("positions", F.lit(0))).cast("double").alias("n")).where("n > 0")
    jobs = n.groupBy("district_id").agg(F.sum("n").alias("positions"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("occupation_entropy"))
    parts = [
        named(population, "youth", "people", "youth_before"),
        named(jobs, "positions", "occupation_entropy"),
        named(high, "high_positions"),
        own.select("district_id", F.concat("kind", F.lit("_own")).alias("name"), F.col("middle").alias("value")),
        own.where("kind = 'salary'").select("district_id", F.lit("salary_n").alias("name"), F.col("n").cast("double").alias("value")),
        named(students.groupBy("district_id").agg(F.sum("students").alias("students")), "students"),
        named(courses, "courses"),
        stops.where("kind IS NOT NULL").groupBy("district_id", F.col("kind").alias("name")).agg(F.count("*").cast("double").alias("value")),
    ]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    names = ["youth", "people", "youth_before", "positions", "occupation_entropy", "high_positions", "salary_own", "rent_own", "house_own", "salary_n", "students", "courses", "bus", "rail", "bike"]
    all_ = Window.partitionBy()  # the districts, a small dimension
    d = districts.join(pivoted(long, names, "district_id"), "district_id", "left").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(city))
    d = d.withColumns({"salary_median": F.col("salary_own"), "cheapest": F.min("house_own").over(all_), "least_courses": F.min("courses").over(all_), "city_youth": F.sum("youth").over(all_)})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per_youth = lambda c: N.ratio(c, F.col("youth")) * 10000
    per_area = lambda c: N.ratio(c, F.col("area_km2"))
    rent_median, house_median = F.coalesce("rent_own", "least_rent"), F.coalesce("house_own", "cheapest")
    proxies = F.filter(F.array(F.when(F.col("rent_own").isNull(), "rent"), F.when(F.col("house_own").isNull(), "house_price"), F.when(F.col("courses").isNull(), "courses")), lambda x: x.isNotNull())
    made: dict[str, Column] = {
        "youth_ratio": N.ratio(F.col("youth"), F.col("people")) * 100,
        "youth_yoy": N.yoy(F.col("youth"), F.col("youth_before")),
        "vacancies_per_10k_youth": per_youth(zero("positions")),
        "vacancies_per_km2": per_area(zero("positions")),
        "occupation_entropy": F.coalesce("occupation_entropy", F.lit(0.0)),
        "talent_demand_yoy": F.col("talent_demand_yoy"),
        "salary_median": F.col("salary_median"),
        "salary_median_shrunk": F.when(F.col("salary_median_city").isNull(), F.col("salary_median")).otherwise(stats.shrunk(F.col("salary_median"), zero("salary_n"), F.col("salary_median_city"), SHRINKAGE)),
        "high_salary_ratio": N.ratio(zero("high_positions"), F.when(F.col("positions") > 0, F.col("positions"))),
        "adjusted_youth_wage": F.col("latest_wage") * N.ratio(house_median, F.col("house_own_city")),
        "college_student_density": per_area(zero("students")),
        "course_count": F.coalesce(F.col("courses").cast("double"), "least_courses", F.lit(COURSES)),
        "training_per_10k_youth": N.ratio(F.col("training_people"), F.when(F.col("city_youth") > 0, F.col("city_youth"))) * 10000,
        "rent_median": rent_median,
        "house_price_median": house_median,
        "rent_wage_ratio": N.ratio(rent_median, F.col("salary_median")),
        "bus_per_10k_youth": per_youth(zero("bus")),
        "rail_density": per_area(zero("rail")),
        "bike_density": per_area(zero("bike")),
    }
    return d.select("district_id", "district_name", *(c.cast("double").alias(n) for n, c in made.items()), proxies.alias("proxies"))


def index(made: DataFrame) -> DataFrame:
    """Features to components, index (0 to 100) and risk: low quarters of the index are at high risk."""
    z = stats.minmax(made, {f"z_{c}": (c, inverse) for c, inverse in FEATURES.items()}, dimension=True)
    z = z.withColumns({name: N.weighted_available([(F.col(f"z_{c}"), w) for c, w in parts.items()]) for name, parts in COMPONENTS.items()})
    z = z.withColumn("raw_index", N.weighted_available([(F.col(c), w) for c, w in WEIGHTS.items()]))
    i = stats.minmax(z, {"opportunity_index": ("raw_index", False)}, dimension=True).withColumn("opportunity_index", F.round("opportunity_index", 6))
    out = stats.quartile_level(i, "opportunity_index", "risk", dimension=True).withColumn("risk", F.coalesce("risk", F.lit("unavailable")))
    return out.withColumn("status", F.when(F.col("opportunity_index").isNull(), "unavailable").otherwise("observed"))
