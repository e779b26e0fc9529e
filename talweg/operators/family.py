"""The fertility page: three components of family friendliness, levels, a scatter with its line, and statuses that merge; trends that need every district."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions import nulls as N
from talweg.operators import series, stats

#: Components and their weights; what is wrong with the index.
WEIGHTS = {"daycare": 1 / 3, "housing": 1 / 3, "salary": 1 / 3}
MISSING, PARTIAL_DAYCARE = "fafi_component_missing", "daycare_coverage_partial"


def row_status(complete: Column, *values: Column) -> Column:
    """observed with all values of a complete period, unavailable with none, else partial."""
    there = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.when(there == 0, "unavailable").when((there == len(values)) & F.coalesce(complete, F.lit(False)), "observed").otherwise("partial")


def page(districts: DataFrame, annual: DataFrame, daycare: DataFrame, index: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """A row a district and one for the city (district_id null).

    ``districts``: district_id, district_name, all that are expected; ``annual``:
    district_id, fertility_rate, youth_ratio, complete; ``daycare``: as
    ``service.coverage`` gives it; ``index``: district_id, opportunity_index,
    housing, salary. The index of family friendliness is the weighted mean of
    daycare and salary (each 0 to 100 over the districts) and housing, where all
    three are there; levels are its quartiles. The city's row has the statuses of
    the year, of daycare and of the index, what they merge to, why, and the line of
    fertility on opportunity.
    """
    all_ = Window.partitionBy()  # the districts, a small dimension
    d = districts.select("district_id", "district_name").join(annual, "district_id", "left").join(daycare.where("district_id IS NOT NULL").select("district_id", F.col("value").alias("daycare")), "district_id", "left").join(index, "district_id", "left")
    d = d.withColumn("status", row_status(F.col("complete"), F.col("fertility_rate"), F.col("youth_ratio")))
    z = stats.minmax(d, {"daycare_score": ("daycare", False), "salary_score": ("salary", False)}, dimension=True)
    parts = {"daycare": F.col("daycare_score"), "housing": F.col("housing"), "salary": F.col("salary_score")}
    z = z.withColumn("fafi", N.weighted_complete([(parts[k], w) for k, w in weights.items()]))
    for score, level in (("fafi", "fafi_level"), ("fertility_rate", "fertility_level")):
        z = stats.quartile_level(z, score, level, dimension=True, names=("low", "high"))
    line = stats.ols(F.col("fertility_rate"), F.col("opportunity_index"))
    have = F.count("fafi")
    city = z.agg(
        N.merged_status(F.col("status")).alias("annual_status"),
        F.when(have == 0, "unavailable").when(have < F.count("*"), "partial").otherwise("observed").alias("fafi_status"),
        *(line[k].alias(k) for k in ("n", "slope", "intercept", "r2")),
    )
    care = daycare.where("district_id IS NULL").select(F.col("status").alias("daycare_status"), F.col("value").alias("daycare"))
    city = city.crossJoin(F.broadcast(care))
    merged = lambda *names: F.when(F.forall(F.array(*names), lambda s: s == "unavailable"), "unavailable").when(F.exists(F.array(*names), lambda s: s != "observed"), "partial").otherwise("observed")
    reasons = F.array_compact(F.array(F.when(F.col("daycare_status") != "observed", PARTIAL_DAYCARE), F.when(F.col("fafi_status") != "observed", MISSING)))
    city = city.withColumns({"reasons": reasons, "fafi_status": F.when(F.col("daycare_status") == "observed", F.col("fafi_status")).otherwise(merged("fafi_status", "daycare_status"))})
    city = city.withColumn("status", merged("annual_status", "daycare_status", "fafi_status"))
    kept = ["district_id", "district_name", "fertility_rate", "youth_ratio", "opportunity_index", "daycare", "daycare_score", "housing", "salary_score", "fafi", "fafi_level", "fertility_level", "status"]
    return z.select(*kept).unionByName(city.drop("annual_status"), allowMissingColumns=True)


def monthly_trend(records: DataFrame, years: list[int], expected: DataFrame, month: int = 7) -> DataFrame:
    """(year, value, yoy, districts) of each year asked for: the total of one month, only if every expected district has a value then.

    ``records``: district_id, year, month, value, _ord (of several the last counts);
    ``expected``: district_id. The change is on the year just before, if that is whole, too.
    """
    wanted = expected.where("district_id IS NOT NULL").select("district_id").distinct()
    rows = records.where((F.col("month") == month) & F.col("year").isin(*years) & N.finite(F.col("value")).isNotNull())
    one = rows.groupBy("year", "district_id").agg(F.max_by(F.col("value").cast("double"), "_ord").alias("v")).join(wanted, "district_id", "left_semi")
    sums = one.groupBy("year").agg(F.sum("v").alias("v"), F.count("*").alias("districts"))
    grid = records.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, years))).alias("year")).join(sums, "year", "left").crossJoin(F.broadcast(wanted.agg(F.count("*").alias("want"))))
    whole = grid.select("year", F.when((F.col("districts") == F.col("want")) & (F.col("want") > 0), F.col("v")).alias("value"), F.coalesce("districts", F.lit(0)).alias("districts"), F.lit(0).alias("g"))
    return series.change_by_join(whole, ["g"], "year", "value").select("year", "value", "yoy", "districts")
