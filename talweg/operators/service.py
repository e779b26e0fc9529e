"""Service coverage: what share of a population lives within a distance of a verified service point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions import nulls as N
from talweg.operators import overlay, series
from talweg.sources import scratch

# Why coverage is not known, or not whole.
REASONS = ["incomplete_village_population_coverage", "no_boundary_population_join", "no_verified_service_points", "village_boundaries_not_published", "village_population_not_published"]
#: Degrees that a longitude and a latitude may have.
LON, LAT = 180, 90


def verified(points: DataFrame, project) -> DataFrame:
    """``points`` with x and y in metres and whether they count: matched, and placed by plane coordinates, else by degrees through ``project``.

    ``points``: status, px, py (plane) and lon, lat.
    """
    plane = N.finite(F.col("px")).isNotNull() & N.finite(F.col("py")).isNotNull()
    degrees = N.finite(F.col("lon")).between(-LON, LON) & N.finite(F.col("lat")).between(-LAT, LAT)
    x, y = project(F.col("lon"), F.col("lat"))
    pick = lambda own, other: F.when(plane, own.cast("double")).when(F.coalesce(degrees, F.lit(False)), other)
    placed = points.withColumns({"x": pick(F.col("px"), x), "y": pick(F.col("py"), y)})
    return placed.withColumn("counts", F.coalesce((F.col("status") == "matched") & F.col("x").isNotNull() & F.col("y").isNotNull(), F.lit(False)))


def latest_population(population: DataFrame) -> DataFrame:
    """One row a village: that of the latest period, of several the last landed. ``population``: village, district_id, district_name, people, period, _ord."""
    return series.latest(population.where("village IS NOT NULL"), ["village"], "period", F.col("_ord"))


def coverage(points: DataFrame, villages: DataFrame, population: DataFrame, radius: float, shape: str = "disc") -> DataFrame:
    """A row a district and one for the city (district_id null): the share of the people covered, with the city's status and reasons.

    ``points``: x, y, counts (see ``verified``); ``villages``: village, rings,
    district_id, district_name; ``population`` as for ``latest_population``. A
    village's people count by the share of its area that is within ``radius`` of a
    point that counts. Villages without a size, a population (0 or more) or a
    district are left out; a district is the population's, else the boundary's.
    The status is unavailable where nobody is there to be covered, partial where points were
    left out or anything is missing, else observed.
    """
    seen = points.agg(F.count_if("counts").alias("verified_points"), F.count_if(~F.col("counts")).alias("excluded_points"))
    people = latest_population(population).select("village", F.col("district_id").alias("__d"), F.col("district_name").alias("__n"), F.col("people").cast("double").alias("people"), F.lit(1).alias("__has"))
    shares = overlay.coverage(villages, points.where("counts"), "village", radius, shape)
    both = villages.drop("rings").join(shares, "village").join(people, "village", "left")
    both = both.withColumns({"district_id": F.coalesce("__d", "district_id"), "district_name": F.coalesce("__n", "district_name")})
    counts = F.coalesce((N.finite(F.col("people")) >= 0) & (F.col("area") > 0), F.lit(False)) & F.col("district_id").isNotNull()
    # A row a village, read by the districts, the city and the counts: it is written, so that the overlay runs once.
    both = scratch.kept(both.withColumn("__use", counts), "villages")
    own = both.where("__use").withColumn("__covered", F.col("ratio") * F.col("people"))
    sums = [F.sum("__covered").alias("covered_people"), F.sum("people").alias("people"), F.count("*").alias("villages"), F.count_if(F.col("ratio") > 0).alias("covered_villages")]
    kind = dict(both.dtypes)["district_id"]
    each = own.groupBy("district_id").agg(F.max("district_name").alias("district_name"), *sums)
    city = own.agg(*sums).withColumns({"district_id": F.lit(None).cast(kind), "district_name": F.lit(None).cast("string")})
    joined = both.agg(F.count("*").alias("boundaries"), F.count("__has").alias("joined_villages"), F.count_if("__use").alias("__used"))
    published = population.where("village IS NOT NULL").agg(F.count("*").alias("__published"))
    facts = seen.crossJoin(joined).crossJoin(published).crossJoin(city.select(F.col("people").alias("__city")))
    none = F.col("verified_points") == 0

    def when(test: Column, reason: str) -> Column:
        return F.when(test, F.lit(reason))

    reasons = F.when(none, F.array(F.lit("no_verified_service_points"))).otherwise(
        F.array_compact(
            F.array(
                when((F.col("boundaries") > 0) & (F.col("joined_villages") < F.col("boundaries")), "incomplete_village_population_coverage"),
                when(F.col("__used") == 0, "no_boundary_population_join"),
                when(F.col("boundaries") == 0, "village_boundaries_not_published"),
                when(F.col("__published") == 0, "village_population_not_published"),
            )
        )
    )
    facts = facts.withColumn("reasons", reasons)
    unknown = none | (F.coalesce("__city", F.lit(0.0)) <= 0)
    status = F.when(unknown, "unavailable").when((F.col("excluded_points") > 0) | (F.size("reasons") > 0), "partial").otherwise("observed")
    facts = facts.select("verified_points", "excluded_points", "boundaries", "joined_villages", F.coalesce(N.ratio(F.col("joined_villages"), F.col("boundaries")), F.lit(0.0)).alias("population_coverage"), "reasons", status.alias("status"))
    rows = each.unionByName(city).crossJoin(F.broadcast(facts))
    # Without a point that counts there is no district's figure.
    rows = rows.where(F.col("district_id").isNull() | (F.col("verified_points") > 0))
    known = F.col("verified_points") > 0
    value = F.when(known, N.ratio(F.col("covered_people"), F.when(F.col("people") > 0, F.col("people"))) * 100)
    return rows.select("district_id", "district_name", value.alias("value"), F.when(known, F.col("covered_people")).alias("covered_people"), "people", "villages", F.when(known, F.col("covered_villages")).alias("covered_villages"), "status", "reasons", "verified_points", "excluded_points", "boundaries", "joined_villages", "population_coverage")
