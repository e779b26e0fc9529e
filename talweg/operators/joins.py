"""Joins with the reference's rules about ambiguity, fallback and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions import geo
from talweg.operators import cells
from talweg.sources import scratch


def ambiguous(build: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a lookup table has more than once."""
    return build.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def lookup(df: DataFrame, build: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a table whose keys must be unique; a key that isn't fails the job where it is met."""
    rest = [c for c in build.columns if c not in keys]
    one = build.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in rest))
    checked = one.withColumn("__ok", F.assert_true(F.col("__n") == 1, F.lit("ambiguous lookup key")))
    return df.join(checked.where("__ok IS NULL").drop("__n", "__ok"), keys, "left")


def fallback_lookup(df: DataFrame, build: DataFrame, first: str, second: str, build_first: str, build_second: str, value: str) -> DataFrame:
    """The value by the first key, else by the second; the least value where a key repeats."""
    a = build.groupBy(F.col(build_first).alias(first)).agg(F.min(value).alias("__a"))
    b = build.groupBy(F.col(build_second).alias(second)).agg(F.min(value).alias("__b"))
    return df.join(a, first, "left").join(b, second, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def grid(rows: DataFrame, *dims: DataFrame) -> DataFrame:
    """Every combination of the dimensions (small tables), with what rows there are."""
    full = dims[0]
    for d in dims[1:]:
        full = full.crossJoin(d)
    return full.join(rows, full.columns, "left")


def _axis(ring: Column, axis: str) -> Column:
    """The ring's x or y values."""
    return F.transform(ring, lambda p: p[axis])


def located(points: DataFrame, polygons: DataFrame, key: str, region: str, parts: int = cells.PARTS) -> DataFrame:
    """(key, region) of each point: the polygon that holds it if there is exactly one, else null.

    ``polygons``: region, rings. Points and polygons meet on cells that are cut
    where points are many (``cells``), then on the bounding box, so the ray cast
    meets few pairs and a hot spot is many tasks. The points of a cell that polygons of two
    regions hold whole have none, and are paired with nothing; of the others a row a point leaves the task
    that met them. Points that repeat a key are one if they hold one place.
    """
    ring = F.element_at(F.col("rings"), 1)
    # Polygons with the same rings are one, of several regions.
    boxed = polygons.groupBy("rings").agg(F.min(region).alias("__least"), F.max(region).alias("__most")).select("__least", "__most", "rings", F.xxhash64("rings").alias("__box"), *(f(_axis(ring, c)).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.array_min, F.array_max)))
    near = F.col("x").between(F.col("array_min_x"), F.col("array_max_x")) & F.col("y").between(F.col("array_min_y"), F.col("array_max_y"))
    square = F.broadcast(cells.extent(boxed, "array_min_x", "array_max_x", "array_min_y", "array_max_y"))
    placed = points.select(key, "x", "y").join(square).withColumns({"gx": cells.at(F.col("x"), "x"), "gy": cells.at(F.col("y"), "y")}).select(key, "x", "y", "gx", "gy")
    # Of bounded size, and read several times.
    found = scratch.kept(cells.leaves(placed, parts), "cells")
    spread = boxed.join(square).withColumns({f"g{c}{end}": cells.at(F.col(f"array_{side}_{c}"), c) for c in "xy" for end, side in ((0, "min"), (1, "max"))}).drop("lo_x", "lo_y", "side")
    # Rings come when the cells are known, one copy for each.
    sides = [c for c in boxed.columns if c.startswith("array")]
    touching = cells.covering(spread.drop("rings", *sides), found.withColumn("shares", F.lit(1))).join(boxed.select("__box", "rings"), "__box").join(square)
    x0, y0, x1, y1 = cells.bounds()
    whole = touching.where(geo.holds_box(F.col("rings"), x0, y0, x1, y1))
    full = whole.groupBy("level", "cx", "cy").agg(F.min("__least").alias("least"), F.max("__most").alias("most")).where("least <> most").select("level", "cx", "cy")
    found = scratch.kept(found.join(full, ["level", "cx", "cy"], "left_anti"), "open-cells")
    around = cells.covering(spread.drop("rings", *sides), found).join(boxed.drop("__least", "__most"), "__box")
    dealt = cells.dealt(placed.where("gx IS NOT NULL AND gy IS NOT NULL"), found, key, "x", "y")
    held = dealt.join(around, ["level", "cx", "cy", "share"]).where(near & geo.in_polygon(F.col("x"), F.col("y"), F.col("rings")))
    # Least and greatest, unlike a distinct count, are taken before the shuffle.
    one = held.groupBy(key).agg(F.min("__least").alias(region), F.max("__most").alias("__most")).where(F.col(region) == F.col("__most")).drop("__most")
    return points.select(key).join(one, key, "left")


def collapsed(candidates: DataFrame, key: str, spread: float = 150.0) -> DataFrame:
    """One place for each key: its single point; the centroid of points no further than ``spread`` from it; or a dominant point."""
    points = candidates.groupBy(key, "x", "y").agg(F.count("*").alias("n"))
    whole = points.groupBy(key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("places"), F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))).alias("top"))
    far = points.join(whole.select(key, "cx", "cy"), key).groupBy(key).agg(F.max(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).alias("far"))
    dominant = F.col("top.n") >= 2 * (F.col("total") - F.col("top.n")) + 1
    how = F.when(F.col("places") == 1, "single").when(F.col("far") <= spread, "centroid").when(dominant, "dominant")
    pick = lambda centre, top: F.when(how == "centroid", centre).when(how.isNotNull(), -top)
    return whole.join(far, key).select(key, how.alias("how"), pick(F.col("cx"), F.col("top.x")).alias("x"), pick(F.col("cy"), F.col("top.y")).alias("y"))


def tiered(requests: DataFrame, keys: DataFrame, request: str) -> DataFrame:
    """Entity resolution, strict keys first: (request, tier, key) ⋈ (key, x, y); the first tier that resolves wins.

    A key is resolved once, for all requests that have it. A request that has a tier twice (with
    other keys, or one again) takes that tier's places together.
    """
    named = requests.select(F.struct(request, "tier").alias("__k"), "key")
    own = named.groupBy("__k").agg(F.count("*").alias("__n"), F.first("key").alias("key"))
    one = own.where("__n = 1").join(collapsed(keys, "key"), "key").select("__k", "how", "x", "y")
    several = named.join(own.where("__n > 1").select("__k"), "__k").join(keys, "key").select("__k", "x", "y")
    found = one.unionByName(collapsed(several, "__k")).where("how IS NOT NULL").select(F.col(f"__k.{request}").alias(request), F.col("__k.tier").alias("tier"), "how", "x", "y")
    return found.groupBy(request).agg(F.min_by(F.struct("tier", "how", "x", "y"), "tier").alias("r")).select(request, "r.*")
