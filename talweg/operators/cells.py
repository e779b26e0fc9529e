"""Space cut into cells that follow the points: dense places get small cells, and one place that can't be cut gets several tasks.

The extent is cut into quarters, each again wherever it holds more than one in
``PARTS`` of all points, ``DEPTH`` times at most. At each depth fewer than
``PARTS`` cells hold so many, whatever the data, so all cells to be cut, and the
quarters that they are cut into, are a table of bounded size. A cell that is as small as
may be and still holds more is dealt out to ``shares`` tasks by a hash of the
point, each with its own copy of what the cell is joined to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cuts of a side are 2 to the DEPTH; a cell with more than one in PARTS of the points is cut.
DEPTH, PARTS = 12, 2000


def extent(boxes: DataFrame, *names: str) -> DataFrame:
    """One row: lo_x, lo_y and the side of the square that holds all boxes; ``names`` are the columns of least and greatest x, then y."""
    x0, x1, y0, y1 = names
    row = boxes.agg(F.min(x0).alias("lo_x"), F.min(y0).alias("lo_y"), F.greatest(F.max(x1) - F.min(x0), F.max(y1) - F.min(y0)).alias("side"))
    return row.withColumn("side", F.when(F.col("side") > 0, F.col("side")).otherwise(1.0))


def at(value: Column, axis: str, depth: int = DEPTH) -> Column:
    """Place of a coordinate among the smallest cells of an axis; null outside the extent."""
    share = (value - F.col(f"lo_{axis}")) / F.col("side")
    return F.when(share.between(0, 1), F.least(F.floor(share * (1 << depth)), F.lit((1 << depth) - 1)).cast("int"))


def bounds() -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1 of a cell (level, cx, cy) in an extent, a little wider than what ``at`` rounds into it."""
    size, little = F.col("side") / F.expr("shiftleft(1, level)"), F.col("side") * 1e-9 + (F.abs("lo_x") + F.abs("lo_y")) * 1e-12
    end = lambda axis, k: F.col(f"lo_{axis}") + (F.col(f"c{axis}") + k) * size + (little if k else -little)
    return end("x", 0), end("y", 0), end("x", 1), end("y", 1)


def leaves(points: DataFrame, parts: int = PARTS, depth: int = DEPTH) -> DataFrame:
    """(level, cx, cy, n, shares) of the cells that hold points; ``points`` has gx, gy, places among the smallest cells.

    Points are counted by smallest cell first; all larger cells are sums of those.
    """
    smallest = points.where("gx IS NOT NULL AND gy IS NOT NULL").groupBy("gx", "gy").agg(F.count("*").alias("n"))
    up = lambda c: F.expr(f"shiftright({c}, {depth} - level)")
    levels = smallest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).groupBy("level", up("gx").alias("cx"), up("gy").alias("cy")).agg(F.sum("n").alias("n"))
    whole = levels.where("level = 0").select((F.col("n") / parts).alias("most"), F.lit(0).alias("one"))
    heavy = levels.join(F.broadcast(whole)).where(F.col("n") > F.col("most")).select("level", "cx", "cy")
    cut = F.broadcast(heavy.where(F.col("level") < depth).select((F.col("level") + 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py")))
    # A quarter of a cell that is cut, and not cut itself: within the bound stated above.
    quarters = levels.where("level > 0").withColumns({"px": F.shiftright("cx", 1), "py": F.shiftright("cy", 1)}).join(cut, ["level", "px", "py"], "left_semi")
    own = quarters.join(F.broadcast(heavy.where(F.col("level") < depth)), ["level", "cx", "cy"], "left_anti").join(F.broadcast(whole))
    root = levels.where("level = 0").join(F.broadcast(heavy), ["level", "cx", "cy"], "left_anti").withColumn("shares", F.lit(1))
    shares = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("most"))).cast("int")
    return own.select("level", "cx", "cy", "n", shares.alias("shares")).unionByName(root.select("level", "cx", "cy", "n", "shares"))


def dealt(points: DataFrame, found: DataFrame, *seed: str, depth: int = DEPTH) -> DataFrame:
    """``points`` (with gx, gy) with the level, cx, cy of their cell and their share of it; no point is shuffled."""
    up = lambda c: F.expr(f"shiftright({c}, {depth} - level)")
    each = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumns({"cx": up("gx"), "cy": up("gy")})
    share = F.pmod(F.xxhash64(*seed), F.col("shares")).cast("int")
    return each.join(F.broadcast(found.drop("n")), ["level", "cx", "cy"]).withColumn("share", share).drop("shares", "gx", "gy")


def covering(boxes: DataFrame, found: DataFrame, coarse: int = 6, depth: int = DEPTH) -> DataFrame:
    """``boxes`` (with gx0, gx1, gy0, gy1) once for each share of each cell that they touch.

    Boxes and cells meet on a coarse grid, so that neither is paired with all of the other.
    """
    wide = depth - coarse
    cell = found.withColumns({f"{c}{end}": F.expr(f"shiftleft(c{c} + {end}, {depth} - level) - {end}") for c in "xy" for end in (0, 1)})
    spread = lambda df, lo, hi, name: df.withColumn(name, F.explode(F.sequence(F.shiftright(lo, wide), F.shiftright(hi, wide))))
    cell = spread(spread(cell, "x0", "x1", "qx"), "y0", "y1", "qy")
    box = spread(spread(boxes, "gx0", "gx1", "qx"), "gy0", "gy1", "qy")
    touching = (F.col("gx0") <= F.col("x1")) & (F.col("gx1") >= F.col("x0")) & (F.col("gy0") <= F.col("y1")) & (F.col("gy1") >= F.col("y0"))
    # A pair that meets on several coarse cells counts on the first of them alone.
    first = (F.col("qx") == F.shiftright(F.greatest("gx0", "x0"), wide)) & (F.col("qy") == F.shiftright(F.greatest("gy0", "y0"), wide))
    met = box.join(F.broadcast(cell.drop("n")), ["qx", "qy"]).where(touching & first)
    return met.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("qx", "qy", "x0", "x1", "y0", "y1", "shares", "gx0", "gx1", "gy0", "gy1")
