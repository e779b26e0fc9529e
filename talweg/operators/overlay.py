"""How much of each area lies under the union of equal shapes around points, exactly, cell by cell.

The plane is cut into cells of a quarter of the radius. An area and the points
near it meet on cells, not pair by pair. A cell that one shape holds whole needs
no other shape: in a dense city nearly all cells are such. A cell that an area and a
shape both hold whole is its own size, and one that an area holds is measured once for
all areas. Other cells keep the
shapes that reach into them, and where those are more than ``MANY``, the cell is cut
into 64, most of which are then whole or untouched. What is left is measured in numpy:
between neighbouring x of corners and crossings all sides are straight, so a
covered length is linear there and its mean is its middle value. An area's size
is its polygon's; cells add up what of it is covered, in as many tasks as there are
cells.

Areas with the same rings are measured once. Points that repeat a place are one. Null or non-finite coordinates are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions import geo
from talweg.sources import scratch

#: Cells on a radius; shapes beyond which a cell is cut; parts of its side then; crossings that are looked at together.
FINE, MANY, CUT, SLABS = 4, 64, 8, 1 << 18
SHAPES = ("disc", "square")


def outline(shape: str, radius: float) -> np.ndarray:
    """Corners of the shape around the origin: a polygon of 64 sides for a disc, or the square of that half side."""
    return np.array(geo.disc(0.0, 0.0, radius) if shape == "disc" else [(-radius, -radius), (radius, -radius), (radius, radius), (-radius, radius)], float)


def sides(corners: np.ndarray) -> np.ndarray:
    """Rows of x1, y1, x2, y2."""
    return np.concatenate([corners, np.roll(corners, -1, -2)], -1)


def breaks(every: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """x of all corners and crossings between ``lo`` and ``hi``, ascending."""
    x1, y1, x2, y2 = every.T
    dx, dy = x2 - x1, y2 - y1
    det = dx[:, None] * dy - dy[:, None] * dx
    ox, oy = x1[None] - x1[:, None], y1[None] - y1[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (ox * dy - oy * dx) / det
        u = (ox * dy[:, None] - oy * dx[:, None]) / det
        crossing = (x1[:, None] + t * dx[:, None])[(det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)]
    x = np.concatenate([x1, x2, crossing, [lo, hi]])
    return np.unique(x[(x >= lo) & (x <= hi)])


def crossings(lines: np.ndarray, mid: np.ndarray, blank: float) -> np.ndarray:
    """Rows of y at which the sides cross each vertical line, ``blank`` where a side doesn't."""
    a, b, c, d = lines.T
    x = mid[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        y = b + (x - a) / (c - a) * (d - b)
    return np.where((np.minimum(a, c) < x) & (np.maximum(a, c) > x), y, blank)


def covered_area(lines: np.ndarray, covers: np.ndarray | None, box: tuple[float, float, float, float]) -> float:
    """Area within the box of the polygon with these sides, under the union of ``covers`` (shapes x corners x 2); without ``covers`` all of it counts."""
    x0, y0, x1, y1 = box
    frame = sides(np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float))
    shapes = None if covers is None else sides(covers)
    every = lines if shapes is None else np.concatenate([lines, shapes.reshape(-1, 4)])
    a, b, c, d = every.T
    # What turns or crosses elsewhere changes nothing in the box.
    near = (np.maximum(a, c) >= x0) & (np.minimum(a, c) <= x1) & (np.maximum(b, d) >= y0) & (np.minimum(b, d) <= y1)
    at = breaks(np.concatenate([every[near], frame]), x0, x1)
    wide, least = np.diff(at), 1e-12 * (np.abs(at).max() + 1)
    mid, wide = ((at[:-1] + at[1:]) / 2)[wide > least], wide[wide > least]
    over, starts = np.zeros((0, 4)), np.zeros(0, np.int64)
    if shapes is not None:
        # Of a convex shape only the sides above or below the box matter, and of them the least and the greatest y.
        used = (np.maximum(shapes[..., 0], shapes[..., 2]) > x0) & (np.minimum(shapes[..., 0], shapes[..., 2]) < x1)
        over, (starts,) = shapes[used], np.nonzero(np.diff(np.nonzero(used)[0], prepend=-1))
        if not len(over):
            return 0.0
    total, step = 0.0, max(1, SLABS // (len(over) + len(lines)))
    for k in range(0, len(mid), step):
        x, width = mid[k : k + step], wide[k : k + step]
        inside = np.clip(np.sort(crossings(lines, x, np.inf), 1), y0, y1)
        low, high = inside[:, : len(lines) // 2 * 2 : 2], inside[:, 1::2]
        if shapes is None:
            total += ((high - low).sum(1) * width).sum()
            continue
        bottom = np.minimum.reduceat(crossings(over, x, np.inf), starts, 1)
        order = np.argsort(bottom, 1)
        bottom = np.take_along_axis(bottom, order, 1)
        top = np.take_along_axis(np.maximum.reduceat(crossings(over, x, -np.inf), starts, 1), order, 1)
        # A shape adds what lies above all shapes that begin below it.
        bottom[:, 1:] = np.maximum(bottom[:, 1:], np.maximum.accumulate(top, 1)[:, :-1])
        for lo, hi in zip(low.T, high.T):
            total += (np.maximum(0.0, np.minimum(hi[:, None], top) - np.maximum(lo[:, None], bottom)).sum(1) * width).sum()
    return float(total)


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))


def _reach(dx: Column, dy: Column, half: float, radius: float, shape: str) -> tuple[Column, Column]:
    """Whether a shape at this distance from a cell's middle holds the cell whole, and whether it may reach into it."""
    if shape == "square":
        far = F.greatest(F.abs(dx), F.abs(dy))
        return far + half <= radius, far - half < radius
    # The polygon of 64 sides holds the circle that touches its sides.
    furthest, nearest = F.hypot(F.abs(dx) + half, F.abs(dy) + half), F.hypot(F.greatest(F.abs(dx) - half, F.lit(0.0)), F.greatest(F.abs(dy) - half, F.lit(0.0)))
    return furthest <= radius * float(np.cos(np.pi / 64)), nearest < radius


def _near(pairs: DataFrame, size: float, radius: float, shape: str) -> DataFrame:
    """Of (cx, cy, x, y) what reaches into cells of this size, and whether it holds the cell whole."""
    middle = lambda c: (F.col(c) + 0.5) * size
    whole, reaches = _reach(F.col("x") - middle("cx"), F.col("y") - middle("cy"), size / 2, radius, shape)
    return pairs.withColumns({"whole": whole, "reaches": reaches}).where("reaches").drop("reaches")


def covered_cells(points: DataFrame, radius: float, shape: str) -> DataFrame:
    """(size, cx, cy, near): cells that shapes reach into; ``near`` is null where one shape holds the cell whole.

    What is counted of the cells, and what reaches into those that none holds whole, is written, so points meet cells twice, however often the result is read.
    """
    size = radius / FINE
    wide = points.where("NOT isnan(x) AND NOT isnan(y) AND abs(x) < double('inf') AND abs(y) < double('inf')").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    pairs = wide.withColumn("cx", F.explode(_cells(F.col("x") - radius, F.col("x") + radius, size))).withColumn("cy", F.explode(_cells(F.col("y") - radius, F.col("y") + radius, size)))
    rows = []
    for side in (size, size / CUT):
        near = _near(pairs, side, radius, shape)
        full = scratch.kept(near.groupBy("cx", "cy").agg(F.bool_or("whole").alias("whole"), F.count("*").alias("n")), "cells")
        open_ = scratch.kept(near.drop("whole").join(full.where("NOT whole").select("cx", "cy", "n").hint("merge"), ["cx", "cy"]), "open-cells")
        few = open_.where(f"n <= {MANY}") if side == size else open_
        lists = few.groupBy("cx", "cy").agg(F.collect_list(F.struct("x", "y")).alias("near"))
        held = full.where("whole").select("cx", "cy", F.lit(None).cast(lists.schema["near"].dataType).alias("near"))
        rows.append(lists.unionByName(held).withColumn("size", F.lit(side)))
        child = open_.where(f"n > {MANY}").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(CUT - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(CUT - 1))))
        pairs = child.select((F.col("cx") * CUT + F.col("i")).alias("cx"), (F.col("cy") * CUT + F.col("j")).alias("cy"), "x", "y")
    return rows[0].unionByName(rows[1])


def _leaning(lines: Column) -> Column:
    """The sides that aren't vertical."""
    return F.filter(lines, lambda e: e["x1"] != e["x2"])


def _y(e: Column, x: Column) -> Column:
    return e["y1"] + (x - e["x1"]) * ((e["y2"] - e["y1"]) / F.when(e["x1"] != e["x2"], e["x2"] - e["x1"]))


def _ends(e: Column, x0: Column, x1: Column) -> tuple[Column, Column]:
    """Least and greatest x of a side between ``x0`` and ``x1``."""
    return F.greatest(F.least(e["x1"], e["x2"]), x0), F.least(F.greatest(e["x1"], e["x2"]), x1)


def two_sides(lines: Column, x0: Column, x1: Column) -> Column:
    """Whether all of a polygon between ``x0`` and ``x1`` lies between two sides that don't cross there."""
    e, f = F.get(_leaning(lines), 0), F.get(_leaning(lines), 1)
    (a, b), (c, d) = _ends(e, x0, x1), _ends(f, x0, x1)
    return F.coalesce((F.size(_leaning(lines)) == 2) & (a == c) & (b == d) & ((_y(e, a) - _y(f, a)) * (_y(e, b) - _y(f, b)) >= 0), F.lit(False))


def between(lines: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Area of the box that lies between ``two_sides``: the difference of the areas under each, its height clipped to the box."""
    high = y1 - y0
    # The integral of a height clipped to 0 and ``high``, over the height.
    upto = lambda t: F.when(t <= 0, 0.0).when(t <= high, t * t / 2).otherwise(high * (t - high / 2))

    def under(e: Column) -> Column:
        a, b = _ends(e, x0, x1)
        u, v = _y(e, a) - y0, _y(e, b) - y0
        flat = F.abs(v - u) <= 1e-9 * high
        mean = F.when(flat, F.least(F.greatest((u + v) / 2, F.lit(0.0)), high)).otherwise((upto(v) - upto(u)) / F.when(~flat, v - u))
        return F.when(b > a, (b - a) * mean).otherwise(0.0)

    return F.abs(under(F.get(_leaning(lines), 0)) - under(F.get(_leaning(lines), 1)))


def _touched(sized: DataFrame, key: str, size: float) -> DataFrame:
    """(key, qx, qy, lines, two): the cells that areas reach into; ``lines`` are the sides in the cell's column, null where no side reaches into the cell; ``two``: see ``two_sides``."""
    line = F.flatten(F.transform("rings", geo.edges))
    ring = F.element_at("rings", 1)
    ends = {c: (F.array_min(F.transform(ring, lambda p: p[c])), F.array_max(F.transform(ring, lambda p: p[c]))) for c in "xy"}
    spread = sized.where("area > 0").select(key, line.alias("lines"), *(e.alias(f"{c}{i}") for c in "xy" for i, e in enumerate(ends[c])))
    spread = spread.withColumn("qx", F.explode(_cells(F.col("x0"), F.col("x1"), size)))
    lo, low, middle = F.col("qx") * size, F.col("qy") * size, (F.col("qx") + 0.5) * size
    # Of its sides a column of cells needs those that reach into it.
    spread = spread.withColumn("lines", F.filter("lines", lambda e: (F.greatest(e["x1"], e["x2"]) > lo) & (F.least(e["x1"], e["x2"]) < lo + size))).withColumn("qy", F.explode(_cells(F.col("y0"), F.col("y1"), size)))
    cut = F.exists("lines", lambda e: (F.greatest(e["y1"], e["y2"]) > low) & (F.least(e["y1"], e["y2"]) < low + size))
    # Without a side in it a cell is in the area whole if the sides below its middle are odd in number, else not at all.
    below = F.size(F.filter("lines", lambda e: (F.least(e["x1"], e["x2"]) <= middle) & (middle < F.greatest(e["x1"], e["x2"])) & (F.least(e["y1"], e["y2"]) < low + size / 2)))
    return spread.withColumn("cut", cut).where(F.col("cut") | (below % 2 == 1)).select(key, "qx", "qy", F.when(F.col("cut"), F.col("lines")).alias("lines"), two_sides(F.col("lines"), lo, lo + size).alias("two"))


def coverage(areas: DataFrame, points: DataFrame, key: str, radius: float, shape: str = "disc") -> DataFrame:
    """(key, area, covered, ratio) of each area: its size, and how much of it the union of shapes around the points covers.

    ``areas``: key (one row each), rings (the first less the others). Areas of no size have a null ratio.
    """
    if radius <= 0 or shape not in SHAPES:
        raise ValueError(f"a positive radius and one of {', '.join(SHAPES)} are needed")
    named = areas.select(key, F.col("rings").alias("__rings"))
    sized = areas.groupBy("rings").agg(F.min(key).alias(key)).withColumn("area", geo.polygon_area(F.col("rings")))
    size = radius / FINE
    spread = _touched(sized, key, size)
    ratio = F.col("size") / size
    cells = covered_cells(points, radius, shape).withColumns({"qx": F.floor(F.col("cx") * ratio + ratio / 2).cast("long"), "qy": F.floor(F.col("cy") * ratio + ratio / 2).cast("long")})
    cells = scratch.kept(cells, "covered-cells")
    # Areas have far more cells than their table's size tells: neither side is broadcast.
    meet = lambda a, c: a.hint("merge").join(c, ["qx", "qy"])
    inner, edge = spread.where("lines IS NULL").select(key, "qx", "qy"), spread.where("lines IS NOT NULL")
    held, open_ = cells.where("near IS NULL").drop("near"), cells.where("near IS NOT NULL")
    kind = dict(areas.dtypes)[key]
    frame = lambda x, y: (F.col("cx") + x) * F.col("size") if x is not None else (F.col("cy") + y) * F.col("size")
    x0, x1, y0, y1 = frame(0, None), frame(1, None), frame(None, 0), frame(None, 1)
    own = F.array(*(F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")) for a, b, c, d in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))))
    # What an area holds whole needs the cell's figure alone, measured once for all areas.
    asked = open_.join(inner.select("qx", "qy").distinct().hint("merge"), ["qx", "qy"], "left_semi").withColumn("lines", own)
    corners = outline(shape, radius)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lines, near, cx, cy, side in zip(batch["lines"], batch["near"], batch["cx"], batch["cy"], batch["size"]):
                covers = None if near is None else np.array([(p["x"], p["y"]) for p in near])[:, None] + corners
                segments = np.array([(e["x1"], e["y1"], e["x2"], e["y2"]) for e in lines]).reshape(-1, 4)
                out.append(covered_area(segments, covers, (cx * side, cy * side, (cx + 1) * side, (cy + 1) * side)))
            yield batch.drop(columns=["lines", "near", "cx", "cy", "size"]).assign(part=out)

    geometry = ["lines", "near", "cx", "cy", "size"]
    of_cells = asked.select("qx", "qy", *geometry).mapInPandas(measure, "qx long, qy long, part double").unionByName(held.select("qx", "qy", (F.col("size") * F.col("size")).alias("part")))
    hard = meet(edge, open_).unionByName(meet(edge.where("NOT two"), held), allowMissingColumns=True)
    parts = [
        meet(inner, of_cells).select(key, "part"),
        meet(edge.where("two"), held).select(key, between(F.col("lines"), x0, x1, y0, y1).alias("part")),
        hard.select(key, *geometry).mapInPandas(measure, f"`{key}` {kind}, part double"),
    ]
    parts = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("part").alias("covered"))
    out = sized.join(parts, key, "left").drop(key).withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    out = named.join(out, F.col("__rings").eqNullSafe(F.col("rings"))).select(key, "area", "covered")
    return out.withColumn("ratio", F.when(F.col("area") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("covered") / F.col("area")))))
