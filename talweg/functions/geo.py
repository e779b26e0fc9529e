"""Plane geometry as column expressions. A ring is an array of struct<x,y>; a polygon is an array of rings, holes included."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80 and the transverse Mercator zone of EPSG:3826.
A, FLATTENING, LON0, K0, FALSE_EASTING = 6378137.0, 1 / 298.257222101, 121.0, 0.9999, 250_000.0
EDGE = 1e-12


def edges(ring: Column) -> Column:
    """Each point with the one after it, the last with the first."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.element_at(ring, F.when(i + 1 < n, i + 2).otherwise(1))["x"].alias("x2"), F.element_at(ring, F.when(i + 1 < n, i + 2).otherwise(1))["y"].alias("y2")))


def _signed_area(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda a, e: a + e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2


def polygon_area(rings: Column) -> Column:
    """Shoelace: the first ring less the holes."""
    return F.aggregate(F.transform(rings, lambda r, i: F.abs(_signed_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda a, x: a + x)


def on_edge(x: Column, y: Column, ring: Column) -> Column:
    """The point lies on a side."""
    def side(e: Column) -> Column:
        cross = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
        between = x.between(F.least(e["x1"], e["x2"]) - EDGE, F.greatest(e["x1"], e["x2"]) + EDGE) & y.between(F.least(e["y1"], e["y2"]) - EDGE, F.greatest(e["y1"], e["y2"]) + EDGE)
        return (F.abs(cross) <= EDGE) & between

    return F.exists(edges(ring), side)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting; sides count as inside."""
    def crosses(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"]) + e["x1"])

    odd = F.size(F.filter(edges(ring), crosses)) % 2 == 1
    return odd | on_edge(x, y, ring)


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """In the first ring and strictly in none of the holes."""
    hole = F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: in_ring(x, y, r) & ~on_edge(x, y, r))
    return in_ring(x, y, F.element_at(rings, 1)) & ~hole


def holds_box(rings: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The polygon holds the box whole: its middle, and no side reaches into it."""
    def reaches(e: Column) -> Column:
        near = (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["x1"], e["x2"]) <= x1) & (F.greatest(e["y1"], e["y2"]) >= y0) & (F.least(e["y1"], e["y2"]) <= y1)
        turn = [(x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"]) for x in (x0, x1) for y in (y0, y1)]
        # All corners on one side of its line, by more than rounding.
        little = EDGE * (F.abs(e["x1"]) + F.abs(e["x2"]) + F.abs(x1)) * (F.abs(e["y1"]) + F.abs(e["y2"]) + F.abs(y1))
        return near & ~((F.least(*turn) > little) | (F.greatest(*turn) < -little))

    return ~F.exists(F.flatten(F.transform(rings, edges)), reaches) & in_polygon((x0 + x1) / 2, (y0 + y1) / 2, rings)


def tm2(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude to easting and northing (Krüger series to the third order of the flattening)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(s) - e * atanh(e * s))
    dl = F.radians(lon - LON0)
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east = sum((a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(alpha, 1)), eta)
    north = sum((a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(alpha, 1)), xi)
    return FALSE_EASTING + K0 * radius * east, K0 * radius * north


def tm2_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Easting and northing to longitude and latitude (the inverse series to the same order)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi, eta = y / (K0 * radius), (x - FALSE_EASTING) / (K0 * radius)
    xi_ = xi - sum((b * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, b in enumerate(beta, 1)), F.lit(0.0))
    eta_ = eta - sum((b * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, b in enumerate(beta, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi_) / F.cosh(eta_))
    lat = chi + sum((d * F.sin(2 * k * chi) for k, d in enumerate(delta, 1)), F.lit(0.0))
    return LON0 + F.degrees(F.atan2(F.sinh(eta_), F.cos(xi_))), F.degrees(lat)


def disc(cx: float, cy: float, r: float, sides: int = 64) -> list[tuple[float, float]]:
    """A circle as the polygon that buffers are made of."""
    return [(cx + r * math.cos(2 * math.pi * k / sides), cy + r * math.sin(2 * math.pi * k / sides)) for k in range(sides)]
