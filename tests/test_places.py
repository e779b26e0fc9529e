"""Addresses, cells, matching, overlay and service coverage against plain versions."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions import addresses
from talweg.operators import cells, joins, matching, overlay, service

RINGS = "array<array<struct<x:double,y:double>>>"


def test_address_parts_and_tiers(spark):
    rows = [
        ("新北市臺北區中山路二段10號之三(後棟)", {"city": "新北市", "town": "台北區", "street": "中山路", "section": 2, "plate": 10, "sub": 3}),
        ("中山路２段10-4號5樓", {"street": "中山路", "section": 2, "plate": 10, "sub": 4, "floor": 5}),
        ("八里區12鄰中山路9、11號", {"town": "八里區", "neighbourhood": 12, "street": "中山路", "plate": 9}),
        ("板橋區民生里3鄰文化路一段188巷12弄3之2號十二樓之1", {"town": "板橋區", "village": "民生里", "neighbourhood": 3, "street": "文化路", "section": 1, "lane": 188, "alley": 12, "plate": 3, "sub": 2, "floor": 12, "unit": 1}),
        ("四維路二十三段 5 號 B1樓", {"street": "四維路", "section": 23, "plate": 5, "cellar": "b", "floor": 1}),
        ("三峽區大學路", {"town": "三峽區", "street": "大學路"}),
        (" ", {}),
        (None, {}),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string").select("i", addresses.parts(F.col("a")).alias("p"))
    got = {r.i: r for r in df.select("i", "p", addresses.tiers(F.col("p")).alias("t")).collect()}
    for i, (_, want) in enumerate(rows):
        assert {k: v for k, v in got[i].p.asDict().items() if v is not None} == want
    assert [t.tier for t in got[0].t] == [0, 1, 3] and [t.tier for t in got[1].t] == [1, 2, 3] and got[6].t == [] and [t.tier for t in got[5].t] == [0, 1]
    # Ways to write one place share their keys.
    same = spark.createDataFrame([("文化路2段5之3號",), ("文化路二段5號之三",), ("文化路 ２段 5-3號",), ("文化路二段5之3號(旁)",)], "a string").select(addresses.parts(F.col("a")).alias("p")).select(addresses.tiers(F.col("p")).alias("t")).collect()
    assert len({tuple(map(tuple, r.t)) for r in same}) == 1
    n = spark.createDataFrame([(x,) for x in ("十", "十二", "二十", "九十九", "7", "三", "x", "三五", "")], "c string").select(addresses.number(F.col("c")).alias("n")).collect()
    assert [r.n for r in n] == [10, 12, 20, 99, 7, 3, None, None, None]


def spots(seed, n, hot):
    rng = random.Random(seed)
    return [(i, 50.0 + rng.random() * 1e-6, 50.0 + rng.random() * 1e-6) if rng.random() < hot else (i, rng.random() * 100, rng.random() * 100) for i in range(n)]


def test_a_hot_cell_is_cut_and_dealt_out(spark):
    n, parts = 6000, 40
    points = spark.createDataFrame(spots(1, n, 0.9), "k int, x double, y double")
    box = spark.createDataFrame([(0.0, 100.0, 0.0, 100.0)], "a double, b double, c double, d double")
    placed = points.crossJoin(cells.extent(box, "a", "b", "c", "d")).withColumns({"gx": cells.at(F.col("x"), "x"), "gy": cells.at(F.col("y"), "y")}).drop("lo_x", "lo_y", "side").cache()
    found = cells.leaves(placed, parts)
    rows = found.collect()
    assert sum(r.n for r in rows) == n and len(rows) <= 4 * parts * (cells.DEPTH + 1)
    assert max(r.shares for r in rows) >= 30 and all(r.shares == 1 or r.level == cells.DEPTH for r in rows)
    dealt = cells.dealt(placed, found, "k").groupBy("level", "cx", "cy", "share").count().collect()
    assert sum(r["count"] for r in dealt) == n and max(r["count"] for r in dealt) < 2.5 * n / parts


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_located_against_every_pair(spark, hot):
    rng = random.Random(7)
    polygons = []
    for i in range(25):
        x, y, w = rng.random() * 90, rng.random() * 90, 2 + rng.random() * 40
        polygons.append((i, [[(x, y), (x + w, y), (x + w / 2, y + w)]]))
    polygons.append((25, [[(40.0, 40.0), (60.0, 40.0), (60.0, 60.0), (40.0, 60.0)], [(49.0, 49.0), (51.0, 49.0), (51.0, 51.0), (49.0, 51.0)]]))
    points = spots(2, 1500, hot) + [(9000, -5.0, 3.0), (9001, None, 3.0), (9002, 1e9, 1e9)]
    df = spark.createDataFrame(points, "k int, x double, y double")

    def inside(x, y, rings):
        odd = lambda ring: sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) % 2
        return bool(odd(rings[0])) and not any(odd(h) for h in rings[1:])

    got = {r.k: r.region for r in joins.located(df, spark.createDataFrame(polygons, f"region int, rings {RINGS}"), "k", "region", parts=50).collect()}
    for k, x, y in points:
        held = [i for i, rings in polygons if x is not None and inside(x, y, rings)]
        assert got[k] == (held[0] if len(held) == 1 else None)


def test_a_cell_that_two_polygons_hold_is_no_pairs(spark):
    """Points under many polygons leave their task once each, and results are those of every pair."""
    rng = random.Random(3)
    squares = [(i % 70, x, y, w) for i in range(90) for x, y, w in [(rng.random() * 60, rng.random() * 60, 5 + rng.random() * 40)]]
    squares += [(100 + i, x, y, w) for i, x, y, w in squares[:20]] + squares[20:30]
    rows = [(i, [[(x, y), (x + w, y), (x + w, y + w), (x, y + w)]]) for i, x, y, w in squares]
    points = [(k, rng.random() * 110 - 5, rng.random() * 110 - 5) for k in range(3000)] + [(5000 + k, 30.0, 30.0) for k in range(900)]
    out = joins.located(spark.createDataFrame(points, "k int, x double, y double"), spark.createDataFrame(rows, f"region int, rings {RINGS}"), "k", "region", parts=100)
    plan = out._jdf.queryExecution().toString()
    assert "partial_max(__most" in plan and "distinct" not in plan.lower()
    got = {r.k: r.region for r in out.collect()}
    for k, x, y in points:
        held = {i for i, a, b, w in squares if a <= x <= a + w and b <= y <= b + w}
        assert got[k] == (held.pop() if len(held) == 1 else None)


def test_boxes_that_a_polygon_holds(spark):
    rng = random.Random(4)
    star = polygon(rng, 50, 50, 40, 9)
    hole = [(45.0, 45.0), (55.0, 45.0), (50.0, 56.0)]
    boxes = [(x, y, x + w, y + w) for _ in range(400) for x, y, w in [(rng.random() * 100, rng.random() * 100, 0.5 + rng.random() * 12)]]
    df = spark.createDataFrame([(*b, [star, hole]) for b in boxes], f"x0 double, y0 double, x1 double, y1 double, rings {RINGS}")
    got = [r.h for r in df.select(joins.geo.holds_box(F.col("rings"), *(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("h")).collect()]
    lines = [overlay.sides(np.array(r, float)) for r in (star, hole)]
    want = [overlay.covered_area(lines[0], None, b) - overlay.covered_area(lines[1], None, b) > (b[2] - b[0]) ** 2 * (1 - 1e-9) for b in boxes]
    assert got == want and 10 < sum(want) < 300


def test_matching_by_automaton_and_by_anchors(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abcä ") for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(500, None), (501, ""), (502, "x" * 5000 + "needle in it")] + [(600 + i, "ab" * 20) for i in range(50)]
    patterns = ["", "a", "ab", "ca", "bä", "abc ab", "needle in it", "aaaaaaaaaaaaaaaaaaaa", None, "ab", "b" * 9] + ["".join(rng.choice("abc") for _ in range(rng.randint(2, 12))) for _ in range(150)]
    df = spark.createDataFrame(texts, "k int, t string")
    rules = spark.createDataFrame([(p, i) for i, p in enumerate(patterns)], "p string, r int")
    want = sorted((k, i) for k, t in texts for i, p in enumerate(patterns) if t is not None and p is not None and p in t)
    for most in (matching.MOST, 0):
        got = matching.matched(df, F.col("t"), rules, "p", most)
        assert sorted(got.columns) == ["k", "p", "r", "t"] and sorted((r.k, r.r) for r in got.select("k", "r").collect()) == want
    assert matching.matched(df, F.col("t"), rules.limit(0), "p").count() == 0
    first = matching.first_matched(df, "k", F.col("t"), rules.where("length(p) > 1"), "p", "r", "p")
    assert {r.k: r.p for r in first.collect()}[600] == "ab"


def polygon(rng, x, y, r, n):
    """A star-shaped polygon."""
    corners = [(2 * math.pi * (k + rng.random() * 0.9) / n, r * (0.4 + rng.random())) for k in range(n)]
    return [(x + far * math.cos(a), y + far * math.sin(a)) for a, far in corners]


def grid_area(rings, centres, radius, shape, step):
    """Covered area by counting the middles of a fine grid."""
    ring = np.array(rings[0])
    gx, gy = np.meshgrid(np.arange(ring[:, 0].min(), ring[:, 0].max(), step) + step / 2, np.arange(ring[:, 1].min(), ring[:, 1].max(), step) + step / 2)
    odd = np.zeros(gx.shape, bool)
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            if y1 != y2:
                odd ^= ((y1 > gy) != (y2 > gy)) & (gx < (x2 - x1) * (gy - y1) / (y2 - y1) + x1)
    under = np.zeros(gx.shape, bool)
    for x, y in centres:
        under |= np.hypot(gx - x, gy - y) < radius if shape == "disc" else np.maximum(abs(gx - x), abs(gy - y)) < radius
    return (odd & under).sum() * step * step, odd.sum() * step * step


@pytest.mark.parametrize("shape", overlay.SHAPES)
def test_coverage_of_random_polygons(spark, shape):
    rng = random.Random(11)
    areas = [(i, [polygon(rng, rng.random() * 40, rng.random() * 40, 6, rng.randint(3, 12))]) for i in range(12)]
    areas.append((50, [[(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0)], [(5.0, 5.0), (25.0, 5.0), (25.0, 25.0), (5.0, 25.0)]]))
    areas.append((51, [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]]))
    # A dense spot, so that cells are cut.
    centres = [(rng.random() * 40, rng.random() * 40) for _ in range(20)] + [(8 + rng.random() / 4, 8 + rng.random() / 4) for _ in range(120)]
    df = spark.createDataFrame([*centres, *centres[:5], (float("nan"), 1.0), (None, 2.0)], "x double, y double")
    got = {r.k: r for r in overlay.coverage(spark.createDataFrame(areas, f"k int, rings {RINGS}"), df, "k", 3.0, shape).collect()}
    assert len(got) == len(areas) and got[51].ratio is None
    for k, rings in areas[:-1]:
        covered, area = grid_area(rings, centres, 3.0, shape, 0.02)
        assert got[k].area == pytest.approx(area, abs=0.5) and got[k].covered == pytest.approx(covered, rel=0.01, abs=0.3)


def test_covered_area_is_exact_for_boxes():
    rng = random.Random(1)
    for _ in range(40):
        at = [(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(rng.randint(1, 6))]
        covers = np.array([[(x - 3, y - 3), (x + 3, y - 3), (x + 3, y + 3), (x - 3, y + 3)] for x, y in at], float)
        want = sum(any(x - 3 <= i < x + 3 and y - 3 <= j < y + 3 for x, y in at) for i in range(5, 15) for j in range(4, 16))
        lines = overlay.sides(np.array([(2, 2), (18, 2), (18, 16), (2, 16)], float))
        assert overlay.covered_area(lines, covers, (5.0, 4.0, 15.0, 17.0)) == pytest.approx(want, abs=1e-9)
        assert overlay.covered_area(lines, None, (5.0, 4.0, 15.0, 17.0)) == pytest.approx(120)


def test_discs_in_a_cell_are_measured_at_once(spark):
    """All verticals of a cell go together, in slabs as exactly as all at once; areas with the same rings are one."""
    rng = np.random.default_rng(4)
    covers = rng.random((40, 1, 2)) * 12 - 6 + overlay.outline("disc", 10.0)
    lines, box = overlay.sides(np.array([(-1, -20), (30, -20), (30, 30), (0.5, 30)], float)), (-9.0, -9.0, -6.5, 9.0)
    lines2 = overlay.sides(np.array([(-8, -20), (30, -20), (30, 30), (-7.5, 30)], float))
    took = []
    for _ in range(5):
        began = time.perf_counter()
        got = overlay.covered_area(lines2, covers, box)
        took.append(time.perf_counter() - began)
    assert overlay.covered_area(lines, covers, box) == 0
    one = overlay.covered_area(lines2, covers[:1], box)
    assert one < got < 2.5 * 18
    with pytest.MonkeyPatch.context() as m:
        m.setattr(overlay, "SLABS", 1)
        slow = time.perf_counter()
        assert overlay.covered_area(lines2, covers, box) == pytest.approx(got, rel=1e-12)
        slow = time.perf_counter() - slow
    assert min(took) < slow / 3
    square = lambda x: [[(x, 0.0), (x + 7.0, 0.0), (x + 7.0, 7.0), (x, 7.0)]]
    areas = spark.createDataFrame([(k, square(float(k % 3))) for k in range(60)], f"k int, rings {RINGS}")
    out = overlay.coverage(areas, spark.createDataFrame([(3.0, 3.0), (9.0, 2.0)], "x double, y double"), "k", 4.0)
    assert "keys=[rings" in out._jdf.queryExecution().executedPlan().toString()
    rows = {r.k: (r.area, r.covered, r.ratio) for r in out.collect()}
    assert len(rows) == 60 and len(set(rows.values())) == 3 and all(rows[k] == rows[k % 3] for k in rows)


def test_service_statuses(spark):
    square = lambda x: [[(x, 0.0), (x + 10.0, 0.0), (x + 10.0, 10.0), (x, 10.0)]]
    villages = spark.createDataFrame([("a", square(0.0), 1, "one"), ("b", square(10.0), 1, "one"), ("c", square(500.0), None, None)], f"village string, rings {RINGS}, district_id int, district_name string")
    people = spark.createDataFrame([("a", None, None, 100, "2024", 1), ("a", None, None, 60, "2025", 0), ("b", 2, "two", 40, "2025", 0), ("c", 3, "three", 10, "2025", 0)], "village string, district_id int, district_name string, people int, period string, _ord int")
    raw = spark.createDataFrame([("matched", 5.0, 5.0, None, None), ("matched", None, None, 1.5, 0.5), ("failed", 5.0, 5.0, None, None), ("matched", None, 5.0, 999.0, 0.0)], "status string, px double, py double, lon double, lat double")
    points = service.verified(raw, lambda lon, lat: (lon * 10, lat * 10))
    rows = {r.district_id: r for r in service.coverage(points, villages, people, 5.0, "square").collect()}
    assert rows[1].value == 100 and rows[2].value == 100 and rows[3].value == 0 and rows[1].people == 60
    assert rows[None].value == pytest.approx(10000 / 110) and (rows[None].status, rows[None].reasons) == ("partial", []) and (rows[None].verified_points, rows[None].excluded_points) == (2, 2)
    whole = service.coverage(points.where("counts"), villages, people, 5.0, "square").where("district_id IS NULL").first()
    assert whole.status == "observed" and whole.population_coverage == 1
    gap = service.coverage(points.where("counts"), villages, people.where("village <> 'c'"), 5.0, "square").where("district_id IS NULL").first()
    assert gap.status == "partial" and gap.reasons == ["incomplete_village_population_coverage"] and gap.joined_villages == 2
    none = service.coverage(points.where("NOT counts"), villages, people, 5.0, "square").collect()
    assert [(r.district_id, r.value, r.status, r.reasons) for r in none] == [(None, None, "unavailable", ["no_verified_service_points"])]
    bare = service.coverage(points.where("counts"), villages.limit(0), people.limit(0), 5.0, "square").first()
    assert bare.status == "unavailable" and bare.reasons == ["no_boundary_population_join", "village_boundaries_not_published", "village_population_not_published"]


def test_overlay_of_many_areas_broadcasts_no_cells(spark):
    """Areas and cells meet by shuffles whatever their tables' sizes tell, and cells that two sides cross are clipped without Python, as exactly as with it."""
    rng = random.Random(5)
    dots = [(rng.random() * 40, rng.random() * 40) for _ in range(400)]
    areas = [(k, [[(x, y), (x + 9, y + rng.random()), (x + 8, y + 9), (x + rng.random(), y + 8)]]) for k in range(12) for x, y in [(rng.random() * 30, rng.random() * 30)]]
    out = overlay.coverage(spark.createDataFrame(areas, f"k int, rings {RINGS}"), spark.createDataFrame(dots, "x double, y double"), "k", 4.0, "square")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [qx" in line]
    covers = np.array(dots)[:, None] + overlay.outline("square", 4.0)
    for r in out.collect():
        ring = np.array(areas[r.k][1][0], float)
        lines = overlay.sides(ring)
        box = (*ring.min(0), *ring.max(0))
        assert r.covered == pytest.approx(overlay.covered_area(lines, covers, box), abs=1e-6)


def test_the_page_is_a_plan_of_written_parts(spark):
    """The page's own plan reads its parts, not what is behind them."""
    from talweg.plans import registry

    plan = registry.queries()["q18_family_page"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [c for c in ("o_orderkey", "c_custkey", "l_shipdate", "p_partkey") if c in plan]


def test_items_of_a_release_are_made_one_by_one(spark):
    """The write of all items reads written ones, not the plans behind them."""
    from talweg.operators import snapshot

    part = spark.range(3).withColumn("part_of_a_plan", F.col("id") * 2)
    rows = snapshot.items({"KPIS": part}, spark.createDataFrame([(1, 2.0)], "district_id int, x double"), {"a": part}, ["x"])
    assert "part_of_a_plan" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.pk, r.rows) for r in rows.collect()} == {("DISTRICT#1", 1), ("DASHBOARD", 3), ("ANALYSIS#a", 3)}
