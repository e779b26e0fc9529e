import datetime

import pytest
from pyspark.sql import functions as F

from talweg.operators import transforms as X

REGISTRY = [("D1", "65000010"), ("D2", "65000020")]


def registry(spark):
    return spark.createDataFrame(REGISTRY, "district_id string, code string")


def people(spark, rows):
    ages = [f"people_age_{a:03d}_{s}" for a in range(17, 37) for s in "mf"]
    data = [(i, m, c, s, v, t, *[x] * len(ages)) for i, (m, c, s, v, t, x) in enumerate(rows)]
    return spark.createDataFrame(data, f"_ord int, statistic_yyymm string, district_code string, site_id string, village string, people_total string, {', '.join(f'{a} string' for a in ages)}")


def test_population_bounds_commas_null_poisoning_and_quarantine(spark):
    landed = people(spark, [("11401", "65000010001", "a", "v", "1,000", "2"), ("11401", "65000010002", "b", "w", "5", "1"), ("11401", "65000020001", "c", "x", "7", None), ("11401", "99", "d", "y", "1", "1"), ("114x1", "65000010001", "e", "z", "1", "1")])
    got = X.population(landed, registry(spark))
    values = {(r.district_id, r.metric_id): r.value for r in got.accepted.collect()}
    assert values["D1", "population_total"] == 1005 and values["D1", "youth_male"] == 18 * 3 and values["D1", "youth_total"] == 36 * 3
    assert values["D2", "population_total"] == 7 and values["D2", "youth_total"] is None
    assert sorted((r.input_index, r.reject_reason) for r in got.quarantine.collect()) == [(3, "unmapped_district"), (4, "invalid_period")]
    assert got.quality.first()[:] == (5, 3, 2)


def test_villages_and_nation(spark):
    landed = people(spark, [("11401", "1", "a", "v", "10", "1"), ("11401", "2", "a", "v", "20", "1"), ("11401", "1", "b", "w", "30", None), ("11401", "1", "a", "v", "5", "1"), ("bad", "1", "c", "u", "5", "1")])
    wide = {r.site_id: (r.population_total, r.youth_total) for r in X.village_population(landed).accepted.collect()}
    assert wide == {"a": (15, 72), "b": (30, None)}
    nation = X.national_population(landed).accepted.collect()
    assert [(r.population_total, r.villages, r.quality_flags) for r in nation] == [(40, 2, ["source_rows_rejected"])]


def test_movement_births_marriages(spark):
    m = spark.createDataFrame([(0, "11401", "65000010", "3", "4", "5", None), (1, "11401", "65000020", "1", "1", "1", "1")], "_ord int, statistic_yyymm string, district_code string, in_a_m string, in_a_f string, out_b_m string, out_b_f string")
    assert {r.district_id: (r.moved_in, r.moved_out, r.net) for r in X.movement(m, registry(spark)).accepted.collect()} == {"D1": (7, None, None), "D2": (2, 2, 0)}
    b = spark.createDataFrame([(0, "114", "s", "18歲", "total", "5"), (1, "114", "s", "18歲", "男", "1"), (2, "114", "s", "19歲", "男", "1"), (3, "114", "s", "19歲", "女", "2"), (4, "114", "s", "40歲", "女", "9"), (5, "114", "s", "19歲", "女", "2"), (6, "114", "s", "?", "女", "2")], "_ord int, statistic_yyy string, site_id string, mother_age string, birth_sex string, birth_count string")
    got = X.births(b)
    assert [(r.year, r.births) for r in got.accepted.collect()] == [(2025, 8)]
    assert sorted((r.input_index, r.reject_reason) for r in got.quarantine.collect()) == [(5, "duplicate"), (6, "invalid_age")]
    w = spark.createDataFrame([(0, "11401", "s", "v", "2"), (1, "11402", "s", "v", "3"), (2, "11401", "s", "v", "9")], "_ord int, statistic_yyymm string, site_id string, village string, marry_pair string")
    assert X.marriages(w).accepted.first().pairs == 5


def test_prices_vacancies_wages(spark):
    p = spark.createDataFrame([(0, "1140105", "面議", "30"), (1, None, "12", None), (2, "1140105", None, "x")], "_ord int, date string, rent_total string, area string")
    got = X.priced(p, "rentals", "date", {"rent_total": "TWD", "area": "sqm"})
    rows = {r._ord: r for r in got.accepted.collect()}
    assert rows[0].rent_total is None and rows[0].date == datetime.date(2025, 1, 5) and rows[0].area_unit == "sqm" and rows[1].quality_flags == ["missing_date"]
    assert [r.reject_reason for r in got.quarantine.collect()] == ["no_measure"]
    v = spark.createDataFrame([(0, "2", "30000", "0", "district"), (1, "x", "1", "2", "county"), (2, "1", "30000", "40000", "county"), (3, "1", None, None, None)], "_ord int, `JOB_PERSON（雇用人數）` string, NT_L string, NT_U string, geo_scope string")
    got = X.vacancies(v)
    assert {r._ord: (r.salary, r.salary_estimate, r.geo_level) for r in got.accepted.collect()} == {0: (30000.0, "lower_bound", "district"), 2: (35000.0, "midpoint", "city")}
    w = spark.createDataFrame([(0, "114", "mean", "25-29歲", "400"), (1, "114", "mode", "25-29歲", "1")], "_ord int, year string, method string, age string, wage string")
    got = X.wages(w, {"mean": "wage_mean"})
    assert [(r.metric_id, r.age_min, r.age_max, r.period) for r in got.accepted.collect()] == [("wage_mean", 25, 29, 2025)] and got.quarantine.count() == 1


def test_majors_courses_stops_points(spark):
    key = ["school_code", "major"]
    o = spark.createDataFrame([("1", "a"), ("1", "b")], "school_code string, major string")
    d = spark.createDataFrame([("1", "a", "2"), ("1", "a", "2"), ("1", "a", "3"), ("2", "c", "1")], "school_code string, major string, total string")
    places = spark.createDataFrame([("1", "D1")], "school_code string, district_id string")
    got = {(r.school_code, r.major): (r.total, r.match, r.district_id) for r in X.majors(o, d, places, key, ["total"]).collect()}
    assert got == {("1", "a"): (5, "matched", "D1"), ("1", "b"): (None, "detail_missing", "D1"), ("2", "c"): (1, "overview_missing", None)}
    square = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
    polygons = spark.createDataFrame([("D1", square)], "district_id string, rings array<array<struct<x:double,y:double>>>")
    s = spark.createDataFrame([(0, "5", "5"), (1, "10", "5"), (2, "50", "5"), (3, "x", "5"), (4, "500", "5")], "_ord int, lon string, lat string")
    got = X.stops(s, polygons)
    assert {r._ord: r.district_id for r in got.accepted.collect()} == {0: "D1", 1: "D1", 2: None} and got.quarantine.count() == 2
    pts = [("p", "121.5", "25.0", None, None, "matched"), ("q", None, None, None, None, None), ("r", "121.5", "25.0", None, None, "guessed"), ("s", None, None, "300000", "2700000", "matched")]
    pts = spark.createDataFrame(pts, "point_id string, longitude string, latitude string, x_3826 string, y_3826 string, geocode_status string")
    over = spark.createDataFrame([(0, "q", 1.0, 2.0), (1, "q", 121.0, 24.0)], "_ord int, point_id string, longitude double, latitude double")
    got = {r.point_id: r for r in X.service_points(pts, over).collect()}
    assert [got[k].geocode_status for k in "pqrs"] == ["matched", "matched", "excluded_no_verified_coordinate", "matched"]
    assert abs(got["q"].x_3826 - 250000) < 1e-6 and abs(got["s"].longitude - 121.4930) < 1e-3 and abs(got["s"].latitude - 24.4053) < 1e-3
    from talweg.functions.geo import tm2, tm2_inverse

    x, y = tm2(F.col("id") / 40.0 + 119.5, F.col("id") / 30.0 + 21.8)
    back = spark.range(100).select("id", *(c.alias(n) for n, c in zip("xy", (x, y)))).select("id", *(c.alias(n) for n, c in zip(("lon", "lat"), tm2_inverse(F.col("x"), F.col("y"))))).collect()
    assert all(abs(r.lon - r.id / 40 - 119.5) < 1e-8 and abs(r.lat - r.id / 30 - 21.8) < 1e-8 for r in back)


def test_elections_boundaries_budgets(spark):
    e = spark.createDataFrame([(0, "V1", "D1", "*", "Y", "1980/02/29", "2023-02-28", "9"), (1, "V1", None, None, None, "0650101", "2023-02-28", None), (2, "T1", None, None, None, "bad", "2023-02-28", "30")], "_ord int, election_type string, district_id string, mark string, held string, birth string, election_date string, age string")
    got = X.candidates(e)
    rows = {r._ord: r for r in got.accepted.collect()}
    assert rows[0].elected and rows[0].incumbent and rows[0].age == 42 and rows[2].age == 30 and rows[2].warnings == ["invalid_birth_date"]
    assert [r.reject_reason for r in got.quarantine.collect()] == ["missing_district"]
    b = spark.createDataFrame([(0, "65001", "Polygon"), (1, "65001", "Polygon"), (2, "63001", "Polygon"), (3, "65002", "Point")], "_ord int, code string, type string")
    assert sorted((r.input_index, r.reject_reason) for r in X.boundaries(b, ["65"]).quarantine.collect()) == [(1, "duplicate"), (2, "other_city"), (3, "not_a_polygon")]
    g = spark.createDataFrame([(0, "114", "plan", "p", None, "1,000", "千元", "-5"), (1, "114", "plan", "-", None, "1", "元", None), (2, "114", "allocation", "p", "05", "1", "元", None), (3, "114", "plan", "p", None, "1", "元", "+-5"), (4, "114", "plan", "p", None, "1", "?", None)], "_ord int, budget_year_roc string, row_type string, work_plan string, allocation_code string, budget_amount string, unit_label string, surplus_amount string")
    got = X.budgets(g)
    assert [(r.amount, r.surplus) for r in got.accepted.collect()] == [(1_000_000.0, -5000.0)]
    assert sorted((r.input_index, r.reject_reason) for r in got.quarantine.collect()) == [(1, "missing_plan"), (2, "missing_code"), (3, "invalid_surplus"), (4, "unknown_unit")]


def test_grants_proposals_minutes(spark):
    g = spark.createDataFrame([("114", "in Banqiao", "Xindian road", "n", 6), ("114", None, None, "Xindian club", 12), ("114", None, None, "x", None)], "year_roc string, project_location string, recipient_address string, recipient_name string, coverage_end_month int")
    got = [(r.district_name, r.geo_basis, r.coverage_scope) for r in X.grants(g, ["Banqiao", "Xindian"]).collect()]
    assert got == [("Banqiao", "project_location", "year_to_date"), ("Xindian", "recipient_name", "full_year"), (None, None, None)]
    p = spark.createDataFrame([(0, "1", "youth housing", "c", "k", "labour", "1,200", "114.05.01"), (1, None, "t", "c", "k", None, None, "2020"), (2, "3", "t", "c", "k", None, None, "never")], "_ord int, proposal_id string, title string, content string, category string, agency string, endorsement_count string, submitted_at string")
    got = X.proposals(p, ["labour"], ["youth"])
    assert [(r.year, r.endorsements, r.proxy_reasons) for r in got.accepted.collect()] == [(2025, 1200, ["agency:labour", "keyword:youth"])]
    assert sorted(r.reject_reason for r in got.quarantine.collect()) == ["missing_id", "missing_year"]
    m = spark.createDataFrame([("m", ["壹、報告\n前言\n一、第一案\n說明文字", "續行\n決議：同意列管\n二、第二案\n貳、臨時動議\n無關\n一、第三案\n裁示：知悉"])], "meeting_id string, page_texts array<string>")
    got = [(r.section, r.title, r.body, r.resolution, r.needs_review, r.escalated) for r in X.minutes_items(m).orderBy("item").collect()]
    assert got == [("報告", "第一案", "說明文字\n續行", "決議：同意列管", False, True), ("報告", "第二案", "", "", True, False), ("臨時動議", "第三案", "", "裁示：知悉", False, False)]


def test_dispatch():
    assert X.transform_for("moving_in") is X.movement and X.transform_for("rentals") is X.priced
    with pytest.raises(KeyError):
        X.transform_for("nothing")
