"""Units, scraped pages, limitations, strict rollups, keyword rules, fertility statuses: what the registered rows don't show."""

import pytest
from pyspark.sql import functions as F

from talweg.functions import text, units
from talweg.operators import evidence, family, keywords, recipes, sets
from talweg.operators import transforms as X


def test_units_convert_positive_amounts_alone(spark):
    df = spark.createDataFrame([(2.0, "千元"), (0.0, "元"), (-1.0, "元"), (float("nan"), "元"), (None, "元"), (5.0, "億")], "v double, u string")
    rows = df.select(units.price_per_ping(F.col("v")).alias("p"), units.to_wan(F.col("v")).alias("w"), units.from_thousand(F.col("v"), F.col("u")).alias("t")).collect()
    assert [r.t for r in rows] == [2000, None, None, None, None, None] and rows[0].p == pytest.approx(6.61157) and rows[0].w == 0.0002 and all(r.p is None for r in rows[1:5])


def test_listed_links_and_details(spark):
    html = '<title> A &amp; B </title><h1>Top <i>x</i></h1><a class="k" href="/d/1"> One <b>1</b></a><a href="two">2</a><a href="//h/x">3</a><a href="https://o/y">4</a><a href="#here">no</a><a href="/e"></a><article>in <script>no</script>side</article>'
    df = spark.createDataFrame([(html, "https://s.example/a/b?q=1")], "h string, u string").select(text.listed(F.col("h"), F.col("u")).alias("l"), text.detail(F.col("h")).alias("d")).first()
    assert [(x.url, x.title) for x in df.l] == [("https://s.example/d/1", "One 1"), ("https://s.example/a/two", "2"), ("https://h/x", "3"), ("https://o/y", "4")]
    assert (df.d.title, df.d.heading, df.d.body) == ("A &amp; B", "Top x", "in side")


def test_a_unit_that_comes_twice_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 4.0)], "y int, c string, v double")
    assert {r.y: (r.units, r.v) for r in recipes.strict_rollup(df, ["y"], ["y", "c"], ["v"]).collect()} == {1: (2, 5.0), 2: (1, 4.0)}
    with pytest.raises(Exception, match="twice: 1/a"):
        recipes.strict_rollup(df.union(df.limit(1)), ["y"], ["y", "c"], ["v"]).collect()


def test_ordinals_go_on_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.k == r.ordinal for r in sets.ordinals(df, ["k"]).collect())
    assert sets.ordinals(df.limit(0), ["k"]).count() == 0


def test_salaries_need_both_bounds(spark):
    landed = spark.createDataFrame([(0, "100", "200", "district", "1"), (1, "", "200", "county", "1"), (2, "300", "200", "district", "1"), (3, "1", "2", "moon", "1")], "_ord int, `NT_L(x)` string, NT_U string, geo_scope string, JOB_PERSON string")
    got = X.vacancy_salaries(landed)
    assert [(r._ord, r.salary, r.quality_flags) for r in got.accepted.orderBy("_ord").collect()] == [(0, 150.0, []), (1, None, ["incomplete_salary_bounds"])]
    assert {r.reject_reason for r in got.quarantine.collect()} == {"inverted_bounds", "invalid_scope"}


def test_limitations_name_what_is_missing(spark):
    facts = spark.createDataFrame([("a", "d", "eligible", "X", "district"), ("a", "d", "proxy", None, "city"), ("b", "d", "eligible", "Y", "district")], "metric_id string, dataset string, youth_eligibility string, district_name string, geo_level string")
    got = {(r.code, r.subject): r.n for r in evidence.limitations(facts, facts.where("metric_id = 'a'"), ["a", "b", "c"], ["X", "Z"]).collect()}
    assert got == {("evidence_cut", "b"): 1, ("no_evidence", "c"): 0, ("no_district_evidence", "Z"): 0, ("proxy_evidence", ""): 1}


FACTS = "evidence_id string, metric_id string, metric_source string, dataset string, geo_level string, district_id int, district_name string, period_type string, period string, youth_eligibility string"


def some_facts(spark):
    rows = [("e1", "b", "X"), ("e2", "a", "Y"), ("e3", "a", "X"), ("e4", "b", "Y"), ("e5", "c", "X"), ("e6", "b", "X")]
    return spark.createDataFrame([(e, m, "s", "d", "district", None, x, "snapshot", "latest", "proxy" if x == "X" else "eligible") for e, m, x in rows], FACTS)


def test_a_context_takes_comparison_facts_first(spark):
    """Metric a is compared everywhere, a and b are read for X: a fact that both ask for comes once, and the cap cuts b."""
    facts = some_facts(spark)
    taken = lambda cap: [r.evidence_id for r in evidence.assembled(facts, ["a"], ["a", "b"], ["X"], {"s": 1.0}, cap).orderBy("evidence_id").collect()]
    assert (taken(1), taken(2), taken(3), taken(9)) == (["e2"], ["e2", "e3"], ["e1", "e2", "e3"], ["e1", "e2", "e3", "e6"])
    assert evidence.assembled(facts, ["a"], ["a", "b"], ["X"], {"s": 1.0}, 2).columns == facts.columns


def test_limitations_of_an_assembled_context(spark):
    facts = some_facts(spark)
    context = evidence.assembled(facts, ["a"], ["a", "b"], ["X", "Z"], {"s": 1.0}, 3)
    got = {(r.code, r.subject): r.n for r in evidence.limitations(facts, context, ["a", "b", "z"], ["X", "Z"]).collect()}
    assert got == {("evidence_cut", "b"): 2, ("no_evidence", "z"): 0, ("no_district_evidence", "Z"): 0, ("proxy_evidence", ""): 2}


def test_keyword_candidates_by_rule(spark):
    rows = [
        ("listed", 1, 1, 1, 0), ("政策詞", 9, 1, 1, 0), ("軟", 9, 5, 5, 5), ("就業", 4, 1, 1, 0), ("就業", 4, 1, 1, 0), ("xx", 9, 5, 5, 5), ("青年就業輔", 6, 1, 1, 1), ("年就業", 6, 1, 1, 1), ("會議紀錄", 9, 3, 3, 3), ("lone", 9, 9, 0, 0),
    ]
    stats = spark.createDataFrame([(t, tf, j, m, h, 1.0, False, False) for t, tf, j, m, h in dict.fromkeys(rows)], "term string, tf int, join_df int, minutes_df int, topic_df int, support double, resolved boolean, escalated boolean")
    rules = keywords.Rules(listed=("listed",), anchors=("就業",), soft=("軟",), suffixes=("紀錄",))
    names = lambda r: {x.term for x in keywords.candidates(stats, r).collect()}
    assert names(rules) == {"listed", "就業", "青年就業輔"}
    assert names(keywords.Rules(listed=("listed",), anchors=("就業",), soft=("軟",), suffixes=("紀錄",), nested=False)) == {"listed", "就業", "青年就業輔", "年就業"}
    assert names(keywords.Rules(listed=("listed",), anchors=("就業",), soft=("軟",), suffixes=("紀錄",), mode="dynamic")) == {"listed", "軟", "就業", "xx", "青年就業輔"}
    assert len(names(keywords.Rules(mode="dynamic", nested=False))) == 9


def test_fertility_page_statuses(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "district_id int, district_name string")
    annual = spark.createDataFrame([(1, 5.0, 10.0, True), (2, 6.0, None, True)], "district_id int, fertility_rate double, youth_ratio double, complete boolean")
    care = spark.createDataFrame([(1, 10.0, "observed"), (2, 20.0, "observed"), (None, 15.0, "observed")], "district_id int, value double, status string")
    index = spark.createDataFrame([(1, 1.0, 50.0, 100.0), (2, 2.0, 70.0, 200.0), (3, 3.0, 10.0, 150.0)], "district_id int, opportunity_index double, housing double, salary double")
    rows = {r.district_id: r for r in family.page(d, annual, care, index).collect()}
    assert [rows[k].status for k in (1, 2, 3)] == ["observed", "partial", "unavailable"] and rows[1].fafi == pytest.approx(50 / 3) and rows[2].fafi == pytest.approx(90) and rows[3].fafi is None
    assert (rows[1].fafi_level, rows[2].fafi_level, rows[3].fafi_level) == ("low", "high", None)
    city = rows[None]
    assert (city.fafi_status, city.daycare_status, city.status, city.reasons) == ("partial", "observed", "partial", ["fafi_component_missing"]) and city.slope == pytest.approx(1) and city.n == 2
    none = family.page(d, annual.limit(0), care.where("district_id IS NULL").withColumn("status", F.lit("unavailable")), index.limit(0)).where("district_id IS NULL").first()
    assert (none.status, none.fafi_status) == ("unavailable", "unavailable")


def test_trends_need_every_district(spark):
    rows = [(d, y, 7, float(y + d), 0) for y in (2020, 2021, 2023) for d in (1, 2)] + [(1, 2022, 7, 5.0, 0), (2, 2022, 7, None, 0), (2, 2021, 7, 9.0, 1), (9, 2022, 7, 1.0, 0), (1, 2020, 8, 99.0, 0)]
    records = spark.createDataFrame(rows, "district_id int, year int, month int, value double, _ord int")
    got = {r.year: (r.value, r.yoy and round(r.yoy, 4)) for r in family.monthly_trend(records, [2020, 2021, 2022, 2023], spark.createDataFrame([(1,), (2,)], "district_id int")).collect()}
    assert got[2020] == (4043.0, None) and got[2021][0] == 2031.0 and got[2021][1] == pytest.approx((2031 - 4043) / 4043 * 100, abs=1e-3) and got[2022] == (None, None) and got[2023] == (4049.0, None)
