"""Inputs that count themselves, and releases that a crash can't spoil."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from talweg.operators import homepage, opportunity, recipes, snapshot


def missing():
    raise FileNotFoundError("training: no period is published")


def test_inputs_are_counted_by_the_write_that_reads_them(spark, tmp_path):
    inputs = homepage.Inputs(spark)
    rows = spark.createDataFrame([(1, 5.0, True), (None, 6.0, True), (2, None, False)], "district_id int, v double, ok boolean")
    a = inputs.add("jobs", lambda: rows, "district_id int, v double, ok boolean", "v IS NOT NULL", "ok")
    empty = inputs.add("rents", lambda: rows.where("v > 99"), "district_id int, v double")
    lost = inputs.add("training", missing, "district_id int, people double")
    done = Observation("done")
    # The same input in two places counts once.
    both = a.select("district_id", "v").unionByName(a.select("district_id", F.lit(0.0).alias("v"))).unionByName(empty).unionByName(lost.withColumnRenamed("people", "v"))
    both.observe(done, F.count(F.lit(1)).alias("facts")).write.parquet(str(tmp_path / "out"))
    got = {(s, k, f): (v, n) for s, k, f, v, n in inputs.quality(done)}
    assert [got["input", "jobs", c][0] for c in homepage.COUNTS] == [3, 1, 2, 2] and got["excluded", "jobs", "excluded_rows"][0] == 1
    assert [got["input", "rents", c][0] for c in homepage.COUNTS] == [0, 0, 0, 0]
    assert got["input", "training", "total_rows"] == (0.0, "unavailable: training: no period is published")


def test_every_stand_in_is_a_fact_of_its_district(spark):
    made = spark.createDataFrame([(1, "a", *[1.0] * 19, ["rent", "courses"]), (2, "b", *[2.0] * 18, None, [])], "district_id int, district_name string, " + ", ".join(f"{c} double" for c in opportunity.FEATURES) + ", proxies array<string>")
    own, stand_ins = homepage.districts(opportunity.index(made), {"seats": (spark.createDataFrame([(2, 7)], "district_id int, n int"), "n")})
    assert sorted((r.section, r.key, r.field, r.note) for r in stand_ins.collect()) == [("proxy", "1", "courses", "imputed_minimum"), ("proxy", "1", "rent", "city_minimum_rent"), ("unavailable", "2", "bike_density", "missing_input")]
    facts = {(r.key, r.field): r.value for r in own.collect()}
    assert facts["2", "seats"] == 7 and facts["1", "seats"] is None and facts["2", "bike_density"] is None and len(facts) == 2 * (19 + 5 + 1 + 1 + 3)


def test_orchestrated_figures_and_blocking(spark):
    inputs = homepage.Inputs(spark)
    people = inputs.add("population", lambda: spark.createDataFrame([(2023, 90, 30, "2023-12-01"), (2024, 100, 33, "2024-12-01")], "year int, people long, youth long, period string"), "year int, people long, youth long, period string", place=None)
    made = spark.createDataFrame([(1, "a", *[1.0] * 19, [])], "district_id int, district_name string, " + ", ".join(f"{c} double" for c in opportunity.FEATURES) + ", proxies array<string>")
    figures = recipes.key_figures(people, spark.createDataFrame([("2024-12-01", 5e6, None)], "period_start string, value double, quality_flags array<string>"), 2024)
    wage = spark.createDataFrame([(None, "unavailable")], "latest_wage double, quality string")
    policy = spark.createDataFrame([(1.0, None, None, None, "no settlement")], "current_budget double, budget_yoy double, execution_rate double, execution_year int, execution_failure string")
    points = spark.createDataFrame([(2024, 1.0, None, "legal_budget", "observed")], "year int, amount double, yoy double, document_status string, status string")
    blocking = spark.createDataFrame([("unavailable", ["no_verified_service_points"])], "status string, reasons array<string>")
    got = homepage.orchestrated(inputs, opportunity.index(made), {}, figures, wage, spark.createDataFrame([(2.5,)], "talent_demand_yoy double"), policy, points, blocking).collect()
    facts = {(r.section, r.key, r.field): (r.value, r.note) for r in got}
    assert facts["kpi", "", "city_yoy"][0] == pytest.approx(10) and facts["kpi", "", "national_quality"][1] == "observed" and ("proxy", "", "national_youth") not in facts
    assert facts["proxy", "", "adjusted_youth_wage"][1] == "unavailable" and facts["blocking", "", "service_coverage"][1] == "no_verified_service_points"
    assert facts["input", "population", "total_rows"][0] == 2 and facts["budget", "2024", "status"][1] == "observed"


def release(spark, root, name, districts, monkeypatch=None, **more):
    one = spark.createDataFrame([(1,)], "v int")
    return snapshot.publish(spark, root, name, dict.fromkeys(snapshot.BLOCKS, one), districts, dict.fromkeys(snapshot.ANALYSES, one.limit(0)), ["index", "rent"], 2, **more)


def test_a_release_and_its_manifest(spark, tmp_path):
    root = str(tmp_path)
    districts = spark.createDataFrame([(1, 5.0, None), (2, 6.0, None)], "district_id int, index double, rent double")
    got = release(spark, root, "s1", districts)
    assert got.manifest["availability"] == {"index": "available", "rent": "unavailable"} and got.manifest["coverage"]["ratio"] == 1 and got.manifest["filled_items"] == 7
    rows = snapshot.read(spark, root).collect()
    assert len(rows) == 7 + 2 + 6 + 1 and {r.body for r in rows if r.pk.startswith("ANALYSIS")} == {"[]"}
    assert json.loads(next(r.body for r in rows if r.pk == "MANIFEST")) == got.manifest
    assert json.loads(next(r.body for r in rows if r.pk == "DISTRICT#2")) == {"district_id": 2, "index": 6.0, "rent": None}


def test_what_ends_early_leaves_the_last_release(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    districts = spark.createDataFrame([(1, 5.0, 1.0), (2, 6.0, 1.0)], "district_id int, index double, rent double")
    release(spark, root, "s1", districts)
    # Too few districts; a crash while items are written; one between the manifest and the pointer; a candidate.
    with pytest.raises(snapshot.Incomplete, match="district_items: 1 of 2"):
        release(spark, root, "s2", districts.limit(1))
    failing = districts.withColumn("index", F.when(F.col("district_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("index")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        release(spark, root, "s3", failing)
    with monkeypatch.context() as m:
        m.setattr(snapshot, "point", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            release(spark, root, "s4", districts)
    release(spark, root, "s5", districts, candidate=True)
    assert snapshot.current(spark, root) == "s1" and snapshot.read(spark, root).count() == 16
    release(spark, root, "s4", districts)
    assert snapshot.current(spark, root) == "s4" and snapshot.read(spark, root, "s5").count() == 16
    with pytest.raises(ValueError, match="raw"):
        release(spark, root, "s6", districts.withColumn("raw_record", F.lit("x")))
