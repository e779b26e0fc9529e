import datetime
import io
import math
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talweg.functions import geo, nulls, parsing, text
from talweg.operators import evidence, joins, keywords, planner, quality, series, sets, stats


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_nulls(spark):
    n = F.lit(None).cast("double")
    assert one(spark, nulls.finite(F.lit(float("nan")))) is None and one(spark, nulls.finite(F.lit(float("-inf")))) is None and one(spark, nulls.finite(F.lit(2))) == 2
    assert one(spark, nulls.yoy(F.lit(55.0), F.lit(50.0))) == pytest.approx(10) and one(spark, nulls.yoy(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, nulls.weighted_available([(F.lit(80.0), 0.75), (F.lit(40.0), 0.25)])) == 70 and one(spark, nulls.weighted_available([(n, 0.5), (F.lit(3.0), 0.5)])) == 3
    assert one(spark, nulls.weighted_available([(n, 1.0)])) is None and one(spark, nulls.weighted_complete([(n, 0.5), (F.lit(3.0), 0.5)])) is None


def test_parsing(spark):
    rows = [("1,000", 1000), ("+5", 5), ("-5", None), ("1.5", None), ("", None), (None, None), (" 7 ", 7)]
    df = spark.createDataFrame(rows, "s string, want long")
    assert all(r.got == r.want for r in df.select("want", parsing.parse_int(F.col("s")).alias("got")).collect())
    for s, want in [("NaN", None), ("Infinity", None), ("-1", None), ("1,234.5", 1234.5), ("x", None)]:
        assert one(spark, parsing.parse_decimal(F.lit(s))) == want
    assert one(spark, parsing.roc_date(F.lit("1140229"))) is None and one(spark, parsing.roc_date(F.lit("1130229"))) == datetime.date(2024, 2, 29) and one(spark, parsing.roc_date(F.lit("113229"))) is None
    assert one(spark, parsing.roc_month(F.lit("11413"))) is None and one(spark, parsing.to_roc_month(F.lit("2025-03-09").cast("date"))) == "11403"
    assert one(spark, parsing.clean_text(F.lit("ＡＢ　１"), unicode_form=True)) == "AB 1" and one(spark, parsing.clean_text(F.lit(" 面議 "))) is None
    assert one(spark, parsing.age_on(F.lit("2004-02-29").cast("date"), F.lit("2023-02-28").cast("date"))) == 18
    assert [one(spark, parsing.free_year(F.lit(s))) for s in ("1140501", "114.05", "於112年", "2020-01", "none")] == [2025, 2025, 2023, 2020, None]
    assert one(spark, parsing.first_of(F.create_map(F.lit("﻿Name"), F.lit("x")), "other", "NAME")) == "x"
    a, b = (spark.createDataFrame([(1, "x")], s).select(parsing.stable_id("d", "i", "s").alias("k")).first().k for s in ("i int, s string", "i int, s string"))
    assert a == b and a.startswith("d:") and len(a) == 18


def test_stats_degenerate_cases(spark):
    xy = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (None, 1.0), (float("nan"), 2.0), (4.0, float("inf"))], "x double, y double")
    o = stats.ols(F.col("y"), F.col("x"))
    r = xy.agg(*(v.alias(k) for k, v in o.items())).first()
    assert (r.n, r.slope, r.intercept, r.r2) == (3, 2, 1, 1)
    for rows in ([(1.0, 2.0)], [(1.0, 2.0), (1.0, 3.0)]):
        r = spark.createDataFrame(rows, "x double, y double").agg(*(v.alias(k) for k, v in o.items())).first()
        assert r.slope is None and r.r2 is None
    r = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double").agg(*(v.alias(k) for k, v in o.items())).first()
    assert r.slope == 0 and r.r2 is None
    v = spark.createDataFrame([(k, float(k) if k < 101 else None) for k in range(102)], "k int, v double")
    got = {r.k: r for r in stats.minmax(v.withColumn("c", F.lit(1.0)), {"up": ("v", False), "down": ("v", True), "flat": ("c", False)}).collect()}
    assert got[1].up == 1 and got[1].down == 99 and got[7].flat == 50 and got[101].up is None
    clip = {r.k: r.s for r in stats.minmax(v, {"s": ("v", False)}, 0.05, 0.95).collect()}
    assert clip[0] == 0 and clip[100] == 100 and clip[101] is None
    levels = stats.quartile_level(spark.createDataFrame([(float(i),) for i in range(1, 5)], "s double"), "s").orderBy("s").collect()
    assert [r.level for r in levels] == ["high", "medium", "medium", "low"]
    e = spark.createDataFrame([("a", "x")] * 10 + [("b", "x"), ("b", None)], "k string, c string")
    assert {r.k: r.entropy for r in stats.entropy(e, ["k"], "c").collect()} == {"a": 0, "b": 1}


def test_series(spark):
    df = spark.createDataFrame([("a", 2020, 50.0), ("a", 2021, 55.0), ("a", 2023, 60.0), ("a", 2024, None)], "k string, y int, v double")
    assert [r.yoy for r in series.change(df, ["k"], "y", "v").orderBy("y").collect()] == [None, pytest.approx(10), None, None]
    assert [r.yoy and round(r.yoy, 3) for r in series.change(df, ["k"], "y", "v", bridge=True).orderBy("y").collect()] == [None, 10, 9.091, None]
    assert [r.v for r in series.gap_filled(df, ["k"], "y", "v").orderBy("y").collect()] == [50, 55, None, 60, None]
    t = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y")], "k string, p int, o int, v string")
    assert series.latest(t, ["k"], "p", F.col("o")).first().v == "y" and series.latest(t, ["k"], "p", F.col("o"), last_wins=False).first().v == "x"
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, n int").withColumn("t", F.timestamp_seconds("n").cast("timestamp_ntz"))
    right = spark.createDataFrame([("a", 2, 1.0, 1), ("a", 5, 2.0, 2), ("a", 5, 3.0, 3), ("a", 9, 4.0, 4)], "k string, n int, v double, i long").withColumn("t", F.timestamp_seconds("n").cast("timestamp_ntz"))
    assert {(r.k, r.n): r.v for r in series.as_of(left, right, "k", "t", "t", "v", "i").collect()} == {("a", 5): 3.0, ("a", 1): None, ("b", 3): None}


def test_quality_and_header(spark):
    df = spark.createDataFrame([(0, 1, "a"), (1, None, "b"), (2, -1, None)], "_ord int, n int, s string")
    got = quality.split(df, {"missing": F.col("n").isNull(), "negative": F.col("n") < 0}, "_ord")
    assert got.quality.first()[:] == (3, 1, 2) and {r.reject_reason for r in got.quarantine.collect()} == {"missing", "negative"} and got.accepted.columns == df.columns
    marked, seen = quality.observed(quality.reasoned(df, {"missing": F.col("n").isNull()}), "q")
    assert marked.count() == 3 and seen.get == {"input_rows": 3, "quarantined_rows": 1}
    good = ("district", "youth_18_35", 18, 35, "eligible", "2024-01-01", "2024-12-31")
    bad = [("planet", *good[1:]), (*good[:4], "context", *good[5:]), (*good[:2], None, *good[3:]), (good[0], good[1], 20, *good[3:]), (*good[:5], "2025-01-01", good[6])]
    h = spark.createDataFrame([good, *bad], "geo_level string, age_scope string, age_min int, age_max int, youth_eligibility string, period_start string, period_end string")
    assert sorted(r.reject_reason for r in quality.header_violations(h).collect()) == ["age_bounds", "geo_level", "period", "youth_bounds", "youth_eligibility"]


def test_joins(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert {r.k: r.v for r in joins.lookup(a, b, ["k"]).collect()} == {1: "x", 2: "y", 3: None}
    with pytest.raises(Exception, match="ambiguous"):
        joins.lookup(a, b.union(b), ["k"]).collect()
    c = spark.createDataFrame([("a", 0.0, 0.0)] * 2 + [("b", 0.0, 0.0), ("b", 100.0, 0.0), ("c", 0.0, 0.0), ("c", 900.0, 0.0)] + [("d", 0.0, 0.0)] * 5 + [("d", 900.0, 0.0), ("d", 0.0, 900.0)], "k string, x double, y double")
    assert {r.k: (r.how, r.x) for r in joins.collapsed(c, "k").collect()} == {"a": ("single", 0), "b": ("centroid", 50), "c": (None, None), "d": ("dominant", 0)}
    requests = spark.createDataFrame([("r", 0, "strict"), ("r", 1, "loose"), ("s", 1, "loose"), ("t", 0, "none")], "request string, tier int, key string")
    keys = spark.createDataFrame([("strict", 0.0, 0.0), ("strict", 999.0, 0.0), ("loose", 5.0, 5.0)], "key string, x double, y double")
    assert {r.request: (r.tier, r.how) for r in joins.tiered(requests, keys, "request").collect()} == {"r": (1, "single"), "s": (1, "single")}


def test_geometry(spark):
    hole = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]]
    areas = spark.createDataFrame([("a", hole), ("b", [[(9.0, 0.0), (20.0, 0.0), (20.0, 10.0), (9.0, 10.0)]])], "region string, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0, 5.0), (2, 9.5, 5.0), (3, 0.0, 5.0), (4, 4.0, 5.0), (5, 50.0, 5.0), (6, 15.0, 10.0)], "k int, x double, y double")
    assert {r.k: r.region for r in joins.located(pts, areas, "k", "region").collect()} == {0: "a", 1: None, 2: None, 3: "a", 4: "a", 5: None, 6: "b"}
    assert [r.a for r in areas.orderBy("region").select(geo.polygon_area(F.col("rings")).alias("a")).collect()] == [96, 110]
    x, y = geo.tm2(F.lit(121.0), F.lit(0.0))
    assert (one(spark, x), one(spark, y)) == (pytest.approx(250000), pytest.approx(0, abs=1e-9))
    # Independent check: the meridian arc by numeric integration, and the central scale to the east.
    lat, e2 = math.radians(25.0), geo.FLATTENING * (2 - geo.FLATTENING)
    steps = 20000
    arc = sum(geo.A * (1 - e2) / (1 - e2 * math.sin((k + 0.5) * lat / steps) ** 2) ** 1.5 for k in range(steps)) * lat / steps
    assert one(spark, geo.tm2(F.lit(121.0), F.lit(25.0))[1]) == pytest.approx(geo.K0 * arc, abs=1e-3)
    assert one(spark, geo.tm2(F.lit(121.5), F.lit(25.0))[0]) - 250000 == pytest.approx(250000 - one(spark, geo.tm2(F.lit(120.5), F.lit(25.0))[0]), abs=1e-6)


@settings(max_examples=200, database=None, derandomize=True)
@given(st.dictionaries(st.sampled_from("abcd"), st.integers(0, 300)), st.integers(0, 400))
def test_quotas(counts, cap):
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    counts = {g: n for g, n in counts.items() if g in shares}
    take = sets.quotas(counts, shares, cap)
    assert all(take.get(g, 0) <= n for g, n in counts.items())
    assert sum(take.values()) == min(cap, sum(counts.values()))
    for g, s in shares.items():
        assert take.get(g, 0) >= min(counts.get(g, 0), int(cap * s)) or sum(counts.values()) <= cap


def test_sets_and_evidence(spark):
    with pytest.raises(ValueError):
        sets.union_all([])
    ev = spark.createDataFrame([("g", i, float(i % 3)) for i in range(10)], "g string, i int, v double")
    assert [r.i for r in sets.limited(ev, "g", [F.desc("v"), F.asc("i")], 2).orderBy("rank").collect()] == [2, 5]
    assert [r.i for r in sets.first_wins(ev, ["v"], "i").orderBy("i").collect()] == [0, 1, 2]
    bad = spark.createDataFrame([([{"raw_record": "x"}],)], "a array<struct<raw_record:string>>")
    with pytest.raises(ValueError):
        evidence.public(bad)
    p = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "x"}]}, "note": 5, "d": null}'), (2, "not json"), (3, None)], "k int, body string")
    assert sorted(map(tuple, evidence.flatten(p, "body", "k").collect())) == [(1, "a.b.0", "1"), (1, "a.b.1.c", "x")]
    f = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    same = evidence.fingerprint(f.orderBy(F.desc("k")), "k", "v").first()[0]
    assert same == evidence.fingerprint(f, "k", "v").first()[0] != evidence.fingerprint(f.fillna(0.0), "k", "v").first()[0]


def test_text_and_keywords(spark):
    df = spark.createDataFrame([(1, "Visit https://a.b/c or a@b.co on 2024-01-02, call +886 2 1234 5678")], "k int, t string")
    clean, n = text.scrub(F.col("t"))
    r = df.select(clean.alias("c"), *(v.alias(k) for k, v in n.items())).first()
    assert (r.url, r.email) == (1, 1)
    assert "@" not in r.c and "http" not in r.c and not any(c.isdigit() for c in r.c)
    assert one(spark, text.label_match(F.lit("青年 住宅!"), ["青年住宅"])) and not one(spark, text.label_match(F.lit("青年 住宅 x"), ["青年住宅"], ["x"]))
    assert one(spark, text.ngrams(F.lit("ab"), 3)) == [] and one(spark, text.kept_tokens(F.array(F.lit("a"), F.lit("the"), F.lit("word"), F.lit("12")), ["the"], ["the"])) == ["the", "word"]
    d = spark.createDataFrame([("p1", "alpha beta alpha", "join", 3), ("p2", "alpha gamma", "join", 5)], "id string, t string, s string, e int")
    got = {r.term: r for r in keywords.term_stats(d, "id", F.col("t"), "s", F.col("e")).collect()}
    assert got["alpha"].tf == 3 and got["alpha"].df == 2 and got["alpha"].support == pytest.approx(2 + math.log(4) + math.log(6))


def test_planner(spark):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    assert [one(spark, planner.due(F.lit(e), at(s), now)) for e, s in (("daily", "2024-02-29 01:00:00"), ("daily", "2024-02-28 00:00:00"), ("monthly", "2024-02-29 23:00:00"), ("weekly", None), ("other", "2024-03-01 00:00:00"))] == [False, True, True, True, True]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError from TimeoutError()
        return "done"

    assert planner.with_retry(flaky, wait=0) == "done"
    with pytest.raises(ValueError):
        planner.with_retry(lambda: (_ for _ in ()).throw(ValueError()), wait=0)
    with pytest.raises(ValueError):
        planner.selected({"a": ["x"], "b": ["x"]}, "a")


def test_sources(spark, tmp_path):
    from talweg.sources import tables

    root = str(tmp_path / "curated")
    for key in ("11401", "11402", "latest"):
        tables.write_partitions(spark.createDataFrame([("d", key, 1, "x")], "dataset string, output_key string, v int, w string"), root)
    tables.write_partitions(spark.createDataFrame([("d", "11401", 9, "y")], "dataset string, output_key string, v int, w string"), root)
    c = tables.Curated(spark, root)
    assert c.period("d", "11401").first().v == 9 and c.available("d", ["11402", "99999"]).count() == 1 and c.latest("d").first().v == 1 and c.everything("d").count() == 3
    with pytest.raises(FileNotFoundError):
        c.periods("d", ["11401", "99999"])
    with pytest.raises(FileNotFoundError):
        c.available("d", ["99999"])
    (tmp_path / "raw.json").write_text('{"fetched_at": "2024", "records": [{"a": 1}, {"a": 2}]}')
    assert [(r._ord, r.fetched_at) for r in tables.read_json_records(spark, str(tmp_path / "raw.json")).orderBy("_ord").collect()] == [(0, "2024"), (1, "2024")]
    (tmp_path / "big5.csv").write_bytes("名稱,值\n臺北,1\n".encode("cp950"))
    assert tables.read_csv(spark, str(tmp_path / "big5.csv"), ["名稱"]).first()["名稱"] == "臺北"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x/a.csv", "k\n1\n")
        z.writestr("b.txt", "no")
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    got = tables.read_zip(spark, str(tmp_path / "a.zip"), r"\.csv$").collect()
    assert [(r.member, bytes(r.content)) for r in got] == [("x/a.csv", b"k\n1\n")]
    listing = spark.createDataFrame([("g", "p/20240101T000000Z.json", "2020-01-01"), ("g", "p/20250101T000000Z.json", "2019-01-01")], "g string, path string, modified string")
    assert tables.newest(listing, "g").first().path == "p/20250101T000000Z.json"
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c")]))
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]
    tables.publish({"t": old}, str(tmp_path / "pub"), "s1")
    tables.publish({"t": new}, str(tmp_path / "pub"), "s2", candidate=True)
    assert tables.read_published(spark, str(tmp_path / "pub"), "t").count() == 2
    b = spark.createDataFrame([(b"x", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), (b"y", "00")], "content binary, sha string")
    good = spark.createDataFrame(b.take(1), b.schema)
    assert tables.verified_binary(good, "content", "sha").count() == 1
    with pytest.raises(Exception, match="hash"):
        tables.verified_binary(b, "content", "sha").collect()


def test_streaming_equals_batch(spark, tmp_path):
    from talweg.streaming import windows

    rows = [(i, f"2024-01-01 0{i % 5}:{i % 60:02d}:00", i % 3, float(i)) for i in range(60)] + [(999, "2024-01-02 12:00:00", 0, 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id int, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    s = windows.tumbling(windows.events_stream(spark, str(tmp_path / "in"), df.schema), "1 hour", "user_id")
    windows.run_available(s, str(tmp_path / "out"), str(tmp_path / "check"))
    batch = windows.tumbling(df.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "user_id")
    closed = sorted(map(tuple, batch.where("window_start < '2024-01-02'").collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == closed
    windows.run_available(windows.distinct_events(windows.events_stream(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "out2"), str(tmp_path / "check2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 61


def test_a_scrubbed_text_is_made_once(spark):
    from talweg.functions import text as T

    words = T.kept_tokens(T.mixed_tokens(T.scrub(F.col("c"), T.ROLES)[0], ["licensed", "社會住宅"]), ["the"])
    df = spark.createDataFrame([("the Licensed 青年就業 a@b.cd",), (None,)], "c string")
    assert df.select(words.alias("w"))._jdf.queryExecution().optimizedPlan().toString().count("https?") == 1
    assert [r.w for r in df.select(words.alias("w")).collect()] == [["licensed", "青年", "年就", "就業", "青年就", "年就業", "青年就業", "licensed"], None]


def test_the_quick_email_finds_what_the_plain_one_does(spark):
    from talweg.functions import text as T

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab@@..._ -%") for _ in range(rng.randrange(30))) for _ in range(4000)] + ["a@b.c_x@y.z", "a@b.c@d.e", "a" * 50_000]
    df = spark.createDataFrame([(x,) for x in texts], "c string")
    assert df.where(F.regexp_replace("c", T.QUICK["email"], "!") != F.regexp_replace("c", T.SCRUBS["email"], "!")).count() == 0


def test_a_part_of_a_second_short_is_not_due(spark):
    df = spark.sql("SELECT timestamp'2024-01-20 00:00:00' AS now, t FROM VALUES (timestamp'2024-01-19 00:00:00'), (timestamp'2024-01-19 00:00:00.000001') v(t)")
    assert [r[0] for r in df.select(planner.due(F.lit("daily"), F.col("t"), F.col("now"))).collect()] == [True, False]


def test_first_rows_of_a_group_come_from_its_parts(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 20_011).alias("rank"))
    out = sets.limited(df, "g", [F.asc("rank")], 1500).select(F.col("rank").alias("place"), "group_rows", "truncated")
    assert "__share" in out._jdf.queryExecution().analyzed().toString()
    assert [r.place for r in out.orderBy("place").collect()] == list(range(1, 1501)) and out.where("group_rows = 20000 AND truncated").count() == 1500
    values = sets.limited(df.withColumnRenamed("rank", "v"), "g", [F.asc("v")], 1500).agg(F.count("*"), F.countDistinct("v"), F.max("rank")).first()
    assert tuple(values) == (1500, 1500, 1500)


def test_first_rows_may_be_ordered_by_a_column_named_like_a_helper(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), (999 - F.col("id")).alias("__rank"), F.col("id").alias("__SHARE"))
    quota = sets.quota_top(df, "g", [F.asc("__rank")], {"g": 1.0}, 3)
    cut = sets.limited(df, "g", [F.asc("__SHARE")], 2)
    assert quota.columns == ["g", "__rank", "__SHARE", "rank"]
    assert sorted((r["rank"], r["__rank"], r["__SHARE"]) for r in quota.collect()) == [(1, 0, 999), (2, 1, 998), (3, 2, 997)]
    assert sorted((r["rank"], r["__rank"], r["__SHARE"], r["group_rows"]) for r in cut.collect()) == [(1, 999, 0, 1000), (2, 998, 1, 1000)]
    # No rows, no quotas.
    assert sets.quota_top(df.where("false"), "g", [F.asc("__rank")], {"g": 1.0}, 3).count() == 0


def test_a_key_is_resolved_once_for_all_its_requests(spark):
    """Requests and places that share one key aren't paired."""
    requests = spark.range(100_000).select(F.col("id").alias("request"), F.lit(0).alias("tier"), F.lit("k").alias("key"))
    keys = spark.range(50_000).select(F.lit("k").alias("key"), (F.col("id") % 100).cast("double").alias("x"), F.lit(0.0).alias("y"))
    assert joins.tiered(requests, keys, "request").groupBy("tier", "how").count().collect() == [(0, "centroid", 100_000)]


def test_policy_terms_cut_a_text_once(spark):
    """Token lists aren't made again for each token, nor term counts for each reader."""
    docs = spark.createDataFrame([("join", "rent rent subsidy", "rent", None, False, 3), ("minutes", "rent vote", None, "rent", True, None)], "kind string, text string, topic string, resolution string, escalated boolean, endorsements int")
    rules = keywords.Rules(min_df=1, min_frequency=1)
    counts = keywords.mentions(docs, rules)
    # The three lists, each with one scrub.
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("https?") == 3
    assert {r.term: (r.tf, r.join_df, r.minutes_df, r.topic_df, r.resolved, r.escalated) for r in counts.collect()} == {"rent": (3, 1, 1, 1, True, True), "subsidy": (1, 1, 0, 0, False, False), "vote": (1, 0, 1, 0, False, False)}
    assert "https?" not in keywords.policy_ranking(docs, rules)._jdf.queryExecution().optimizedPlan().toString()
