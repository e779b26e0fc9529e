import datetime
import random

import pytest
from pyspark.sql import functions as F

from talweg.streaming import units, windows

START = datetime.datetime(2024, 1, 1)


def reports(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        at = START + datetime.timedelta(hours=rng.randint(0, 24 * 120))
        rows.append((f"u{rng.randint(0, 7)}", at, rng.choice(["daily", "weekly", "monthly", None]), rng.choice(["ok", "no_data", "transform_failed", "failed"]), rng.random() < 0.5, rng.random() < 0.5))
    return list({(r[0], r[1]): r for r in rows}.values())


def plain(rows, keep, until):
    """One unit after the other, one report after the other."""
    out = []
    for unit in {r[0] for r in rows}:
        state = None
        own = sorted(r for r in rows if r[0] == unit and r[1] <= until)
        for k, r in enumerate(own):
            gone = state and state[1] + datetime.timedelta(days=keep)
            if state and gone < r[1]:
                state = None
            status, output, raw = (state[3], state[4], state[5]) if state else (None, False, False)
            action = "reuse_output" if output and status == "ok" else "reuse_raw" if raw and status in ("ok", "transform_failed") else "keep_no_data" if status == "no_data" else "download"
            out.append((unit, r[1], "report", action))
            state, after = r, own[k + 1][1] if k + 1 < len(own) else datetime.datetime.max
            due = {"daily": r[1] + datetime.timedelta(days=1), "weekly": r[1] + datetime.timedelta(days=7), "monthly": (r[1].replace(day=1, hour=0) + datetime.timedelta(days=32)).replace(day=1)}.get(r[2])
            gone = r[1] + datetime.timedelta(days=keep)
            if due and due < after and due <= until and due < gone:
                out.append((unit, due, "due", None))
            if gone < after and gone <= until:
                out.append((unit, gone, "gone", None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.unit, r.at.replace(tzinfo=None), r.kind, r.action) for r in df.collect()), key=repr)


def test_batch_against_a_plain_walk(spark):
    until = START + datetime.timedelta(days=100)
    got = units.batch(spark.createDataFrame(reports(1), units.REPORT), 20, F.lit(until))
    assert rows_of(got) == plain(reports(1), 20, until)


def test_stream_equals_batch_whatever_the_order(spark, tmp_path):
    rows = reports(2, 80)
    late = ("u1", START + datetime.timedelta(hours=1, minutes=30), "daily", "ok", True, True)
    end = ("end", START + datetime.timedelta(days=150), "daily", "ok", True, True)
    # Files go by time in blocks, shuffled within; the late report comes when its time has passed.
    ordered = sorted(rows, key=lambda r: r[1])
    rng = random.Random(3)
    blocks = [ordered[i : i + 20] for i in range(0, len(ordered), 20)]
    for k, block in enumerate([*blocks, [late], [end]]):
        rng.shuffle(block)
        spark.createDataFrame(block, units.REPORT).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", units.ROCKS)
    try:
        source = spark.readStream.schema(units.REPORT).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in/*")).withWatermark("ts", "40 days")
        windows.run_available(units.stream(source, 20), str(tmp_path / "out"), str(tmp_path / "check"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    until = end[1] - datetime.timedelta(days=40)
    got = rows_of(spark.read.schema(units.CHANGE).parquet(str(tmp_path / "out")))
    want = rows_of(units.batch(spark.createDataFrame(rows, units.REPORT), 20, F.lit(until)))
    assert [g for g in got if g[0] != "end"] == want and {k for _, _, k, _ in want} == {"report", "due", "gone"}


@pytest.mark.parametrize("every", ["daily", "weekly", "monthly", None])
def test_due_moments_agree(spark, every):
    at = [START, datetime.datetime(2024, 12, 31, 23), datetime.datetime(2024, 2, 29, 5)]
    df = spark.createDataFrame([(a, every) for a in at], "ts timestamp, every string").select("ts", units.due_at(F.col("ts"), F.col("every")).alias("d"))
    for r in df.collect():
        assert r.d == units._due(r.ts, every)
