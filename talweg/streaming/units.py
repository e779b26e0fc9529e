"""States of units over event time: what to do at each report, when a unit falls due, when it is given up.

A report says at ``ts`` how a unit's run ended (``status``) and what it left (``has_output``, ``has_raw``). In order of time

* each report has the action that the state before it asks for (``planner.resume_action``);
* a unit whose last report is older than its refresh (``every``: daily, weekly or monthly) is due, once, at that moment;
* a unit without a report for ``keep`` days is given up at that moment, and what it left is forgotten.

``batch`` says so of a table by windows, ``stream`` of a stream by a stateful
processor with timers: reports wait until the watermark has passed them, so the
order in which they arrive doesn't matter, and both give the same rows for reports
that aren't late. State is one row a unit with its waiting reports; giving a unit up removes it.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from talweg.operators import planner

REPORT = "unit string, ts timestamp, every string, status string, has_output boolean, has_raw boolean"
CHANGE = "unit string, at timestamp, kind string, action string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAYS = {"daily": 1, "weekly": 7}


def due_at(ts: Column, every: Column) -> Column:
    """When a unit reported at ``ts`` is due again; null for one that never is."""
    day = F.expr("interval 1 day")
    return F.when(every == "daily", ts + day).when(every == "weekly", ts + 7 * day).when(every == "monthly", F.add_months(F.trunc(ts, "month"), 1).cast("timestamp"))


def batch(reports: DataFrame, keep: int, until: Column) -> DataFrame:
    """(unit, at, kind, action) of all changes at or before ``until``; of reports of one moment the last in order of their columns stays."""
    one = reports.groupBy("unit", "ts").agg(F.max(F.struct("every", "status", "has_output", "has_raw")).alias("r")).select("unit", "ts", "r.*").where(F.col("ts") <= until)
    w = Window.partitionBy("unit").orderBy("ts")
    gone = F.col("ts") + F.make_interval(days=F.lit(keep))
    rows = one.withColumns({"next": F.lead("ts").over(w), "due": due_at(F.col("ts"), F.col("every")), "gone": gone})
    before = {c: F.when(F.lag("gone").over(w) >= F.col("ts"), F.lag(c).over(w)) for c in ("status", "has_output", "has_raw")}
    action = planner.resume_action(before["status"], F.coalesce(before["has_output"], F.lit(False)), F.coalesce(before["has_raw"], F.lit(False)))
    rows = rows.withColumn("action", action)
    none = F.lit(None).cast("string")
    still = lambda at: (F.col("next").isNull() | (F.col("next") > F.col(at))) & (F.col(at) <= until)
    change = lambda at, kind, what: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"), what.alias("action"))
    found = F.array_compact(F.array(change("ts", "report", F.col("action")), F.when(still("due") & (F.col("due") < F.col("gone")), change("due", "due", none)), F.when(still("gone"), change("gone", "gone", none))))
    return rows.select("unit", F.explode(found).alias("c")).select("unit", "c.*")


def _plain(ts: datetime.datetime) -> datetime.datetime:
    """A moment as plain UTC; sessions run in UTC."""
    return ts.astimezone(datetime.timezone.utc).replace(tzinfo=None) if ts.tzinfo else ts


def _due(ts: datetime.datetime, every: str | None) -> datetime.datetime | None:
    if every == "monthly":
        return datetime.datetime(ts.year + ts.month // 12, ts.month % 12 + 1, 1)
    return ts + datetime.timedelta(days=DAYS[every]) if every in DAYS else None


def _action(state: tuple | None) -> str:
    """``planner.resume_action`` of one row."""
    status, output, raw = (state[2], bool(state[3]), bool(state[4])) if state else (None, False, False)
    if output and status == "ok":
        return "reuse_output"
    if raw and status in ("ok", "transform_failed"):
        return "reuse_raw"
    return "keep_no_data" if status == "no_data" else "download"


class Units(StatefulProcessor):
    """One unit: its last report, whether it has been said to be due, and the reports that wait."""

    def __init__(self, keep: int):
        self.keep = datetime.timedelta(days=keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = "ts timestamp, every string, status string, has_output boolean, has_raw boolean"
        self.last = handle.getValueState("last", f"{own}, said boolean")
        self.waiting = handle.getListState("waiting", own)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            at = _plain(r.ts)
            self.waiting.appendValue((at, r.every, r.status, bool(r.has_output), bool(r.has_raw)))
            self._wake(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = datetime.datetime.fromtimestamp(timerValues.getCurrentWatermarkInMs() / 1000, datetime.timezone.utc).replace(tzinfo=None)
        waiting = sorted({(_plain(x[0]), *x[1:]) for x in map(tuple, self.waiting.get())}, key=lambda x: (x[0], *(str(y) for y in x[1:])))
        ready = {x[0]: x for x in waiting if x[0] <= now}
        if ready or len(waiting):
            self.waiting.clear()
            if left := [x for x in waiting if x[0] > now]:
                self.waiting.put(left)
        state = self.last.get() if self.last.exists() else None
        state, said = ((_plain(state[0]), *state[1:5]), state[5]) if state else (None, False)
        out = []
        for report in ready.values():
            state, said, more = self._passed(state, said, report[0])
            out += [*more, (report[0], "report", _action(state))]
            state, said = report, False
        state, said, more = self._passed(state, said, now + datetime.timedelta(microseconds=1))
        out += more
        if state is None:
            self.last.clear()
        else:
            self.last.update((*state, said))
            for at in (_due(state[0], state[1]) if not said else None, state[0] + self.keep):
                if at is not None:
                    self._wake(at)
        return iter([Row(unit=key[0], at=at, kind=kind, action=action) for at, kind, action in out])

    def _passed(self, state: tuple | None, said: bool, before: datetime.datetime) -> tuple[tuple | None, bool, list]:
        """What a unit's state became before a moment, and the changes on the way."""
        out: list = []
        if state is None:
            return state, said, out
        due, gone = _due(state[0], state[1]), state[0] + self.keep
        if not said and due is not None and due < min(before, gone):
            out.append((due, "due", None))
            said = True
        if gone < before:
            return None, False, [*out, (gone, "gone", None)]
        return state, said, out

    def _wake(self, at: datetime.datetime) -> None:
        self.handle.registerTimer(int(at.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000))


def stream(reports: DataFrame, keep: int) -> DataFrame:
    """The same changes of a stream of reports with a watermark on ``ts``; the session's state store has to be RocksDB (``ROCKS``)."""
    return reports.groupBy("unit").transformWithState(Units(keep), outputStructType=CHANGE, outputMode="append", timeMode="eventTime")

