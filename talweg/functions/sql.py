"""The engine's functions for SQL: scalar ones as SQL text, which Catalyst inlines, and two table functions, one of them over partitions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from talweg.functions.parsing import MISSING, ROC_OFFSET

_MISSING = ", ".join("'" + m.replace("'", "''") + "'" for m in MISSING)
#: name(parameters) -> type and body.
SCALARS = {
    "clean_text(c STRING)": ("STRING", f"CASE WHEN upper(trim(c)) NOT IN ({_MISSING}) THEN trim(c) END"),
    "parse_count(c STRING)": ("BIGINT", r"CASE WHEN replace(trim(c), ',', '') RLIKE '^\\+?[0-9]+$' THEN try_cast(replace(trim(c), ',', '') AS BIGINT) END"),
    "roc_year(c STRING)": ("INT", f"CASE WHEN c RLIKE '^[0-9]{{2,3}}$' THEN try_cast(c AS INT) + {ROC_OFFSET} END"),
    "finite(d DOUBLE)": ("DOUBLE", "CASE WHEN NOT isnan(d) AND abs(d) < double('infinity') THEN d END"),
    "safe_ratio(a DOUBLE, b DOUBLE)": ("DOUBLE", "try_divide(a, b)"),
    "yoy(a DOUBLE, b DOUBLE)": ("DOUBLE", "try_divide(a - b, b) * 100"),
    "salary_middle(a DOUBLE, b DOUBLE)": ("DOUBLE", "coalesce((a + b) / 2, a, b)"),
}


@udtf(returnType="path string, value string")
class Leaves:
    """(path, value) of each leaf of a JSON text; nothing for what can't be read."""

    def eval(self, body: str) -> Iterator[tuple[str, str]]:
        try:
            todo = [("", json.loads(body or "null", parse_int=str, parse_float=str))]
        except ValueError:
            return
        while todo:
            path, x = todo.pop()
            inner = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else None
            if inner is not None:
                todo += [(f"{path}.{k}".lstrip("."), y) for k, y in reversed(list(inner))]
            elif x is not None:
                yield path, x if isinstance(x, str) else str(x).lower()


SECTION, ITEM, RESOLVED = re.compile("^[壹貳參肆伍陸柒捌玖拾]+、"), re.compile("^[一二三四五六七八九十]+、"), re.compile("^(?:決議|裁示)[:：]")


@udtf(returnType="meeting_id string, section string, item long, title string, body string, resolution string, needs_review boolean, escalated boolean")
class MinutesItems:
    """Numbered items of a meeting's minutes from its lines: a table argument of (meeting_id, n, line), partitioned by the meeting, ordered by n.

    One line is held at a time, and the item that it belongs to: a section's
    header ends an item, an item's number starts one, a resolution starts its
    second half.
    """

    def __init__(self):
        self.meeting = self.section = self.item = None
        self.count = 0

    def eval(self, row) -> Iterator[tuple]:
        self.meeting = row["meeting_id"]
        line = (row["line"] or "").strip(" ")
        if not line:
            return
        if SECTION.match(line):
            yield from self._ended()
            self.section = SECTION.sub("", line)
        elif ITEM.match(line):
            yield from self._ended()
            self.count += 1
            self.item = (ITEM.sub("", line), [], [])
        elif self.item is not None:
            _, body, resolution = self.item
            (resolution if resolution or RESOLVED.match(line) else body).append(line)

    def terminate(self) -> Iterator[tuple]:
        yield from self._ended()

    def _ended(self) -> Iterator[tuple]:
        if self.item is not None:
            title, body, resolution = self.item
            decided = "\n".join(resolution)
            yield self.meeting, self.section, self.count, title, "\n".join(body), decided, not decided, "列管" in decided or "提報" in decided
        self.item = None


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("json_leaves", Leaves)
    spark.udtf.register("minutes_items", MinutesItems)
