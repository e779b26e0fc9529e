"""Guarded parsing of landed text: every function gives null for what it can't read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value, upper case.
MISSING = ["", "-", "—", "－", "NA", "N/A", "無", "面議"]
ROC_OFFSET = 1911


def nfkc(c: Column) -> Column:
    """Unicode NFKC, which Spark has no function for: a pandas UDF over Arrow batches."""

    def normalised(text: pd.Series) -> pd.Series:
        return text.str.normalize("NFKC")

    return F.pandas_udf(normalised, "string")(c)


def clean_text(c: Column, unicode_form: bool = False) -> Column:
    """Trimmed text; the stand-ins for missing become null. ``unicode_form``: NFKC first."""
    t = F.trim(nfkc(c) if unicode_form else c)
    return F.when(~F.upper(t).isin(MISSING), t)


def parse_int(c: Column) -> Column:
    """Non-negative whole number, thousands' commas and a plus sign allowed."""
    t = F.replace(F.trim(c), F.lit(","), F.lit(""))
    return F.when(t.rlike(r"^\+?[0-9]+$"), t.try_cast("bigint"))


def parse_decimal(c: Column) -> Column:
    """Finite number of 0 or more."""
    d = F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(d) & (d >= 0) & (d < float("inf")), d)


def roc_year(c: Column) -> Column:
    """Republic-era year of two or three digits as a Gregorian one."""
    return F.when(c.rlike(r"^[0-9]{2,3}$"), c.try_cast("int") + ROC_OFFSET)


def roc_month(c: Column) -> Column:
    """yyyMM as the month's first day."""
    y, m = F.substring(c, 1, 3).try_cast("int") + ROC_OFFSET, F.substring(c, 4, 2).try_cast("int")
    return F.when(c.rlike("^[0-9]{3}(0[1-9]|1[0-2])$"), F.try_make_timestamp(y, m, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date"))


def roc_date(c: Column) -> Column:
    """yyyMMdd as a date; null where there is no such day."""
    part = lambda a, n: F.substring(c, a, n).try_cast("int")
    day = F.try_make_timestamp(part(1, 3) + ROC_OFFSET, part(4, 2), part(6, 2), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.when(c.rlike("^[0-9]{7}$"), day)


def to_roc_month(d: Column) -> Column:
    return F.concat(F.lpad((F.year(d) - ROC_OFFSET).cast("string"), 3, "0"), F.lpad(F.month(d).cast("string"), 2, "0"))


def free_year(c: Column) -> Column:
    """The first year in free text: yyyMMdd, a marked two- or three-digit year, or an ISO year."""
    compact = F.regexp_extract(c, r"(?<![0-9])([0-9]{3})[0-9]{4}(?![0-9])", 1).try_cast("int")
    marked = F.regexp_extract(c, r"(?<![0-9./-])([0-9]{2,3})\s*[年./-]", 1).try_cast("int")
    iso = F.regexp_extract(c, r"(?<![0-9])([0-9]{4})(?![0-9])", 1).try_cast("int")
    found = F.coalesce(compact, marked, iso)
    return F.when(found > ROC_OFFSET, found).otherwise(found + ROC_OFFSET)


def calendar_date(c: Column) -> Column:
    """%Y/%m/%d, %Y-%m-%d or %Y%m%d."""
    forms = {r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$": "y/M/d", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$": "y-M-d", r"^[0-9]{8}$": "yyyyMMdd"}
    return F.coalesce(*(F.when(c.rlike(rx), F.try_to_timestamp(c, F.lit(form)).cast("date")) for rx, form in forms.items()))


def age_on(birth: Column, day: Column) -> Column:
    """Whole years; a birthday counts on its day (the 29th of February on the 1st of March)."""
    mmdd = lambda d: F.month(d) * 100 + F.dayofmonth(d)
    return F.year(day) - F.year(birth) - (mmdd(day) < mmdd(birth)).cast("int")


def age_range(c: Column) -> tuple[Column, Column]:
    """Both ends of a closed range like 25-29."""
    return tuple(F.regexp_extract(c, r"([0-9]+)\s*[-~－]\s*([0-9]+)", k).try_cast("int") for k in (1, 2))


def midpoint(low: Column, high: Column) -> tuple[Column, Column]:
    """(mean of what is there, which kind of estimate that is)."""
    value = F.coalesce((low + high) / 2, low.cast("double"), high.cast("double"))
    kind = F.when(low.isNotNull() & high.isNotNull(), "midpoint").when(low.isNotNull(), "lower_bound").when(high.isNotNull(), "upper_bound").otherwise("missing")
    return value, kind


def stable_id(dataset: str, *cols: str) -> Column:
    """dataset:hash of the columns in name order; the same wherever the row comes from."""
    body = F.to_json(F.struct(*(F.col(c) for c in sorted(cols))), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{dataset}:"), F.substring(F.sha2(body, 256), 1, 16))


def first_of(row_map: Column, *names: str) -> Column:
    """The first non-null value of a string map under any of the names, whatever their case or byte-order mark."""
    plain = F.transform_keys(row_map, lambda k, _: F.lower(F.regexp_replace(k, "^﻿", "")))
    return F.coalesce(*(F.try_element_at(plain, F.lit(n.lower())) for n in names))


def canonical_header(name: str) -> str:
    """A header before its bracketed remark."""
    import re

    return re.split(r"[（(]", name.lstrip("﻿"))[0].strip()
