"""Dataset transforms: landed strings to curated rows, each with its quarantine.

Every transform takes a landed table with ``_ord`` (its rows' places) and gives
(curated, quarantine); rejects carry their place, the raw row and a reason.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions import parsing as P
from talweg.functions.nulls import sum_complete
from talweg.operators.quality import Split, reasoned, split
from talweg.operators.stats import first_by

AGES = range(18, 36)
YOUTH = {"age_scope": "youth_18_35", "age_min": 18, "age_max": 35, "youth_eligibility": "eligible"}


def _ages(sex: str) -> list[str]:
    return [f"people_age_{a:03d}_{sex}" for a in AGES]


def _row_sum(cols: list[str], have: set[str]) -> Column:
    """Sum over columns that any null or missing column makes null."""
    parts = [P.parse_int(F.col(c)) if c in have else F.lit(None).cast("bigint") for c in cols]
    return sum(parts[1:], parts[0])


def with_header(df: DataFrame, dataset: str, **literals) -> DataFrame:
    """The common header's constant columns."""
    return df.withColumns({"dataset": F.lit(dataset)} | {k: F.lit(v) for k, v in literals.items()})


def districts(df: DataFrame, code: str, registry: DataFrame) -> DataFrame:
    """District by exact code or by the one registered code that it starts with; else null. ``registry`` is a small dimension.

    The registry goes to every row as one array: the facts are neither joined nor grouped.
    """
    known = registry.agg(F.collect_list(F.struct(F.col("code").alias("c"), F.col("district_id").alias("d"))).alias("__known"))
    met = F.filter("__known", lambda k: F.startswith(F.col(code), k["c"]))
    exact = F.filter("__met", lambda k: k["c"] == F.col(code))
    one = F.when(F.size(exact) > 0, F.array_max(F.transform(exact, lambda k: k["d"]))).when(F.size("__met") == 1, F.get("__met", F.lit(0))["d"])
    return df.crossJoin(F.broadcast(known)).withColumn("__met", met).withColumn("district_id", one).drop("__met", "__known")


def named_district(df: DataFrame, text: str, registry: DataFrame, name: str = "district_id") -> DataFrame:
    """District by exact name, alias, postal code or code (``registry``: district_id, code, name, zip, aliases); null for none or several."""
    keys = registry.select("district_id", F.explode(F.array_distinct(F.concat(F.array("name", F.col("zip").cast("string"), F.col("code").cast("string")), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("__key"))
    one = keys.where("__key IS NOT NULL").groupBy("__key").agg(F.min("district_id").alias(name), F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return df.withColumn("__key", F.trim(text)).join(one, "__key", "left").drop("__key")


def population(landed: DataFrame, registry: DataFrame) -> Split:
    """Villages to districts by month: people, male, female and all of 18 to 35, long; any null in a sum makes it null."""
    have = set(landed.columns)
    rows = districts(landed, "district_code", registry).withColumns({
        "month": P.roc_month(F.col("statistic_yyymm")), "total": P.parse_int(F.col("people_total")), "male": _row_sum(_ages("m"), have), "female": _row_sum(_ages("f"), have),
    })
    got = split(rows, {"invalid_period": F.col("month").isNull(), "unmapped_district": F.col("district_id").isNull()}, "_ord")
    sums = got.accepted.groupBy("district_id", "month").agg(sum_complete(F.col("total")).alias("population_total"), sum_complete(F.col("male")).alias("youth_male"), sum_complete(F.col("female")).alias("youth_female"))
    sums = sums.withColumn("youth_total", F.col("youth_male") + F.col("youth_female"))
    metrics = ["population_total", "youth_male", "youth_female", "youth_total"]
    long = sums.select("district_id", "month", *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(["district_id", "month"], metrics, "metric_id", "value")
    long = long.withColumns({"period_start": F.col("month"), "period_end": F.last_day("month"), "unit": F.lit("person")}).drop("month")
    return Split(with_header(long, "population", geo_level="district", period_type="month"), got.quarantine, got.quality)


def village_population(landed: DataFrame) -> Split:
    """One wide row a (village, month): sums over rows of the first identity; rows of another are quarantined."""
    have = set(landed.columns)
    w = Window.partitionBy("site_id", "statistic_yyymm").orderBy("_ord")
    rows = landed.withColumns({"month": P.roc_month(F.col("statistic_yyymm")), "total": P.parse_int(F.col("people_total")), "youth": _row_sum(_ages("m") + _ages("f"), have), "identity": F.concat_ws("|", "district_code", "village")})
    rows = rows.withColumn("first_identity", F.first("identity").over(w))
    got = split(rows, {"invalid_period": F.col("month").isNull(), "duplicate_identity": F.col("identity") != F.col("first_identity")}, "_ord")
    wide = got.accepted.groupBy("site_id", "month").agg(F.min_by("village", "_ord").alias("village"), sum_complete(F.col("total")).alias("population_total"), sum_complete(F.col("youth")).alias("youth_total"))
    return Split(with_header(wide, "population_villages", geo_level="village", **YOUTH), got.quarantine, got.quality)


def national_population(landed: DataFrame) -> Split:
    """All villages; a village that comes again is skipped and counted; any reject flags the output."""
    have = set(landed.columns)
    rows = landed.withColumns({"month": P.roc_month(F.col("statistic_yyymm")), "total": P.parse_int(F.col("people_total")), "youth": _row_sum(_ages("m") + _ages("f"), have)})
    marked = reasoned(rows, {"invalid_period": F.col("month").isNull(), "missing_value": F.col("total").isNull()})
    once = first_by(marked.where("reject_reason IS NULL").select("site_id", "month", "_ord", "total", "youth"), ["site_id", "month"], F.col("_ord"))
    counted = marked.agg(F.count("reject_reason").alias("rejected"))
    out = once.groupBy("month").agg(F.sum("total").alias("population_total"), sum_complete(F.col("youth")).alias("youth_total"), F.count("*").alias("villages")).crossJoin(F.broadcast(counted))
    got = split(rows, {"invalid_period": F.col("month").isNull(), "missing_value": F.col("total").isNull()}, "_ord")
    return Split(with_header(out.withColumn("quality_flags", F.when(F.col("rejected") > 0, F.array(F.lit("source_rows_rejected"))).otherwise(F.array().cast("array<string>"))), "national_population", geo_level="national"), got.quarantine, got.quality)


def movement(landed: DataFrame, registry: DataFrame) -> Split:
    """All in_* and out_* columns summed by district and month; a side is its total column, else male and female; net needs both."""
    def side(prefix: str) -> Column:
        cols = [c for c in landed.columns if re.match(f"{prefix}_", c)]
        total = [c for c in cols if c.endswith("_total")]
        parts = total or [c for c in cols if c.endswith(("_m", "_f"))]
        return _row_sum(parts, set(cols)) if parts else F.lit(None).cast("bigint")

    rows = districts(landed, "district_code", registry).withColumns({"month": P.roc_month(F.col("statistic_yyymm")), "moved_in": side("in"), "moved_out": side("out")})
    got = split(rows, {"invalid_period": F.col("month").isNull(), "unmapped_district": F.col("district_id").isNull()}, "_ord")
    out = got.accepted.groupBy("district_id", "month").agg(sum_complete(F.col("moved_in")).alias("moved_in"), sum_complete(F.col("moved_out")).alias("moved_out"))
    return Split(with_header(out.withColumn("net", F.col("moved_in") - F.col("moved_out")), "movement", geo_level="district"), got.quarantine, got.quality)


def births(landed: DataFrame) -> Split:
    """Mothers of 18 to 35 by district and year; an age's row for both sexes beats the sum of each; repeats are quarantined."""
    age = F.regexp_extract("mother_age", "([0-9]+)", 1).try_cast("int")
    key = ["site_id", "statistic_yyy", "mother_age", "birth_sex"]
    rows = landed.withColumns({"year": P.roc_year(F.col("statistic_yyy")), "age": age, "n": P.parse_int(F.col("birth_count")), "again": F.row_number().over(Window.partitionBy(*key).orderBy("_ord")) > 1})
    inside = rows.where(F.col("age").isNull() | F.col("age").between(18, 35))
    got = split(inside, {"invalid_period": F.col("year").isNull(), "invalid_age": F.col("age").isNull(), "invalid_count": F.col("n").isNull(), "duplicate": F.col("again")}, "_ord")
    whole = F.col("birth_sex").isin("total", "計")
    each = got.accepted.groupBy("site_id", "year", "age").agg(F.coalesce(F.max(F.when(whole, F.col("n"))), F.sum(F.when(~whole, F.col("n")))).alias("n"))
    return Split(with_header(each.groupBy("site_id", "year").agg(F.sum("n").alias("births")), "births", geo_level="district", **YOUTH), got.quarantine, got.quality)


def marriages(landed: DataFrame) -> Split:
    """First row of each (month, site, village); pairs by district and year."""
    rows = landed.withColumns({"month": P.roc_month(F.col("statistic_yyymm")), "pairs": P.parse_int(F.col("marry_pair")), "again": F.row_number().over(Window.partitionBy("statistic_yyymm", "site_id", "village").orderBy("_ord")) > 1})
    got = split(rows, {"invalid_period": F.col("month").isNull(), "invalid_count": F.col("pairs").isNull(), "duplicate": F.col("again")}, "_ord")
    return Split(with_header(got.accepted.groupBy("site_id", F.year("month").alias("year")).agg(F.sum("pairs").alias("pairs")), "marriages", geo_level="district"), got.quarantine, got.quality)


SQM_PER_PING = 3.305785


def priced(landed: DataFrame, dataset: str, date: str, measures: dict[str, str]) -> Split:
    """Transactions kept wide: measures parsed, their units beside them, a flag where the date is missing."""
    rows = landed.withColumns({m: P.parse_decimal(P.clean_text(F.col(m))) for m in measures})
    day = F.coalesce(P.calendar_date(F.col(date)), P.roc_date(F.col(date)))
    rows = rows.withColumn(date, day).withColumns({f"{m}_unit": F.lit(u) for m, u in measures.items()})
    rows = rows.withColumn("quality_flags", F.when(F.col(date).isNull(), F.array(F.lit("missing_date"))).otherwise(F.array().cast("array<string>")))
    got = split(rows, {"no_measure": F.coalesce(*(F.col(m) for m in measures)).isNull()}, "_ord")
    return Split(with_header(got.accepted, dataset, geo_level="district"), got.quarantine, got.quality)


def rent_per_sqm(stated: Column, total: Column, area: Column) -> tuple[Column, Column]:
    """(rent a square metre, where it comes from)."""
    derived = F.when(area > 0, total / area)
    return F.coalesce(stated, derived), F.when(stated.isNotNull(), "source").when(derived.isNotNull(), "derived").otherwise("missing")


def vacancies(landed: DataFrame) -> Split:
    """Salary bounds to a midpoint with its kind; scope district or county; headers before their brackets."""
    rows = landed.toDF(*(P.canonical_header(c) for c in landed.columns))
    low, high = P.parse_decimal(F.col("NT_L")), P.parse_decimal(F.col("NT_U"))
    mid, kind = P.midpoint(F.when(low > 0, low), F.when(high > 0, high))
    rows = rows.withColumns({"positions": P.parse_int(F.col("JOB_PERSON")), "salary": mid, "salary_estimate": kind})
    got = split(rows, {"invalid_scope": ~F.coalesce(F.col("geo_scope").isin("district", "county"), F.lit(False)), "invalid_positions": F.col("positions").isNull()}, "_ord")
    return Split(with_header(got.accepted.withColumn("geo_level", F.when(F.col("geo_scope") == "county", "city").otherwise("district")), "job_vacancies"), got.quarantine, got.quality)


def vacancy_salaries(landed: DataFrame) -> Split:
    """Salaries of vacancies: both bounds are needed for a midpoint; rows without stay, marked, and count as incomplete; a bound above the other is quarantined."""
    rows = landed.toDF(*(P.canonical_header(c) for c in landed.columns))
    low, high = (F.when(b > 0, b) for b in (P.parse_decimal(F.col("NT_L")), P.parse_decimal(F.col("NT_U"))))
    whole = low.isNotNull() & high.isNotNull()
    flags = F.array_compact(F.array(F.when(~whole, "incomplete_salary_bounds")))
    rows = rows.withColumns({"positions": P.parse_int(F.col("JOB_PERSON")), "salary_lower": low, "salary_upper": high, "salary": F.when(whole, (low + high) / 2), "quality_flags": flags})
    rules = {"invalid_scope": ~F.coalesce(F.col("geo_scope").isin("district", "county"), F.lit(False)), "invalid_positions": F.col("positions").isNull(), "inverted_bounds": low > high}
    got = split(rows, rules, "_ord")
    return Split(with_header(got.accepted.withColumn("geo_level", F.when(F.col("geo_scope") == "county", "city").otherwise("district")), "job_vacancy_salaries"), got.quarantine, got.quality)


def wages(landed: DataFrame, methods: dict[str, str]) -> Split:
    """The method names the metric; an unknown one is quarantined; the age range is a proxy."""
    names = F.create_map(*(F.lit(x) for kv in methods.items() for x in kv))
    low, high = P.age_range(F.col("age"))
    rows = landed.withColumns({"metric_id": F.try_element_at(names, F.col("method")), "value": P.parse_decimal(F.col("wage")), "age_min": low, "age_max": high, "period": P.roc_year(F.col("year"))})
    got = split(rows, {"unknown_method": F.col("metric_id").isNull(), "invalid_value": F.col("value").isNull()}, "_ord")
    return Split(with_header(got.accepted, "wages", geo_level="city", age_scope="proxy", youth_eligibility="proxy"), got.quarantine, got.quality)


def majors(overview: DataFrame, detail: DataFrame, places: DataFrame, key: list[str], counts: list[str]) -> DataFrame:
    """Overview and detail on their key: exact repeats of detail go, counts add up by key, unmatched sides are flagged, schools get a place."""
    parsed = detail.dropDuplicates([*key, *counts]).groupBy(*key).agg(*(sum_complete(P.parse_int(F.col(c))).alias(c) for c in counts), F.lit(True).alias("in_detail"))
    both = overview.withColumn("in_overview", F.lit(True)).join(parsed, key, "full")
    flag = F.when(F.col("in_detail").isNull(), "detail_missing").when(F.col("in_overview").isNull(), "overview_missing")
    return both.withColumn("match", F.coalesce(flag, F.lit("matched"))).drop("in_detail", "in_overview").join(places, "school_code", "left")


def both_sexes(male: Column, female: Column) -> Column:
    """Graduates of both sexes; null where either is."""
    return P.parse_int(male) + P.parse_int(female)


def misread(text: Column, parsed: Column) -> Column:
    """There is a text, and it can't be read; a text that stands for missing is no error."""
    return P.clean_text(text).isNotNull() & parsed.isNull()


def academic_year(year: Column) -> tuple[Column, Column]:
    """First and last day: August of the year to July of the next."""
    return F.make_date(year, F.lit(8), F.lit(1)), F.make_date(year + 1, F.lit(7), F.lit(31))


def graduates(landed: DataFrame) -> Split:
    """Graduates by school year: men, women, and both where both are known."""
    year, men, women = P.roc_year(F.col("school_year")), P.parse_int(F.col("graduates_male")), P.parse_int(F.col("graduates_female"))
    start, end = academic_year(year)
    rows = landed.withColumns({"period_start": start, "period_end": end, "male": men, "female": women, "graduates": both_sexes(F.col("graduates_male"), F.col("graduates_female"))})
    got = split(rows, {"invalid_year": year.isNull(), "invalid_value": misread(F.col("graduates_male"), men) | misread(F.col("graduates_female"), women)}, "_ord")
    return Split(with_header(got.accepted, "graduate_majors", geo_level="national", period_type="year"), got.quarantine, got.quality)


def trainings(landed: DataFrame) -> Split:
    """Courses at county grain: people, hours, fee and days, typed; unreadable numbers and dates are quarantined."""
    people, hours, fee = P.parse_int(F.col("people")), P.parse_decimal(P.clean_text(F.col("hours"))), P.parse_decimal(P.clean_text(F.col("fee")))
    start, end = P.calendar_date(F.col("opened")), P.calendar_date(F.col("closed"))
    rows = landed.withColumns({"county_name": P.clean_text(F.col("county")), "training_people": people, "training_hours": hours, "fee_per_person": fee, "period_start": start, "period_end": end})
    rules = {"invalid_value": misread(F.col("people"), people) | misread(F.col("hours"), hours) | misread(F.col("fee"), fee), "invalid_date": misread(F.col("opened"), start) | misread(F.col("closed"), end)}
    got = split(rows, rules, "_ord")
    return Split(with_header(got.accepted, "training_numbers", geo_level="county"), got.quarantine, got.quality)


def talent_demand(landed: DataFrame) -> Split:
    """National demand by year and occupation."""
    year = P.roc_year(F.regexp_replace(P.clean_text(F.col("period")), "年$", ""))
    counts = {c: P.parse_int(F.col(c)) for c in ("new_demand", "new_hired", "valid_hired")}
    rows = landed.withColumns({"year": year} | {f"{c}_count": v for c, v in counts.items()})
    wrong = misread(F.col("new_demand"), counts["new_demand"]) | misread(F.col("new_hired"), counts["new_hired"]) | misread(F.col("valid_hired"), counts["valid_hired"])
    got = split(rows, {"invalid_year": year.isNull(), "invalid_value": wrong}, "_ord")
    return Split(with_header(got.accepted, "talent_demand", geo_level="national", period_type="year"), got.quarantine, got.quality)


def courses(landed: DataFrame) -> DataFrame:
    """Distinct course ids by district, and which."""
    return landed.groupBy("district_id").agg(F.countDistinct("course_id").alias("courses"), F.sort_array(F.collect_set("course_id")).alias("ids"))


def stops(landed: DataFrame, polygons: DataFrame) -> Split:
    """Stops with valid coordinates; one in no district, or in several, stays with a null one."""
    from talweg.operators.joins import located

    rows = landed.withColumns({"x": F.col("lon").try_cast("double"), "y": F.col("lat").try_cast("double")})
    got = split(rows, {"invalid_coordinates": ~F.coalesce(F.col("x").between(-180, 180) & F.col("y").between(-90, 90), F.lit(False))}, "_ord")
    placed = got.accepted.join(located(got.accepted.select("_ord", "x", "y"), polygons, "_ord", "district_id"), "_ord", "left")
    return Split(with_header(placed, "stops", geo_level="point"), got.quarantine, got.quality)


def service_points(landed: DataFrame, overrides: DataFrame) -> DataFrame:
    """Places with coordinates of both systems and a status.

    Each coordinate is the override table's (its last row for an id), else the
    source's. A place is "matched" if the table has a coordinate for it or the
    source calls it so; a matched place with plane coordinates alone gets the
    sphere's from them, and plane ones are filled in. Without a longitude and
    latitude, or unmatched, it is "excluded_no_verified_coordinate".
    """
    from talweg.functions.geo import tm2, tm2_inverse

    fields = ["longitude", "latitude", "x_3826", "y_3826"]
    last = overrides.groupBy("point_id").agg(F.max_by(F.struct(*(c for c in overrides.columns if c != "point_id")), "_ord").alias("__o"))
    rows = landed.join(last, "point_id", "left")
    table = {c: F.col(f"__o.{c}").cast("double") if c in overrides.columns else F.lit(None).cast("double") for c in fields}
    own = {c: P.parse_decimal(F.col(c)) if c in landed.columns else F.lit(None).cast("double") for c in fields}
    stated = F.col("geocode_status") if "geocode_status" in landed.columns else F.lit(None).cast("string")
    matched = F.coalesce(*table.values()).isNotNull() | F.coalesce(stated == "matched", F.lit(False))
    lon, lat, x, y = (F.coalesce(table[c], own[c]) for c in fields)
    inverse = [F.when(matched & (lon.isNull() | lat.isNull()), c) for c in tm2_inverse(x, y)]
    on_sphere = rows.withColumns({"__m": matched, "__lon": F.coalesce(inverse[0], lon), "__lat": F.coalesce(inverse[1], lat), "__x": x, "__y": y})
    east, north = tm2(F.col("__lon"), F.col("__lat"))
    how = F.when(F.col("__m") & F.col("__lon").isNotNull() & F.col("__lat").isNotNull(), "matched").otherwise("excluded_no_verified_coordinate")
    out = on_sphere.withColumns({"geocode_status": how, "longitude": F.col("__lon"), "latitude": F.col("__lat"), "x_3826": F.coalesce("__x", east), "y_3826": F.coalesce("__y", north)})
    return out.drop("__o", "__m", "__lon", "__lat", "__x", "__y")


def candidates(landed: DataFrame) -> Split:
    """Typed candidates: marks to booleans, age at the election; ward seats need a district; a bad birthday is a warning."""
    birth = F.coalesce(P.calendar_date(F.col("birth")), P.roc_date(F.col("birth")))
    day = P.calendar_date(F.col("election_date"))
    rows = landed.withColumns({"elected": F.coalesce(F.col("mark") == "*", F.lit(False)), "incumbent": F.coalesce(F.col("held") == "Y", F.lit(False)), "birth": birth, "age": F.coalesce(P.age_on(birth, day), P.parse_int(F.col("age")).cast("int"))})
    rows = rows.withColumn("warnings", F.when(F.col("birth").isNull(), F.array(F.lit("invalid_birth_date"))).otherwise(F.array().cast("array<string>")))
    got = split(rows, {"missing_district": (F.col("election_type") == "V1") & F.col("district_id").isNull(), "invalid_date": day.isNull()}, "_ord")
    return Split(with_header(got.accepted, "elections"), got.quarantine, got.quality)


def boundaries(landed: DataFrame, prefixes: list[str]) -> Split:
    """Villages of the city (by code prefix), the first of each code, with polygon geometry."""
    mine = F.lit(False)
    for p in prefixes:
        mine = mine | F.col("code").startswith(p)
    rows = landed.withColumn("again", F.row_number().over(Window.partitionBy("code").orderBy("_ord")) > 1)
    got = split(rows, {"other_city": ~F.coalesce(mine, F.lit(False)), "not_a_polygon": ~F.coalesce(F.col("type").isin("Polygon", "MultiPolygon"), F.lit(False)), "duplicate": F.col("again")}, "_ord")
    return Split(with_header(got.accepted.drop("again"), "village_boundaries", geo_level="village"), got.quarantine, got.quality)


def budgets(landed: DataFrame) -> Split:
    """Amounts in currency units; plans and allocation codes are needed by row type; a surplus may be negative."""
    factor = F.when(F.col("unit_label") == "千元", 1000.0).when(F.col("unit_label") == "元", 1.0)
    signed = F.when(F.col("surplus_amount").rlike(r"^[+-]?[0-9,]+$"), F.replace(F.col("surplus_amount"), F.lit(","), F.lit("")).try_cast("double"))
    rows = landed.withColumns({"year": P.roc_year(F.col("budget_year_roc")), "amount": P.parse_decimal(F.col("budget_amount")) * factor, "surplus": signed * factor})
    rules = {
        "invalid_year": F.col("year").isNull(), "unknown_unit": factor.isNull(), "missing_plan": (F.col("row_type") == "plan") & P.clean_text(F.col("work_plan")).isNull(),
        "missing_code": (F.col("row_type") == "allocation") & ~F.coalesce(F.col("allocation_code").isin("01", "02", "03", "04"), F.lit(False)), "invalid_surplus": F.col("surplus_amount").isNotNull() & signed.isNull(),
    }
    got = split(rows, rules, "_ord")
    return Split(with_header(got.accepted, "youth_budgets", geo_level="city"), got.quarantine, got.quality)


def grants(landed: DataFrame, names: list[str]) -> DataFrame:
    """District from the project's place, else the recipient's address, else its name; the period ends with the reported month."""
    def district(c: str) -> Column:
        return F.try_element_at(F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.col(c), n)), F.lit(1))

    basis = ["project_location", "recipient_address", "recipient_name"]
    year = P.roc_year(F.col("year_roc"))
    end = F.last_day(F.when(F.col("coverage_end_month").between(1, 12), F.make_date(year, F.col("coverage_end_month"), F.lit(1))))
    which = F.coalesce(*(F.when(district(c).isNotNull(), F.lit(c)) for c in basis))
    return landed.withColumns({"district_name": F.coalesce(*map(district, basis)), "geo_basis": which, "period_end": end, "coverage_scope": F.when(F.month(end) == 12, "full_year").when(end.isNotNull(), "year_to_date")})


def proposals(landed: DataFrame, agencies: list[str], keywords: list[str]) -> Split:
    """Proposals with year and whether, and why, they are about youth."""
    from talweg.functions.text import matched_terms

    body = F.concat_ws(" ", "title", "content", "category")
    reasons = F.concat(F.transform(matched_terms(F.coalesce("agency", F.lit("")), agencies), lambda t: F.concat(F.lit("agency:"), t)), F.transform(matched_terms(body, keywords), lambda t: F.concat(F.lit("keyword:"), t)))
    rows = landed.withColumns({"year": P.free_year(F.col("submitted_at")), "endorsements": F.coalesce(P.parse_int(F.col("endorsement_count")), F.lit(0)), "proxy_reasons": reasons, "youth_proxy": F.size(reasons) > 0})
    got = split(rows, {"missing_id": P.clean_text(F.col("proposal_id")).isNull(), "missing_year": F.col("year").isNull()}, "_ord")
    return Split(with_header(got.accepted, "join_proposals", geo_level="city"), got.quarantine, got.quality)


def minutes_items(meetings: DataFrame) -> DataFrame:
    """(meeting_id, section, item, title, body, resolution, needs_review): numbered items of each section of the minutes.

    Lines are numbered in page order; the section and item that a line stands in
    are the last ones seen, so the scanner is two windows and one grouping.
    """
    lines = meetings.select("meeting_id", F.posexplode(F.split(F.array_join("page_texts", "\n"), "\n")).alias("n", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    w = Window.partitionBy("meeting_id").orderBy("n")
    header = F.when(F.col("line").rlike("^[壹貳參肆伍陸柒捌玖拾]+、"), F.regexp_replace("line", "^[壹貳參肆伍陸柒捌玖拾]+、", ""))
    starts = F.col("line").rlike("^[一二三四五六七八九十]+、")
    seen = lines.withColumn("section", F.last(header, ignorenulls=True).over(w)).withColumn("is_header", header.isNotNull()).withColumn("starts", starts)
    seen = seen.withColumn("item", F.sum(F.col("starts").cast("int")).over(w)).withColumn("at", F.max(F.when(F.col("starts") | F.col("is_header"), F.struct("n", "starts"))).over(w))
    inside = seen.where("NOT is_header AND at.starts")
    resolution = F.col("line").rlike("^(決議|裁示)[:：]")
    marked = inside.withColumn("resolved_from", F.max(resolution.cast("int")).over(Window.partitionBy("meeting_id", "item").orderBy("n")))
    text = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("n", "line")))), lambda x: x["line"]), "\n")
    out = marked.groupBy("meeting_id", "item").agg(F.first("section").alias("section"), F.regexp_replace(F.min_by("line", "n"), "^[一二三四五六七八九十]+、", "").alias("title"), text((F.col("resolved_from") == 0) & ~F.col("starts")).alias("body"), text(F.col("resolved_from") == 1).alias("resolution"))
    return out.withColumn("needs_review", F.col("resolution") == "").withColumn("escalated", F.col("resolution").rlike("列管|提報"))


#: Names that a dataset goes by, and its transform.
TRANSFORMS: dict[str, Callable] = {
    "population": population, "population_villages": village_population, "national_population": national_population, "movement": movement, "births": births, "marriages": marriages,
    "house_prices": priced, "rentals": priced, "job_vacancies": vacancies, "job_vacancy_salaries": vacancy_salaries, "wages": wages, "college_majors": majors, "graduate_majors": graduates, "vt_courses": courses,
    "training_numbers": trainings, "talent_demand": talent_demand,
    "bus_stops": stops, "railway_stops": stops, "bike_stops": stops, "babysitting_places": service_points, "youth_service_points": service_points, "elections": candidates,
    "village_boundaries": boundaries, "youth_budgets": budgets, "youth_grants": grants, "join_proposals": proposals, "youth_council_minutes": minutes_items,
}
ALIASES = {"moving": "movement", "moving_in": "movement", "birth_nums": "births", "marriage_nums": "marriages", "house_price": "house_prices", "rental": "rentals", "job_vacancy": "job_vacancies", "wage": "wages", "vt_course": "vt_courses", "bus_stop": "bus_stops", "railway_stop": "railway_stops", "bike_stop": "bike_stops", "budget": "youth_budgets", "grant": "youth_grants", "proposals": "join_proposals", "minutes": "youth_council_minutes"}


def transform_for(name: str) -> Callable:
    """The transform of a dataset by its name or an alias of it."""
    key = ALIASES.get(name, name)
    if key not in TRANSFORMS:
        raise KeyError(f"unknown dataset: {name}")
    return TRANSFORMS[key]
