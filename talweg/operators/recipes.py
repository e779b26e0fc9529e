"""Small composite recipes over curated tables: key figures, budget points, wages, demand, allocations, availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions import nulls as N
from talweg.operators import series

# What stands in for the nation's youth, statuses of a budget in order of precedence, allocation codes, methods of wages.
NATIONAL_YOUTH = 4_820_000.0
BUDGET_STATUSES = ["legal_budget", "proposed_budget"]
ALLOCATIONS = ["01", "02", "03", "04"]
WAGE_METHODS = ["平均數", "中位數"]


def key_figures(city: DataFrame, national: DataFrame, year: int, fallback: float = NATIONAL_YOUTH) -> DataFrame:
    """One row: the city's youth, share and change for ``year``, and the nation's.

    ``city``: year, people, youth, period; ``national``: period_start, value,
    quality_flags. The nation's figure is that of the city's month, else the
    latest one; sums with villages missing don't count; else a constant, marked
    as a proxy.
    """
    now = city.where(F.col("year") == year).agg(F.max("people").alias("people"), F.max("youth").alias("youth"), F.max("period").alias("period"))
    before = city.where(F.col("year") == year - 1).agg(F.max("youth").alias("before"))
    whole = national.where(F.col("value").isNotNull() & ~F.array_contains(F.coalesce("quality_flags", F.array().cast("array<string>")), "incomplete_coverage"))
    picked = whole.join(F.broadcast(now.select("period")), F.lit(True)).agg(F.max_by("value", F.struct(F.coalesce(F.col("period_start") == F.col("period"), F.lit(False)), "period_start")).alias("national"))
    row = now.crossJoin(before).crossJoin(picked)
    return row.select(
        F.lit(year).alias("year"),
        F.coalesce("national", F.lit(fallback)).alias("national_youth"),
        F.when(F.col("national").isNull(), "proxy").otherwise("observed").alias("national_quality"),
        F.col("youth").alias("city_youth"),
        (N.ratio(F.col("youth"), F.col("people")) * 100).alias("city_share"),
        N.yoy(F.col("youth"), F.col("before")).alias("city_yoy"),
    )


def budget_points(budgets: DataFrame, first_year: int) -> DataFrame:
    """Total budget by year from the first published one: a legal budget before a proposed one, gaps kept, change on the last year that has one.

    ``budgets``: row_type, document_status, unit, year, amount, _ord.
    """
    rank = F.array_position(F.array(*map(F.lit, BUDGET_STATUSES)), F.col("document_status"))
    rows = budgets.where((F.col("row_type") == "total") & (rank > 0) & F.coalesce(F.col("unit") == "TWD_thousand", F.lit(True)) & F.col("year").isNotNull() & F.col("amount").isNotNull() & (F.col("year") >= first_year))
    best = rows.groupBy("year").agg(F.min_by(F.struct("amount", "document_status"), F.struct(rank, "_ord")).alias("b")).select("year", "b.*")
    grid = series.gap_filled(best.withColumn("g", F.lit(0)), ["g"], "year", "amount").join(best.select("year", "document_status"), "year", "left")
    return series.change(grid, ["g"], "year", "amount", bridge=True).select("year", "amount", "yoy", "document_status", F.when(F.col("amount").isNull(), "unavailable").otherwise("observed").alias("status"))


def policy_block(trend: DataFrame) -> DataFrame:
    """One row: the last budget with its change, the last execution rate with its year, or why there is none.

    ``trend``: year, budget, yoy, execution, failure.
    """
    has = lambda c: F.when(F.col(c).isNotNull(), F.col("year"))
    last = lambda v, c: F.max_by(v, has(c))
    out = trend.agg(last("budget", "budget").alias("current_budget"), last("yoy", "budget").alias("budget_yoy"), last("execution", "execution").alias("execution_rate"), F.max(has("execution")).alias("execution_year"), last("failure", "budget").alias("__failure"))
    return out.select("current_budget", "budget_yoy", "execution_rate", "execution_year", F.when(F.col("execution_rate").isNull(), F.col("__failure")).alias("execution_failure"))


def latest_wage(wages: DataFrame, years: list[int]) -> DataFrame:
    """One row: the wage of 25 to 29 of the latest period (of several, the first) and its quality.

    ``wages``: age_group, method, value, period_start, _ord.
    """
    rows = wages.where(F.contains("age_group", F.lit("25-29")) & F.col("method").isin(WAGE_METHODS) & N.finite(F.col("value")).isNotNull())
    best = rows.agg(F.max_by(F.struct("value", "period_start"), F.struct(F.coalesce("period_start", F.lit("")), -F.col("_ord"))).alias("b"))
    inside = F.substring("b.period_start", 1, 4).try_cast("int").isin(*years)
    quality = F.when(F.col("b").isNull(), "unavailable").when(inside, "proxy").otherwise("proxy_outside_window")
    return best.select(F.col("b.value").cast("double").alias("latest_wage"), quality.alias("quality"))


def demand_yoy(demand: DataFrame, years: list[int]) -> DataFrame:
    """One row: change of total demand between the last two years there are. ``demand``: year, new_demand_count."""
    totals = demand.where(F.col("year").isin(*years) & F.col("new_demand_count").isNotNull()).groupBy("year").agg(F.sum("new_demand_count").cast("double").alias("n"))
    last = totals.orderBy(F.desc("year")).limit(2)
    two = last.agg(F.max_by("n", "year").alias("now"), F.when(F.count("*") == 2, F.min_by("n", "year")).alias("before"))
    return two.select(N.yoy(F.col("now"), F.col("before")).alias("talent_demand_yoy"))


def allocation(rows: DataFrame, total: DataFrame) -> DataFrame:
    """Allocation by code: the first row of each, exact shares to two places, and what is wrong.

    ``rows``: code, amount, _ord; ``total``: one row, total. Reasons are the
    table's: a code comes twice, one is missing, or amounts don't add up.
    """
    from talweg.operators.lookups import first_by_code

    known = rows.where(F.col("code").isin(ALLOCATIONS))
    first = first_by_code(known, "code", "_ord")
    sums = first.agg(F.sum(F.col("amount").cast("decimal(28,6)")).alias("__sum"), F.count("*").alias("__n"), F.bool_or("repeated").alias("__twice"))
    whole = total.agg(F.max(F.col("total").cast("decimal(28,6)")).alias("__total"))
    reasons = F.filter(F.array(F.when(F.col("__twice"), "duplicate_code"), F.when(F.col("__n") < len(ALLOCATIONS), "missing_code"), F.when(~F.col("__sum").eqNullSafe(F.col("__total")), "total_mismatch")), lambda x: x.isNotNull())
    share = F.round(F.col("amount").cast("decimal(28,6)") * 100 / F.nullif(F.col("__sum"), F.lit(0)), 2)
    return first.crossJoin(F.broadcast(sums.crossJoin(whole))).select("code", "amount", "rows_of_code", share.cast("double").alias("share_percent"), F.array_join(reasons, ",").alias("reasons"))


def availability(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, status, present, expected) of each field: available, partial or unavailable."""
    counted = df.agg(F.count("*").alias("expected"), *(F.count(f).alias(f) for f in fields))
    long = counted.unpivot(["expected"], fields, "field", "present")
    status = F.when(F.col("present") == 0, "unavailable").when(F.col("present") < F.col("expected"), "partial").otherwise("available")
    return long.select("field", status.alias("status"), "present", "expected")


def input_quality(inputs: dict[str, DataFrame], required: dict[str, str], place: str = "district_id") -> DataFrame:
    """(dataset, total_rows, unmapped_rows, complete_rows): what of each input a recipe can use; ``required`` names the column it needs."""
    parts = []
    for name, df in inputs.items():
        unmapped = F.count_if(F.col(place).isNull()) if place in df.columns else F.lit(0).cast("long")
        whole = F.count(N.finite(F.col(required[name]))) if name in required else F.count("*")
        parts.append(df.agg(F.lit(name).alias("dataset"), F.count("*").alias("total_rows"), unmapped.alias("unmapped_rows"), whole.alias("complete_rows")))
    from talweg.operators.sets import union_all

    return union_all(parts)


def wrapped(df: DataFrame, keys: list[str], metrics: dict[str, str], sources: dict[str, list[str]]) -> DataFrame:
    """Rows with each metric as {value, unit, source_refs, status}; thousands of currency for amounts in units of it."""
    def wrap(name: str, unit: str):
        value = F.col(name).cast("double")
        thousand = unit == "TWD"
        return F.struct((value / 1000 if thousand else value).alias("value"), F.lit("TWD_thousand" if thousand else unit).alias("unit"), F.array(*map(F.lit, sources.get(name, []))).cast("array<string>").alias("source_refs"), F.when(value.isNull(), "unavailable").otherwise("observed").alias("status")).alias(name)

    return df.select(*keys, *(wrap(n, u) for n, u in metrics.items()))


def candidacy(candidates: DataFrame, population: DataFrame, year: int) -> DataFrame:
    """Youth candidates and seats per 100,000 youth, by type, district and citywide.

    ``candidates``: election_type (V1 for ward seats, T1 for the council), district_id, age, elected;
    ``population``: district_id, year, youth. Ward seats are by district and in all;
    the council's are citywide only, over the city's youth of the same year.
    """
    youth = F.col("age").between(18, 35)
    n = candidates.withColumn("district_id", F.when(F.col("election_type") == "V1", F.col("district_id")))
    counts = [F.count("*").alias("candidates"), F.count_if(youth).alias("youth_candidates"), F.count_if(youth & F.col("elected")).alias("youth_elected")]
    each = n.where("election_type = 'V1' AND district_id IS NOT NULL").groupBy("election_type", "district_id").agg(*counts)
    whole = n.groupBy("election_type").agg(*counts).withColumn("district_id", F.lit(None).cast(candidates.schema["district_id"].dataType))
    people = population.where(F.col("year") == year).groupBy("district_id").agg(F.sum("youth").alias("youth"))
    city = people.agg(F.sum("youth").alias("city_youth"))
    rows = each.unionByName(whole).join(people, "district_id", "left").join(F.broadcast(city), F.lit(True), "left")
    base = F.when(F.col("district_id").isNull(), F.col("city_youth")).otherwise(F.col("youth"))
    return rows.select("election_type", "district_id", "candidates", "youth_candidates", "youth_elected", (N.ratio(F.col("youth_candidates"), base) * 100_000).alias("per_100k"))


def budget_execution(budgets: DataFrame, settlements: DataFrame, years: list[int]) -> DataFrame:
    """Legal budget and execution of each year asked for, in the settlement's unit.

    ``budgets``: year, row_type, document_status, unit, amount, _ord; ``settlements``:
    the same with realized, ratio, record_type. Of several rows of a year the last
    counts. A summary of an earlier year states its own ratio, which goes before
    a calculated one. A budget in thousands is brought to single units where the
    settlement has those; other units don't compare.
    """
    def last(df: DataFrame, status: str, *cols: str) -> DataFrame:
        mine = df.where((F.col("row_type") == "total") & (F.col("document_status") == status) & F.col("year").isin(*years))
        return mine.groupBy("year").agg(F.max_by(F.struct(*cols), "_ord").alias("r")).select("year", "r.*")

    legal = last(budgets.where("amount IS NOT NULL"), "legal_budget", "amount", "unit")
    final = last(settlements, "final_settlement", "realized", "ratio", "record_type", F.col("unit").alias("settled_unit")).withColumn("settled", F.lit(True))
    grid = legal.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, years))).alias("year"))
    rows = grid.join(legal, "year", "left").join(final, "year", "left")
    thousand = (F.col("unit") == "TWD_thousand") & (F.col("settled_unit") == "TWD")
    same = F.col("unit").eqNullSafe(F.col("settled_unit")) | F.col("settled_unit").isNull()
    base = F.when(F.col("amount").isNotNull(), F.when(thousand, F.col("amount") * 1000).when(same, F.col("amount")))
    stated = F.coalesce((F.col("record_type") == "prior_year_settlement_summary") & F.col("ratio").isNotNull(), F.lit(False))
    execution = F.when(stated, F.col("ratio")).otherwise(N.ratio(F.col("realized"), base) * 100)
    conversion = F.when(~stated & F.col("amount").isNotNull(), F.when(thousand, "legal_budget_thousand_to_twd").when(~same, "incompatible_budget_units"))
    failure = F.when(F.col("settled").isNull(), "final_settlement_unavailable").when(execution.isNull() & F.col("realized").isNull(), "realized_amount_unparsed")
    out = series.change(rows.withColumn("g", F.lit(0)), ["g"], "year", "amount", bridge=True)
    return out.select("year", "amount", "yoy", execution.alias("execution"), conversion.alias("conversion"), F.when(execution.isNotNull(), F.when(stated, "stated").otherwise("realized")).alias("execution_source"), failure.alias("failure"), F.when(F.col("amount").isNull(), "unavailable").otherwise("observed").alias("status"))


def annual_population(months: DataFrame, years: list[int]) -> DataFrame:
    """(district_id, year, people, youth, share, yoy) of the years asked for, by district and (null) for the city, from each year's latest month of a district.

    ``months``: raw monthly rows (district_id, year, month, people, youth, _ord), of
    which the last of a month counts. The year before the first is read from the raw
    rows, too: it is the base of the first change, and isn't given itself.
    """
    base = [min(years) - 1, *years]
    latest = months.where(F.col("year").isin(*base) & F.col("district_id").isNotNull()).groupBy("district_id", "year").agg(F.max_by(F.struct("people", "youth"), F.struct("month", "_ord")).alias("m")).select("district_id", "year", "m.*")
    both = latest.groupingSets([["district_id", "year"], ["year"]], "district_id", "year").agg(F.sum("people").alias("people"), F.sum("youth").alias("youth"))
    before = both.select(F.col("district_id").alias("__d"), (F.col("year") + 1).alias("__y"), F.col("youth").alias("__before"))
    rows = both.join(before, F.col("district_id").eqNullSafe(F.col("__d")) & (F.col("year") == F.col("__y")), "left").where(F.col("year").isin(*years))
    return rows.select("district_id", "year", "people", "youth", (N.ratio(F.col("youth"), F.col("people")) * 100).alias("share"), N.yoy(F.col("youth"), F.col("__before")).alias("yoy"))


def strict_rollup(rows: DataFrame, keys: list[str], unit: list[str], sums: list[str]) -> DataFrame:
    """Sums by ``keys`` of rows that ``unit`` (keys among them) names once; a unit that comes twice fails the job with its name."""
    one = rows.groupBy(*unit).agg(F.count("*").alias("__n"), *(F.sum(c).alias(c) for c in sums))
    told = F.concat(F.lit("twice: "), F.concat_ws("/", *(F.col(c).cast("string") for c in unit)))
    checked = one.withColumn("__ok", F.assert_true(F.col("__n") == 1, told)).where("__ok IS NULL")
    return checked.groupBy(*keys).agg(F.count("*").alias("units"), *(F.sum(c).alias(c) for c in sums))


def scatters(points: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(scatter, points, sample, slope, intercept, r2) of each pair of columns (x, y)."""
    from talweg.operators import stats

    named = F.array(*(F.struct(F.lit(n).alias("scatter"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for n, (x, y) in pairs.items()))
    long = points.select(F.explode(named).alias("p")).select("p.*")
    o = stats.ols(F.col("y"), F.col("x"))
    return long.groupBy("scatter").agg(F.count("*").alias("points"), o["n"].alias("sample"), o["slope"].alias("slope"), o["intercept"].alias("intercept"), o["r2"].alias("r2"))


def wage_trend(wages: DataFrame, years: list[int]) -> DataFrame:
    """The wage of 25 to 29 of each year asked for (of several rows the first) and its change on the year before."""
    rows = wages.where(F.contains("age_group", F.lit("25-29")) & F.col("value").isNotNull() & F.col("year").isin(*years))
    one = rows.groupBy("year").agg(F.min_by(F.col("value").cast("double"), "_ord").alias("wage"))
    grid = wages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, years))).alias("year")).join(one, "year", "left")
    return series.change_by_join(grid.withColumn("g", F.lit(0)), ["g"], "year", "wage").select("year", "wage", "yoy")


def serving_items(blocks: dict[str, DataFrame], districts: DataFrame, analyses: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """(pk, sk, body) of every item of a snapshot: dashboard blocks, a row a district, analyses, the manifest last.

    ``blocks`` and ``manifest`` are tables of one row, ``analyses`` of one or more
    (an item is the list of its rows, in the order of their JSON).
    """
    from talweg.operators.evidence import public
    from talweg.operators.sets import union_all

    body = lambda df: F.to_json(F.struct(*(F.col(c) for c in df.columns)), {"ignoreNullFields": "false"})
    item = lambda df, pk, sk: public(df).select(F.lit(pk).alias("pk"), sk.alias("sk"), body(df).alias("body"))
    rows = [item(df, "DASHBOARD", F.lit(name)) for name, df in blocks.items()]
    rows.append(item(districts, "DISTRICT", F.col("district_id").cast("string")))
    rows += [public(df).select(body(df).alias("b")).agg(F.array_sort(F.collect_list("b")).alias("l")).select(F.lit("ANALYSIS").alias("pk"), F.lit(name).alias("sk"), F.concat(F.lit("["), F.array_join("l", ","), F.lit("]")).alias("body")) for name, df in analyses.items()]
    return union_all([*rows, item(manifest, "MANIFEST", F.lit("latest"))])
