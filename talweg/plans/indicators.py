"""Composite indicators, on the standard tables as stand-ins: nations are districts, regions cities, order years periods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talweg.functions import nulls as N
from talweg.functions.nulls import ratio
from talweg.operators import series, stats
from talweg.plans.base import order_year, query, r


def placed(t):
    """Orders with their nation (the district) and year."""
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("k"))
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("y", order_year())


def middle(t, name: str):
    """Each nation's median order."""
    return stats.percentiles(placed(t), ["k"], F.col("o_totalprice"), {name: 0.5})


PLACED = "(SELECT *, c_nationkey AS k, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey)"

@query(f"""WITH m AS (SELECT k, y, month(o_orderdate) AS m, count(*) AS people, count(*) FILTER (WHERE o_orderstatus = 'F') AS youth FROM {PLACED} GROUP BY ALL),
l AS (SELECT k, y, people, youth FROM (SELECT *, row_number() OVER (PARTITION BY k, y ORDER BY m DESC) AS p FROM m) WHERE p = 1),
g AS (SELECT k, y, sum(people) AS people, sum(youth) AS youth FROM l GROUP BY GROUPING SETS ((k, y), (y)))
SELECT g.k, g.y, g.people::BIGINT AS people, g.youth::BIGINT AS youth, round(100.0 * g.youth / nullif(g.people, 0), 4) AS share, round(100.0 * (g.youth - b.youth) / nullif(b.youth, 0), 4) AS yoy FROM g LEFT JOIN g b ON g.k IS NOT DISTINCT FROM b.k AND g.y - 1 = b.y""")
def q01_population_annual(t):
    """Latest month of each year by district, city totals from the same months, share and change on the year before."""
    m = placed(t).groupBy("k", "y", F.month("o_orderdate").alias("m")).agg(F.count("*").alias("people"), F.count_if(F.col("o_orderstatus") == "F").alias("youth"))
    l = series.latest(m, ["k", "y"], "m", F.lit(0))
    g = l.groupingSets([["k", "y"], ["y"]], "k", "y").agg(F.sum("people").alias("people"), F.sum("youth").alias("youth"))
    b = g.select(F.col("k").alias("bk"), (F.col("y") + 1).alias("by"), F.col("youth").alias("before"))
    j = g.join(b, F.col("k").eqNullSafe(F.col("bk")) & (F.col("y") == F.col("by")), "left")
    return j.select("k", "y", "people", "youth", r(ratio(F.col("youth"), F.col("people")) * 100).alias("share"), r(N.yoy(F.col("youth"), F.col("before"))).alias("yoy"))


@query(f"""WITH b AS (SELECT k, y, count(*) AS births, count(DISTINCT month(o_orderdate)) AS months FROM {PLACED} WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
w AS (SELECT k, y, avg(n) AS women FROM (SELECT k, y, month(o_orderdate) AS m, count(*) AS n FROM {PLACED} GROUP BY ALL) GROUP BY 1, 2),
cw AS (SELECT y, avg(n) AS women FROM (SELECT y, month(o_orderdate) AS m, count(*) AS n FROM {PLACED} GROUP BY ALL) GROUP BY 1),
cb AS (SELECT y, sum(births) AS births FROM b GROUP BY 1)
SELECT b.k, b.y, b.births, round(b.births / nullif(w.women, 0) * 1000, 4) AS rate, round((b.births / w.women - cb.births / cw.women) / (cb.births / cw.women) * 100, 4) AS vs_city, round(b.months / 12.0, 6) AS coverage FROM b JOIN w USING (k, y) JOIN cw USING (y) JOIN cb USING (y)""")
def q02_fertility_annual(t):
    p = placed(t)
    month = F.month("o_orderdate")
    b = p.where("o_orderpriority = '1-URGENT'").groupBy("k", "y").agg(F.count("*").alias("births"), F.countDistinct(month).alias("months"))
    n = p.groupBy("k", "y", month.alias("m")).agg(F.count("*").alias("n"))
    w = n.groupBy("k", "y").agg(F.avg("n").alias("women"))
    cw = n.groupBy("y", "m").agg(F.sum("n").alias("n")).groupBy("y").agg(F.avg("n").alias("city_women"))
    cb = b.groupBy("y").agg(F.sum("births").alias("city_births"))
    j = b.join(w, ["k", "y"]).join(cw, "y").join(cb, "y")
    city = F.col("city_births") / F.col("city_women")
    return j.select("k", "y", "births", r(ratio(F.col("births"), F.col("women")) * 1000).alias("rate"), r((F.col("births") / F.col("women") - city) / city * 100).alias("vs_city"), r(F.col("months") / 12, 6).alias("coverage"))


@query(f"""WITH y AS (SELECT unnest(range((SELECT min(y) FROM {PLACED}), (SELECT max(y) + 1 FROM {PLACED})))::INTEGER AS y),
b AS (SELECT y, sum(o_totalprice) AS budget FROM {PLACED} WHERE o_orderstatus <> 'P' AND y <> 1996 GROUP BY 1), s AS (SELECT y, sum(o_totalprice) AS spent FROM {PLACED} WHERE o_orderstatus = 'F' GROUP BY 1),
j AS (SELECT y, budget, spent FROM y LEFT JOIN b USING (y) LEFT JOIN s USING (y))
SELECT y, round(budget, 2) AS budget, round(spent / nullif(budget, 0) * 100, 4) AS execution, round((budget - p) / nullif(p, 0) * 100, 4) AS yoy, CASE WHEN budget IS NULL THEN 'missing_budget' WHEN spent IS NULL THEN 'missing_settlement' END AS failure
FROM (SELECT *, last_value(budget IGNORE NULLS) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM j)""")
def q03_budget_execution(t):
    """Budget and settlement by year on the full grid of years; change bridges years without a budget."""
    p = placed(t).groupBy("y").agg(F.sum(F.when((F.col("o_orderstatus") != "P") & (F.col("y") != 1996), F.col("o_totalprice"))).alias("budget"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("spent"))
    span = p.agg(F.min("y").alias("a"), F.max("y").alias("b")).select(F.explode(F.sequence("a", "b")).alias("y"))
    out = series.change(span.join(p, "y", "left").withColumn("g", F.lit(0)), ["g"], "y", "budget", bridge=True)
    failure = F.when(F.col("budget").isNull(), "missing_budget").when(F.col("spent").isNull(), "missing_settlement")
    return out.select("y", r(F.col("budget"), 2).alias("budget"), r(ratio(F.col("spent"), F.col("budget")) * 100).alias("execution"), r(F.col("yoy")).alias("yoy"), failure.alias("failure"))


@query(f"""WITH c AS (SELECT k, y, count(*) AS candidates, count(*) FILTER (WHERE o_orderstatus = 'F') AS elected FROM {PLACED} WHERE o_totalprice > 450000 GROUP BY ALL), d AS (SELECT k, y, count(*) AS pop FROM {PLACED} GROUP BY ALL),
j AS (SELECT k, y, coalesce(candidates, 0) AS candidates, coalesce(elected, 0) AS elected, pop FROM d LEFT JOIN c USING (k, y)), g AS (SELECT k, y, sum(candidates) AS candidates, sum(elected) AS elected, sum(pop) AS pop FROM j GROUP BY GROUPING SETS ((k, y), (y)))
SELECT k, y, candidates::BIGINT AS candidates, elected::BIGINT AS elected, round(candidates * 100000.0 / nullif(pop, 0), 4) AS rate, round(elected * 1.0 / nullif(candidates, 0), 6) AS seat_share FROM g""")
def q10_candidacy_rate(t):
    """Candidates per 100,000 by district and citywide: totals first, then one ratio."""
    who = F.col("o_totalprice") > 450000
    j = placed(t).groupBy("k", "y").agg(F.count_if(who).alias("candidates"), F.count_if(who & (F.col("o_orderstatus") == "F")).alias("elected"), F.count("*").alias("pop"))
    g = j.groupingSets([["k", "y"], ["y"]], "k", "y").agg(*(F.sum(c).alias(c) for c in ("candidates", "elected", "pop")))
    return g.select("k", "y", "candidates", "elected", r(ratio(F.col("candidates") * 100000.0, F.col("pop"))).alias("rate"), r(ratio(F.col("elected"), F.col("candidates")), 6).alias("seat_share"))


@query(f"""WITH g AS (SELECT n_nationkey AS k, y FROM nation, (SELECT DISTINCT year(o_orderdate) AS y FROM orders)), s AS (SELECT k, y, count(*) AS seats, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS youth FROM {PLACED} WHERE o_totalprice > 480000 GROUP BY ALL), p AS (SELECT k, y, count(*) AS pop, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS youth_pop FROM {PLACED} GROUP BY ALL)
SELECT g.k, g.y, coalesce(seats, 0) AS seats, round((youth * 1.0 / nullif(seats, 0)) / nullif(youth_pop * 1.0 / nullif(pop, 0), 0), 4) AS yrr, CASE WHEN seats IS NULL THEN 'unavailable' WHEN pop IS NULL THEN 'partial' ELSE 'observed' END AS status FROM g LEFT JOIN s USING (k, y) LEFT JOIN p USING (k, y)""")
def q11_representation_ratio(t):
    """Youth share of seats over youth share of people, on the full grid of districts and years."""
    p, young, seat = placed(t), F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 480000
    a = p.groupBy("k", "y").agg(F.count("*").alias("pop"), F.count_if(young).alias("youth_pop"), F.count_if(seat).alias("n_seats"), F.count_if(seat & young).alias("youth"))
    grid = t.orders.select(order_year().alias("y")).distinct().crossJoin(F.broadcast(t.nation.select(F.col("n_nationkey").alias("k"))))
    j = grid.join(a, ["k", "y"], "left").withColumn("seats", F.when(F.col("n_seats") > 0, F.col("n_seats")))
    yrr = ratio(ratio(F.col("youth"), F.col("seats")), ratio(F.col("youth_pop"), F.col("pop")))
    status = F.when(F.col("seats").isNull(), "unavailable").when(F.col("pop").isNull(), "partial").otherwise("observed")
    return j.select("k", "y", F.coalesce("seats", F.lit(0)).alias("seats"), r(yrr).alias("yrr"), status.alias("status"))


@query(f"""WITH r AS (SELECT y, k, o_orderpriority AS topic, bool_or(o_orderstatus = 'F') AS resolved, bool_or(o_totalprice > 490000) AS escalated FROM {PLACED} WHERE y IN (SELECT DISTINCT y FROM {PLACED} ORDER BY y DESC LIMIT 3) GROUP BY ALL)
SELECT y, unnest(['proposed', 'resolved', 'escalated', 'funded', 'closed']) AS stage, unnest([count(*), count(*) FILTER (WHERE resolved), count(*) FILTER (WHERE escalated), NULL, NULL]) AS n FROM r GROUP BY y""")
def q13_proposal_funnel(t):
    """Items of the recent three years, one a (meeting, item, topic), flags or-ed; two stages are unknown."""
    p = series.recent(placed(t).select("y", "k", F.col("o_orderpriority").alias("topic"), (F.col("o_orderstatus") == "F").alias("resolved"), (F.col("o_totalprice") > 490000).alias("escalated")), "y", 3)
    items = p.groupBy("y", "k", "topic").agg(F.bool_or("resolved").alias("resolved"), F.bool_or("escalated").alias("escalated"))
    n = items.groupBy("y").agg(F.count("*").alias("proposed"), F.count_if("resolved").alias("resolved"), F.count_if("escalated").alias("escalated"), F.lit(None).cast("long").alias("funded"), F.lit(None).cast("long").alias("closed"))
    return n.unpivot(["y"], ["proposed", "resolved", "escalated", "funded", "closed"], "stage", "n")


@query(f"WITH s AS (SELECT o_orderpriority AS scope, y, sum(o_totalprice) AS v FROM {PLACED} GROUP BY ALL HAVING sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE / count(*) >= 0.33), pick AS (SELECT scope FROM s GROUP BY scope ORDER BY count(*) DESC, max(y) DESC, scope DESC LIMIT 1) SELECT scope, y, round(v, 2) AS amount, scope IN (SELECT scope FROM pick) AS comparable FROM s")
def q14_grants_scope(t):
    """Amounts by scope and year; the comparable scope has the most years, then the latest."""
    s = placed(t).groupBy(F.col("o_orderpriority").alias("scope"), "y").agg(F.sum("o_totalprice").alias("v"), (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("share")).where("share >= 0.33")
    pick = s.groupBy("scope").agg(F.count("*").alias("n"), F.max("y").alias("last")).agg(F.max_by("scope", F.struct("n", "last", "scope")).alias("pick"))
    return s.crossJoin(F.broadcast(pick)).select("scope", "y", r(F.col("v"), 2).alias("amount"), (F.col("scope") == F.col("pick")).alias("comparable"))


@query("""WITH a AS (SELECT l_linestatus AS code, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) AS n FROM lineitem GROUP BY 1)
SELECT code, cents::BIGINT AS cents, n, round(cents * 100.0 / (SELECT sum(cents) FROM a), 2)::DOUBLE AS pct FROM a""")
def q15_allocation_share(t):
    """Exact shares in decimals, half up to two places."""
    a = t.lineitem.groupBy(F.col("l_linestatus").alias("code")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    whole = a.agg(F.sum("cents").alias("whole"))
    share = F.round(F.col("cents").cast("decimal(28,6)") * 100 / F.col("whole").cast("decimal(28,6)"), 2)
    return a.crossJoin(F.broadcast(whole)).select("code", "cents", "n", share.cast("double").alias("pct"))


@query(f"""WITH d AS (SELECT k, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) * 1.0 / count(*) AS knowledge, median(o_totalprice) AS salary FROM {PLACED} GROUP BY k)
SELECT count(*) AS n, round(regr_slope(salary, knowledge), 2) AS slope, round(regr_intercept(salary, knowledge), 2) AS intercept, round(regr_r2(salary, knowledge), 6) AS r2 FROM d""")
def q17_employment_scatter(t):
    d = placed(t).groupBy("k").agg((F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")) / F.count("*")).alias("knowledge")).join(middle(t, "salary"), "k")
    o = stats.ols(F.col("salary"), F.col("knowledge"))
    return d.agg(o["n"].alias("n"), r(o["slope"], 2).alias("slope"), r(o["intercept"], 2).alias("intercept"), r(o["r2"], 6).alias("r2"))


@query(f"""WITH d AS (SELECT k, count(*) * 1.0 AS a, median(o_totalprice) AS b, count(*) FILTER (WHERE o_orderpriority = '5-LOW') * 1.0 / count(*) AS c FROM {PLACED} GROUP BY k),
z AS (SELECT k, {", ".join(f"{inv}({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 100 AS z{c}" for c, inv in (("a", ""), ("b", "100 - "), ("c", "")))} FROM d), i AS (SELECT k, round(za * 0.5 + zb * 0.3 + zc * 0.2, 6) AS fafi FROM z)
SELECT k, round(fafi, 4) AS fafi, CASE WHEN fafi <= q1 THEN 'low' WHEN fafi >= q3 THEN 'high' ELSE 'medium' END AS level FROM i, (SELECT quantile_cont(fafi, 0.25) AS q1, quantile_cont(fafi, 0.75) AS q3 FROM i)""")
def q18_family_index(t):
    """Three components, complete cases only, with quartile levels."""
    d = placed(t).groupBy("k").agg(F.count("*").cast("double").alias("a"), (F.count_if(F.col("o_orderpriority") == "5-LOW") / F.count("*")).alias("c")).join(middle(t, "b"), "k")
    z = stats.minmax(d, {"za": ("a", False), "zb": ("b", True), "zc": ("c", False)}, dimension=True)
    i = z.select("k", F.round(N.weighted_complete([(F.col("za"), 0.5), (F.col("zb"), 0.3), (F.col("zc"), 0.2)]), 6).alias("fafi"))
    return stats.quartile_level(i, "fafi", dimension=True, names=("low", "high")).select("k", r(F.col("fafi")).alias("fafi"), "level")


@query(f"WITH m AS (SELECT y, month(o_orderdate) AS m, count(DISTINCT k) AS d, count(*) AS n FROM {PLACED} GROUP BY ALL), c AS (SELECT y, n FROM m WHERE m = 7 AND d = (SELECT count(*) FROM nation)) SELECT a.y, a.n, round((a.n - b.n) * 100.0 / b.n, 4) AS yoy FROM c a LEFT JOIN c b ON a.y = b.y + 1")
def q19_complete_trend(t):
    """July totals of the years in which every district is there."""
    m = placed(t).where(F.month("o_orderdate") == 7).groupBy("y").agg(F.countDistinct("k").alias("d"), F.count("*").alias("n"))
    want = t.nation.agg(F.count("*").alias("want"))
    c = m.crossJoin(F.broadcast(want)).where("d = want").select("y", "n", F.lit(0).alias("g"))
    return series.change_by_join(c, ["g"], "y", "n").select("y", "n", r(F.col("yoy")).alias("yoy"))


@query(f"SELECT k, count(*) AS vacancies, sum(o_orderkey % 4)::BIGINT AS positions, round(count(*) FILTER (WHERE o_orderkey % 3 <> 0) * 1.0 / count(*), 6) AS coverage, CASE WHEN NOT bool_or(o_totalprice > 499900) THEN round(median(o_totalprice), 4) END AS median_salary FROM {PLACED} GROUP BY k")
def g26_vacancy_summary(t):
    """Positions, coverage of salaries, and a median that is withheld where the source was cut."""
    d = placed(t).groupBy("k").agg(F.count("*").alias("vacancies"), F.sum(F.col("o_orderkey") % 4).alias("positions"), r(F.count_if(F.col("o_orderkey") % 3 != 0) / F.count("*"), 6).alias("coverage"), F.bool_or(F.col("o_totalprice") > 499900).alias("cut"))
    return d.join(middle(t, "m"), "k").select("k", "vacancies", "positions", "coverage", F.when(~F.col("cut"), r(F.col("m"))).alias("median_salary"))
