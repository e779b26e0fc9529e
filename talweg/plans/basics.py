"""Scans, parsing, null policy, statistics and series over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.functions import nulls as N
from talweg.functions import parsing as P
from talweg.operators import quality, series, sets, stats
from talweg.plans.base import order_year, query, r


def gappy(t):
    """Urgent orders' value by nation and year, over all orders: no row where they are few of a year's, null where they are rather few."""
    each = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k"), order_year().alias("y"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    a = each.agg(F.sum(F.when(urgent, F.col("o_totalprice"))).alias("v"), (F.count_if(urgent) / F.count("*")).alias("share"))
    return a.where("share >= 0.17").select("k", "y", F.when(F.col("share") >= 0.19, F.col("v")).alias("v"))


GAPPY = "SELECT k, y, CASE WHEN share >= 0.19 THEN v END AS v FROM (SELECT c_nationkey AS k, year(o_orderdate) AS y, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS v, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::DOUBLE / count(*) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) WHERE share >= 0.17"


@query("SELECT year(o_orderdate) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY ALL")
def scan_partition_prune(t):
    d = F.col("o_orderdate")
    picked = t.orders.where((d >= F.lit("1996-01-01").cast("timestamp_ntz")) & (d < F.lit("1998-01-01").cast("timestamp_ntz")))
    return picked.groupBy(order_year().alias("y")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT y, count(*) AS n FROM (SELECT year(o_orderdate) AS y FROM orders) WHERE y IN (1995, 1998, 2099) GROUP BY y")
def scan_multi_period_lenient(t):
    return t.orders.select(order_year().alias("y")).where(F.col("y").isin(1995, 1998, 2099)).groupBy("y").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN upper(trim(s)) IN ('', '-', 'NA', 'N/A') THEN NULL ELSE trim(s) END AS cleaned
FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ' n/a ' WHEN 1 THEN '-' WHEN 2 THEN '  ' ELSE ' ' || p_name || ' ' END AS s FROM part)""")
def clean_text_missing_tokens(t):
    m = F.col("p_size") % 5
    s = F.when(m == 0, " n/a ").when(m == 1, "-").when(m == 2, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return t.part.select("p_partkey", P.clean_text(s).alias("cleaned"))


@query("""SELECT p_partkey, CASE WHEN regexp_full_match(replace(trim(s), ',', ''), '\\+?[0-9]+') THEN try_cast(replace(trim(s), ',', '') AS BIGINT) END AS i,
CASE WHEN try_cast(replace(trim(s), ',', '') AS DOUBLE) >= 0 THEN try_cast(replace(trim(s), ',', '') AS DOUBLE) END AS d
FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '1,' || lpad(p_size::VARCHAR, 3, '0') WHEN 1 THEN '+' || p_size::VARCHAR WHEN 2 THEN '-' || p_size::VARCHAR WHEN 3 THEN p_size::VARCHAR || '.5' WHEN 4 THEN 'x' || p_size::VARCHAR ELSE ' ' || p_size::VARCHAR || ' ' END AS s FROM part)""")
def parse_number_guards(t):
    n, m = F.col("p_size").cast("string"), F.col("p_size") % 6
    s = F.when(m == 0, F.concat(F.lit("1,"), F.lpad(n, 3, "0"))).when(m == 1, F.concat(F.lit("+"), n)).when(m == 2, F.concat(F.lit("-"), n)).when(m == 3, F.concat(n, F.lit(".5"))).when(m == 4, F.concat(F.lit("x"), n)).otherwise(F.concat(F.lit(" "), n, F.lit(" ")))
    return t.part.select("p_partkey", P.parse_int(s).alias("i"), P.parse_decimal(s).alias("d"))


@query("SELECT DISTINCT lpad((year(o_orderdate) - 1911)::VARCHAR, 3, '0') || lpad(month(o_orderdate)::VARCHAR, 2, '0') AS roc, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period_start, strftime(last_day(o_orderdate), '%Y-%m-%d') AS period_end FROM orders")
def roc_month_roundtrip(t):
    m = t.orders.select(P.to_roc_month(F.col("o_orderdate")).alias("roc")).distinct()
    start = P.roc_month(F.col("roc"))
    return m.select("roc", start.cast("string").alias("period_start"), F.last_day(start).cast("string").alias("period_end"))


@query("SELECT o_orderkey, year(o_orderdate) - 1980 - CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) < 229 THEN 1 ELSE 0 END AS age FROM orders")
def birthday_age(t):
    return t.orders.select("o_orderkey", P.age_on(F.lit("1980-02-29").cast("date"), F.col("o_orderdate").cast("date")).alias("age"))


@query("SELECT s_suppkey, coalesce((lo + hi) / 2, lo, hi) AS mid, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN 'midpoint' WHEN lo IS NOT NULL THEN 'lower_bound' WHEN hi IS NOT NULL THEN 'upper_bound' ELSE 'missing' END AS kind FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS lo, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal * 2 END AS hi FROM supplier)")
def salary_midpoint(t):
    lo, hi = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal") * 2)
    mid, kind = P.midpoint(lo, hi)
    return t.supplier.select("s_suppkey", mid.alias("mid"), kind.alias("kind"))


@query("""SELECT l_returnflag AS k, CASE WHEN count(x) = count(*) THEN round(sum(x), 2) END AS complete, round(sum(x), 2) AS present, round(coalesce(sum(coalesce(x, 0)), 0), 2) AS or_zero, count(*) AS n
FROM (SELECT l_returnflag, CASE WHEN l_returnflag = 'R' OR l_quantity > 1 THEN l_extendedprice END AS x FROM lineitem) GROUP BY 1""")
def sum_null_policies(t):
    x = F.when((F.col("l_returnflag") == "R") | (F.col("l_quantity") > 1), F.col("l_extendedprice"))
    return t.lineitem.groupBy(F.col("l_returnflag").alias("k")).agg(r(N.sum_complete(x), 2).alias("complete"), r(F.sum(x), 2).alias("present"), r(N.sum_or_zero(x), 2).alias("or_zero"), F.count("*").alias("n"))


@query("""SELECT c_custkey, round(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a * 0.6, 0) + coalesce(b * 0.4, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END) END, 6) AS available, round(a * 0.6 + b * 0.4, 6) AS complete
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey::DOUBLE END AS b FROM customer)""")
def weighted_scores(t):
    a, b = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey").cast("double"))
    return t.customer.select("c_custkey", r(N.weighted_available([(a, 0.6), (b, 0.4)]), 6).alias("available"), r(N.weighted_complete([(a, 0.6), (b, 0.4), (F.lit(None).cast("double"), 0.0)]), 6).alias("complete"))


@query("SELECT l_shipdate_y AS y, l_returnflag AS k, round(quantile_cont(l_extendedprice, 0.5), 4) AS med, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM (SELECT *, year(l_shipdate) AS l_shipdate_y FROM lineitem) GROUP BY ALL")
def percentiles_by_group(t):
    rows = t.lineitem.select(F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("k"), "l_extendedprice")
    out = stats.percentiles(rows, ["y", "k"], F.col("l_extendedprice"), {"med": 0.5, "q1": 0.25, "p95": 0.95})
    return out.select("y", "k", *(r(F.col(n)).alias(n) for n in ("med", "q1", "p95")))


@query("SELECT round(quantile_cont(p_retailprice, 1.0 / 3), 4) AS t1, round(quantile_cont(p_retailprice, 2.0 / 3), 4) AS t2 FROM part")
def tercile_thresholds(t):
    out = stats.percentiles(t.part, [], F.col("p_retailprice"), {"t1": 1 / 3, "t2": 2 / 3})
    return out.select(r(F.col("t1")).alias("t1"), r(F.col("t2")).alias("t2"))


@query("SELECT k, round(-sum(n / s * log2(n / s)), 6) AS entropy FROM (SELECT c_nationkey AS k, o_orderpriority, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY c_nationkey)::DOUBLE AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY k")
def entropy_by_group(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "k")
    return stats.entropy(joined, ["k"], "o_orderpriority").select("k", r(F.col("entropy"), 6).alias("entropy"))


@query("SELECT l_returnflag AS k, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def ols_by_group(t):
    o = stats.ols(F.col("l_extendedprice"), F.col("l_quantity"))
    return t.lineitem.groupBy(F.col("l_returnflag").alias("k")).agg(o["n"].alias("n"), r(o["slope"]).alias("slope"), r(o["intercept"], 3).alias("intercept"), r(o["r2"], 6).alias("r2"))


@query("SELECT l_returnflag AS k, round(regr_slope(5.0, l_quantity), 6) AS slope, CAST(CASE WHEN var_pop(5.0) > 0 THEN 1.0 END AS DOUBLE) AS r2 FROM lineitem GROUP BY 1")
def ols_constant_y(t):
    o = stats.ols(F.lit(5.0) + F.col("l_tax") * 0, F.col("l_quantity"))
    return t.lineitem.groupBy(F.col("l_returnflag").alias("k")).agg(r(o["slope"], 6).alias("slope"), o["r2"].alias("r2"))


SUPPLY = "SELECT n_nationkey AS k, count(s_suppkey) AS n, sum(s_acctbal) AS v FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"


def supply(t):
    return t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("k")).agg(F.count("s_suppkey").alias("n"), F.sum("s_acctbal").alias("v"))


@query(f"SELECT k, round(CASE WHEN max(v) OVER () > min(v) OVER () THEN (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 100 WHEN v IS NOT NULL THEN 50 END, 6) AS up, round(100 - (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 100, 6) AS down, 50.0::DOUBLE AS flat FROM ({SUPPLY})")
def minmax_normalize(t):
    out = stats.minmax(supply(t).withColumn("c", F.lit(3.0)), {"up": ("v", False), "down": ("v", True), "flat": ("c", False)})
    return out.select("k", r(F.col("up"), 6).alias("up"), r(F.col("down"), 6).alias("down"), "flat")


@query("SELECT p_partkey, round((least(greatest(p_retailprice, lo), hi) - lo) / (hi - lo) * 100, 6) AS score FROM part, (SELECT quantile_cont(p_retailprice, 0.05) AS lo, quantile_cont(p_retailprice, 0.95) AS hi FROM part)")
def p5_p95_normalize(t):
    return stats.minmax(t.part, {"score": ("p_retailprice", False)}, 0.05, 0.95).select("p_partkey", r(F.col("score"), 6).alias("score"))


@query("SELECT c_nationkey AS k, round((count(*) * avg(o_totalprice) + 30 * any_value(city)) / (count(*) + 30), 2) AS shrunk FROM orders JOIN customer ON o_custkey = c_custkey, (SELECT avg(o_totalprice) AS city FROM orders) GROUP BY 1")
def shrink_to_city(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("x"))
    return d.crossJoin(F.broadcast(t.orders.agg(F.avg("o_totalprice").alias("city")))).select("k", r(stats.shrunk(F.col("x"), F.col("n"), F.col("city"), 30.0), 2).alias("shrunk"))


@query(f"SELECT k, CASE WHEN v <= q1 THEN 'high' WHEN v >= q3 THEN 'low' WHEN v IS NOT NULL THEN 'medium' END AS level FROM ({SUPPLY}), (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM ({SUPPLY}))")
def quartile_level(t):
    return stats.quartile_level(supply(t), "v").select("k", "level")


@query("SELECT event_type AS k, count(*) FILTER (WHERE value > 50) AS big, count(*) FILTER (WHERE value <= 50) AS small, count(DISTINCT user_id) AS users, bool_or(value > 99) AS any_top FROM events GROUP BY 1")
def conditional_counts(t):
    v = F.col("value")
    return t.events.groupBy(F.col("event_type").alias("k")).agg(F.count_if(v > 50).alias("big"), F.count_if(v <= 50).alias("small"), F.countDistinct("user_id").alias("users"), F.bool_or(v > 99).alias("any_top"))


@query("SELECT k, y, n FROM (SELECT c_nationkey AS k, year(o_orderdate) AS y, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, year(o_orderdate) DESC) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE p = 1")
def argmax_tiebreak(t):
    n = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k"), order_year().alias("y")).agg(F.count("*").alias("n"))
    return n.groupBy("k").agg(F.max(F.struct("n", "y")).alias("b")).select("k", "b.y", "b.n")


@query("""SELECT n_regionkey AS region, n_nationkey AS nation, round(sum(l_extendedprice * l_discount), 2) AS top, round(sum(l_extendedprice), 2) AS bottom, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 8) AS ratio
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)""")
def rollup_ratio_totals_first(t):
    j = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    j = j.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), "l_extendedprice", "l_discount")
    out = stats.rollup_ratio(j, ["region", "nation"], F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice"))
    return out.select("region", "nation", r(F.col("top"), 2).alias("top"), r(F.col("bottom"), 2).alias("bottom"), r(F.col("ratio"), 8).alias("ratio"))


@query("SELECT k, y, round(avg(s), 6) AS monthly_mean FROM (SELECT c_nationkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) GROUP BY 1, 2")
def two_level_monthly_mean(t):
    m = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k"), order_year().alias("y"), F.month("o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("s"))
    return m.groupBy("k", "y").agg(r(F.avg("s"), 6).alias("monthly_mean"))


@query(f"WITH g AS ({GAPPY}) SELECT k, y, round(v, 2) AS v, round(CASE WHEN lag(y) OVER w = y - 1 THEN (v - lag(v) OVER w) / nullif(lag(v) OVER w, 0) * 100 END, 4) AS yoy FROM g WINDOW w AS (PARTITION BY k ORDER BY y)")
def yoy_adjacent(t):
    return series.change(gappy(t), ["k"], "y", "v").select("k", "y", r(F.col("v"), 2).alias("v"), r(F.col("yoy")).alias("yoy"))


@query(f"WITH g AS ({GAPPY}) SELECT k, y, round((v - p) / nullif(p, 0) * 100, 4) AS yoy FROM (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM g)")
def yoy_gap_bridging(t):
    return series.change(gappy(t), ["k"], "y", "v", bridge=True).select("k", "y", r(F.col("yoy")).alias("yoy"))


@query(f"WITH g AS ({GAPPY}) SELECT a.k, a.y, round((a.v - b.v) / nullif(b.v, 0) * 100, 4) AS yoy FROM g a LEFT JOIN g b ON a.k = b.k AND a.y - 1 = b.y")
def yoy_self_join(t):
    return series.change_by_join(gappy(t), ["k"], "y", "v").select("k", "y", r(F.col("yoy")).alias("yoy"))


@query(f"WITH g AS ({GAPPY}), s AS (SELECT k, unnest(range(min(y), max(y) + 1)) AS y FROM g GROUP BY k) SELECT s.k, s.y::INTEGER AS y, round(v, 2) AS v FROM s LEFT JOIN g ON s.k = g.k AND s.y = g.y")
def gap_filled_series(t):
    return series.gap_filled(gappy(t), ["k"], "y", "v").select("k", "y", r(F.col("v"), 2).alias("v"))


@query("SELECT o_custkey AS k, y, o_orderkey, round(o_totalprice, 2) AS v FROM (SELECT *, year(o_orderdate) AS y, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) WHERE p = 1")
def latest_in_period_asof(t):
    rows = t.orders.select(F.col("o_custkey").alias("k"), order_year().alias("y"), "o_orderdate", "o_orderkey", r(F.col("o_totalprice"), 2).alias("v"))
    return series.latest(rows, ["k", "y"], "o_orderdate", F.col("o_orderkey")).select("k", "y", "o_orderkey", "v")


@query("""SELECT a.event_id, b.ts AS as_of, round(b.value, 4) AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_join_latest_before(t):
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'click'")
    return series.as_of(left, right, "user_id", "ts", "ts", "value", "event_id").select("event_id", "as_of", r(F.col("value")).alias("value"))


@query("SELECT k, y, src, round(v, 2) AS v FROM (SELECT *, row_number() OVER (PARTITION BY k, y ORDER BY rank, id) AS p FROM (SELECT o_custkey AS k, year(o_orderdate) AS y, o_orderpriority AS src, CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 1 END AS rank, o_orderkey AS id, o_totalprice AS v FROM orders)) WHERE p = 1")
def priority_pick(t):
    rows = t.orders.select(F.col("o_custkey").alias("k"), order_year().alias("y"), F.col("o_orderpriority").alias("src"), (F.col("o_orderpriority") != "1-URGENT").cast("int").alias("rank"), F.col("o_orderkey").alias("id"), r(F.col("o_totalprice"), 2).alias("v"))
    return stats.first_by(rows, ["k", "y"], F.col("rank"), F.col("id")).select("k", "y", "src", "v")


@query("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) IN (SELECT DISTINCT year(o_orderdate) AS y FROM orders ORDER BY y DESC LIMIT 3) GROUP BY 1")
def recent_n_years(t):
    return series.recent(t.orders.select(order_year().alias("y")), "y", 3).groupBy("y").agg(F.count("*").alias("n"))


REASONS = "SELECT *, CASE WHEN n_chars < 50 THEN 'too_short' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN text LIKE '%@%' THEN 'contact' END AS reason FROM documents"


def _rules():
    return {"too_short": F.col("n_chars") < 50, "language": ~F.col("lang").isin("en", "de"), "contact": F.contains(F.col("text"), F.lit("@"))}


@query(f"SELECT count(*) AS input_rows, count(*) FILTER (WHERE reason IS NULL) AS accepted_rows, count(reason) AS quarantined_rows FROM ({REASONS})")
def quality_counters(t):
    return quality.counters(quality.reasoned(t.documents, _rules()))


@query(f"SELECT reason AS reject_reason, count(*) AS n FROM ({REASONS}) WHERE reason IS NOT NULL GROUP BY 1")
def reason_histogram(t):
    return quality.reasons(quality.reasoned(t.documents, _rules()))


@query(f"SELECT doc_id AS input_index, reason AS reject_reason FROM ({REASONS}) WHERE reason IS NOT NULL")
def reject_split_quarantine(t):
    return quality.split(t.documents, _rules(), "doc_id").quarantine.select("input_index", "reject_reason")


@query("SELECT l_orderkey AS k, l_linenumber AS line, unnest(['l_quantity', 'l_tax', 'l_discount']) AS metric_id, unnest([l_quantity, l_tax, l_discount]) AS value FROM lineitem")
def unpivot_metrics(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), "l_quantity", "l_tax", "l_discount")
    return sets.unpivot(rows, ["k", "line"], ["l_quantity", "l_tax", "l_discount"])


@query("SELECT l_shipdate_y AS y, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 2) AS a, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 2) AS n, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 2) AS r FROM (SELECT *, year(l_shipdate) AS l_shipdate_y FROM lineitem) GROUP BY 1")
def pivot_metrics(t):
    p = t.lineitem.groupBy(F.year("l_shipdate").alias("y")).pivot("l_returnflag", ["A", "N", "R"]).agg(r(F.sum("l_quantity"), 2))
    return p.select("y", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))
