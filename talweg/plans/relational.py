"""Joins, set operations, limits and windows over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talweg.operators import joins, matching, sets
from talweg.plans.base import order_year, query, r
from talweg.streaming import windows


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_lookup(t):
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name")
    return joins.lookup(t.orders.select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_mktsegment", "n_name")


@query("SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def ambiguous_lookup_keys(t):
    return joins.ambiguous(t.orders.select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS suppliers, a.k IS NULL AS orders_missing, b.k IS NULL AS suppliers_missing FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING avg(o_totalprice) > 255000) a FULL JOIN (SELECT s_suppkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def full_outer_flags(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"), F.lit(True).alias("a"), F.avg("o_totalprice").alias("mean")).where("mean > 255000").drop("mean")
    b = t.supplier.groupBy(F.col("s_suppkey").alias("k")).agg(F.count("*").alias("suppliers"), F.lit(True).alias("b"))
    return a.join(b, "k", "full").select("k", "orders", "suppliers", F.col("a").isNull().alias("orders_missing"), F.col("b").isNull().alias("suppliers_missing"))


def large_buyers(t):
    """Customers by the mean of all their orders."""
    return t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean")).where("mean > 255000")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING avg(o_totalprice) > 255000)")
def semi_expected(t):
    return t.customer.join(large_buyers(t), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING avg(o_totalprice) > 255000)")
def anti_missing(t):
    return t.customer.join(large_buyers(t), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT y, n_nationkey, coalesce(n, 0) AS n, n IS NULL AS missing FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders), nation LEFT JOIN (SELECT year(o_orderdate) AS y2, c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::DOUBLE / count(*) >= 0.19) ON y = y2 AND n_nationkey = c_nationkey")
def grid_outer_fill(t):
    each = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(order_year().alias("y"), F.col("c_nationkey").alias("n_nationkey"))
    rows = each.agg(F.count("*").alias("n"), (F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count("*")).alias("share")).where("share >= 0.19").drop("share")
    years = t.orders.select(order_year().alias("y")).distinct()
    return joins.grid(rows, years, F.broadcast(t.nation.select("n_nationkey"))).select("y", "n_nationkey", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


@query("SELECT o_orderkey, coalesce(a.s_name, b.s_name) AS s_name FROM orders LEFT JOIN supplier a ON o_orderkey = a.s_suppkey LEFT JOIN supplier b ON o_custkey = b.s_suppkey")
def fallback_lookup(t):
    out = joins.fallback_lookup(t.orders.select("o_orderkey", "o_custkey"), t.supplier, "o_orderkey", "o_custkey", "s_suppkey", "s_suppkey", "s_name")
    return out.select("o_orderkey", "s_name")


@query("SELECT p_partkey, w AS word FROM part, (VALUES ('red'), ('widget'), ('small'), ('ring')) v(w) WHERE contains(p_name, w)")
def theta_contains(t):
    rules = t.part.sparkSession.createDataFrame([("red",), ("widget",), ("small",), ("ring",)], "word string")
    return matching.matched(t.part, F.col("p_name"), rules, "word").select("p_partkey", "word")


@query("SELECT event_type AS g, event_id, rank, group_rows, group_rows > 5 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank, count(*) OVER (PARTITION BY event_type) AS group_rows FROM events) WHERE rank <= 5")
def per_group_limit_with_truncation(t):
    out = sets.limited(t.events.withColumnRenamed("event_type", "g"), "g", [F.desc("value"), F.asc("event_id")], 5)
    return out.select("g", "event_id", "rank", "group_rows", "truncated")


@query("SELECT event_type AS g, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) WHERE p <= CASE event_type WHEN 'purchase' THEN 125 WHEN 'click' THEN 75 WHEN 'error' THEN 50 ELSE 0 END")
def quota_topk(t):
    out = sets.quota_top(t.events.withColumnRenamed("event_type", "g"), "g", [F.asc("event_id")], {"purchase": 0.5, "click": 0.3, "error": 0.2}, 250)
    return out.select("g", "event_id")


@query("SELECT role, text_hash, conv_id, turn FROM (SELECT *, md5(text) AS text_hash, row_number() OVER (PARTITION BY role, md5(text) ORDER BY conv_id, turn) AS p FROM conversations) WHERE p = 1")
def dedupe_semantic_key(t):
    from talweg.operators.stats import first_by

    rows = t.conversations.select("role", F.md5(F.col("text").cast("binary")).alias("text_hash"), "conv_id", "turn")
    return first_by(rows, ["role", "text_hash"], F.col("conv_id"), F.col("turn")).select("role", "text_hash", "conv_id", "turn")


@query("SELECT md5(text) AS merge_key, min(doc_id) AS doc_id, count(*) AS copies, bool_or(lang = 'en') AS english, array_to_string(list_sort(list(source)), ',') AS sources FROM documents GROUP BY 1")
def hash_merge_duplicates(t):
    rows = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.array("source").alias("sources"), (F.col("lang") == "en").alias("english"), F.lit(1).cast("long").alias("copies"))
    out = sets.merged_duplicates(rows, F.col("h"), "doc_id", "sources", ["english"], ["copies"])
    return out.select("merge_key", "doc_id", "copies", "english", F.array_join("sources", ",").alias("sources"))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, NULL, s_acctbal FROM supplier")
def union_by_name(t):
    return sets.union_all([t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))])


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def intersect_ids(t):
    return t.customer.select(F.col("c_custkey").alias("id")).intersect(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_ids(t):
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT p_partkey, p_retailprice, p_size FROM part ORDER BY p_retailprice DESC, p_size DESC, p_partkey DESC LIMIT 23")
def top_k_composite(t):
    return t.part.select("p_partkey", "p_retailprice", "p_size").orderBy(F.desc("p_retailprice"), F.desc("p_size"), F.desc("p_partkey")).limit(23)


@query("SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS place, round(s_acctbal / max(s_acctbal) OVER (), 8) AS scaled FROM supplier")
def rank_and_global_scale(t):
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"))
    top = t.supplier.agg(F.max("s_acctbal").alias("top"))
    return t.supplier.crossJoin(F.broadcast(top)).select("s_suppkey", F.rank().over(w).alias("place"), r(F.col("s_acctbal") / F.col("top"), 8).alias("scaled"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(t):
    out = windows.tumbling(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "event_type")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", r(F.col("total")).alias("total"))


@query("SELECT s AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts - INTERVAL '30 minutes') + INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1")
def sliding_events(t):
    out = windows.tumbling(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", slide="30 minutes")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", r(F.col("total")).alias("total"))


@query("SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s")
def session_events(t):
    out = windows.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes", "user_id")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n", r(F.col("total")).alias("total"))


def _squares(t):
    """A square of side 100 for each nation, on a grid, one corner cut by its key."""
    k, x, y = F.col("n_nationkey"), (F.col("n_nationkey") % 5 * 200).cast("double"), (F.floor(F.col("n_nationkey") / 5) * 200).cast("double")
    p = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    ring = F.array(p(0, 0), p(100, 0), p(100, 100), p(k.cast("double"), 100), p(0, 100 - k.cast("double")))
    return t.nation.select(k.alias("k"), F.array(ring).alias("rings"))


@query("SELECT n_nationkey AS k, round(10000 - n_nationkey * n_nationkey / 2.0, 6) AS area FROM nation")
def q07_polygon_area(t):
    from talweg.functions import geo

    return _squares(t).select("k", r(geo.polygon_area(F.col("rings")), 6).alias("area"))


def _tm2_sql() -> str:
    """The transverse Mercator series, written out."""
    n = "(1 / 298.257222101) / (2 - 1 / 298.257222101)"
    return f"""WITH p AS (SELECT s_suppkey, radians(24.0 + s_suppkey % 70 / 100.0) AS phi, radians(s_suppkey % 100 / 100.0) AS dl, {n} AS n FROM supplier),
c AS (SELECT *, 2 * sqrt(n) / (1 + n) AS e FROM p), d AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t, 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) * 0.9999 AS a FROM c),
x AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3 FROM d)
SELECT s_suppkey, round(250000 + a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 4) AS x, round(a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 4) AS y FROM x"""


@query(_tm2_sql())
def f32_tm2_forward(t):
    from talweg.functions import geo

    x, y = geo.tm2(121.0 + F.col("s_suppkey") % 100 / 100.0, 24.0 + F.col("s_suppkey") % 70 / 100.0)
    return t.supplier.select("s_suppkey", r(x).alias("x"), r(y).alias("y"))
