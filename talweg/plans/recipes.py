"""Predicates, lookups with accounting, small recipes and evidence, over whole standard tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.functions import predicates as W
from talweg.functions import text as T
from talweg.operators import evidence, lookups, matching, recipes, sets
from talweg.plans.base import order_year, query, r
from talweg.plans.datasets import Landed

SALES = Landed(
    "part",
    _ord="p_partkey",
    target="CASE p_partkey % 4 WHEN 0 THEN 'house' WHEN 1 THEN ' land' WHEN 2 THEN 'house ' ELSE NULL END",
    usage="CASE p_partkey % 5 WHEN 0 THEN '住家用' WHEN 1 THEN '集合住宅' WHEN 2 THEN '工業用' WHEN 3 THEN '住家、商業' ELSE NULL END",
    building="CASE p_partkey % 7 WHEN 0 THEN '店面(店鋪)' WHEN 1 THEN NULL ELSE '公寓' END",
    kind="CASE p_partkey % 6 WHEN 0 THEN '土地' WHEN 1 THEN '住宅用' ELSE '房地' END",
    area="CASE WHEN p_partkey % 9 = 0 THEN 0.0 WHEN p_partkey % 9 = 1 THEN NULL ELSE p_size * 1.0 END",
    land_use="CASE p_partkey % 8 WHEN 0 THEN '住' WHEN 1 THEN '第一種住宅區' ELSE '農' END",
    education="CASE p_partkey % 10 WHEN 0 THEN '大學以上' WHEN 1 THEN '高中' WHEN 2 THEN '碩士' WHEN 3 THEN NULL ELSE '不拘' END",
    rental="CASE p_partkey % 3 WHEN 0 THEN '整棟(戶)出租' WHEN 1 THEN '獨立套房' ELSE 'x' END",
)


@query(f"""SELECT _ord, trim(coalesce(target, '')) = 'house' AND coalesce(usage, '') IN ('住家用', '集合住宅', '住宅') AND NOT contains(coalesce(building, ''), '店面') AS listing,
coalesce(kind, '') = '住宅用' OR (kind <> '土地' AND coalesce(area, 0) <> 0 AND (contains(coalesce(usage, ''), '住家') OR contains(coalesce(usage, ''), '住宅') OR land_use = '住' OR contains(land_use, '住宅區'))) AS sale,
coalesce(education, '') IN ('大學以上', '碩士') AS college, CASE rental WHEN '整棟(戶)出租' THEN '整戶' WHEN 'x' THEN '未知' ELSE rental END AS rental_label FROM {SALES.sql}""")
def f15_home_predicates(t):
    c = F.col
    return SALES.frame(t).select("_ord", W.home_listing(c("target"), c("usage"), c("building"), ["house"]).alias("listing"), W.home_sale(c("kind"), c("area"), c("usage"), c("land_use")).alias("sale"), W.college(c("education")).alias("college"), W.labelled(c("rental"), W.RENTAL_TYPES, "未知").alias("rental_label"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS b FROM orders")
def f33_sanitized(t):
    k = F.col("o_orderkey")
    bad = F.when(k % 3 == 0, F.col("o_totalprice")).otherwise(F.lit(float("nan")))
    nested = F.struct(F.when(k % 4 > 0, F.col("o_totalprice")).otherwise(F.lit(float("inf"))).alias("b"), F.lit("x").alias("raw_record"))
    out = W.sanitized(t.orders.select("o_orderkey", bad.alias("a"), nested.alias("n"), F.lit(1).alias("_quality")))
    return out.select("o_orderkey", "a", "n.b")


@query("""SELECT doc_id AS id, p - 1 AS place, code AS reason_code, code IN ('short', 'foreign') AS documented, CASE code WHEN 'short' THEN 'too few characters' WHEN 'foreign' THEN 'another language' END AS explanation FROM
(SELECT doc_id, unnest(codes) AS code, unnest(range(1, len(codes) + 1)) AS p FROM (SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN doc_id % 7 = 0 THEN 'new' END], lambda x: x IS NOT NULL) AS codes FROM documents))""")
def f35_reason_codes(t):
    codes = F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") != "en", "foreign"), F.lit(""), F.when(F.col("n_chars") < 200, "short"), F.when(F.col("doc_id") % 7 == 0, "new"))
    known = t.region.sparkSession.createDataFrame([("short", "too few characters"), ("foreign", "another language")], "reason_code string, explanation string")
    return lookups.explained(t.documents.select(F.col("doc_id").alias("id"), codes.alias("codes")), "id", "codes", known).select("id", "place", "reason_code", "documented", "explanation")


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 's' || (o_orderkey % 4) END AS own, CASE WHEN o_orderkey % 2 = 0 THEN 's1' END AS raw, CASE WHEN o_orderkey % 5 = 0 THEN 'http://own' END AS own_url, CASE WHEN o_orderkey % 7 = 0 THEN 'http://raw' END AS raw_url, CASE WHEN o_orderkey % 11 = 0 THEN 'other' ELSE 'orders' END AS dataset FROM orders),
p AS (SELECT *, coalesce(own, raw, CASE WHEN dataset = 'orders' THEN 's2' END) AS source, coalesce(raw_url, own_url) AS url FROM r)
SELECT id, source, coalesce(url, CASE source WHEN 's1' THEN 'http://one' WHEN 's2' THEN 'http://two' END) AS source_url, CASE source WHEN 's1' THEN 'api' WHEN 's2' THEN 'page' END AS source_url_type,
concat_ws(',', CASE WHEN own <> raw THEN 'source_conflict' END, CASE WHEN source IS NULL OR (source NOT IN ('s1', 's2') AND url IS NULL) THEN 'source_unresolved' END, CASE WHEN source NOT IN ('s1', 's2') THEN 'unknown_source_id' END) AS warnings FROM p""")
def f36_provenance(t):
    k = F.col("o_orderkey")
    make = t.region.sparkSession.createDataFrame
    records = t.orders.select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("s"), k % 4)).alias("source"), F.when(k % 2 == 0, "s1").alias("raw_source"), F.when(k % 5 == 0, "http://own").alias("source_url"), F.when(k % 7 == 0, "http://raw").alias("raw_source_url"), F.when(k % 11 == 0, "other").otherwise("orders").alias("dataset"))
    sources = make([("s1", "http://one", "api"), ("s2", "http://two", "page")], "source string, url string, url_type string")
    out = lookups.with_provenance(records, sources, make([("orders", "s2")], "dataset string, source string"))
    return out.select("id", "source", "source_url", "source_url_type", F.array_join("warnings", ",").alias("warnings"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'latest' WHEN o_orderkey % 3 = 0 THEN (100 + o_orderkey % 20)::VARCHAR END AS period,
CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'rent,wage' ELSE 'wage' END WHEN o_orderkey % 2 = 0 THEN 'rent' WHEN o_orderkey % 7 = 0 THEN 'index' ELSE '' END AS metrics FROM orders""")
def f38_question_intents(t):
    k = F.col("o_orderkey")
    question = F.concat(F.when(k % 3 == 0, F.concat((100 + k % 20).cast("string"), F.lit(" 年度 "))).otherwise(F.lit("2024年 ")), F.when(k % 5 == 0, "salary ").otherwise(""), F.when(k % 2 == 0, "rents ").otherwise(""), F.when(k % 7 == 0, "which is best").otherwise(""))
    asked = t.orders.select(k.alias("id"), F.when(k % 4 == 0, " latest ").otherwise(" ").alias("period"), question.alias("q"))
    rules = t.region.sparkSession.createDataFrame([("salary", ["wage"]), ("rents", ["rent"])], "keyword string, metric_ids array<string>")
    met = matching.intents(asked, "id", "q", rules, ["best"], ["index"])
    return asked.join(met, "id").select("id", W.question_period(F.col("period"), F.col("q")).alias("period"), F.array_join("metric_ids", ",").alias("metrics"))


@query("SELECT count(*) AS expected, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS matched, round(count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) * 1.0 / count(*), 8) AS coverage_ratio, CASE WHEN count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) < count(*) THEN 'incomplete_coverage' END AS reason, (SELECT count(*) FROM orders) AS joined FROM customer")
def j02_covered_join(t):
    both, accounts = lookups.covered_join(t.customer.withColumnRenamed("c_custkey", "k"), t.orders.withColumnRenamed("o_custkey", "k"), "k")
    return accounts.crossJoin(F.broadcast(both.agg(F.count("*").alias("joined")))).select("expected", "matched", r(F.col("coverage_ratio"), 8).alias("coverage_ratio"), "reason", "joined")


@query("SELECT s.k AS key, array_to_string(list_sort(list(DISTINCT o)), ',') AS operators FROM (SELECT unnest([o_custkey % 50, o_orderkey % 30]) AS k, unnest([[o_orderpriority, o_orderstatus], [o_orderpriority, o_orderstatus]]) AS ops FROM orders) s, unnest(ops) u(o) GROUP BY 1")
def j07_nested_values(t):
    stops = F.array(*(F.struct(c.alias("id")) for c in (F.col("o_custkey") % 50, F.col("o_orderkey") % 30)))
    out = lookups.nested_values(t.orders.withColumn("stops", stops), "stops", F.col("x.id"), F.array("o_orderpriority", "o_orderstatus"), "operators")
    return out.select("key", F.array_join("operators", ",").alias("operators"))


@query("""WITH c AS (SELECT s_suppkey AS id, lpad((s_nationkey)::VARCHAR, 2, '0') AS city, lpad((s_suppkey % 4)::VARCHAR, 3, '0') AS town FROM supplier)
SELECT id, CASE WHEN city <> '07' THEN 'city ' || city END AS city_name, CASE WHEN town <> '000' THEN 'town ' || city || town ELSE CASE WHEN city <> '07' THEN 'city ' || city END END AS town_name FROM c""")
def j08_level_names(t):
    code = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    level = F.explode(F.sequence(F.lit(0), F.lit(3)))
    towns = t.nation.select(code.alias("city"), level.alias("n")).withColumn("town", F.lpad(F.col("n").cast("string"), 3, "0")).where("NOT (city = '07' AND town = '000')")
    name = F.when(F.col("n") == 0, F.concat(F.lit("city "), "city")).otherwise(F.concat(F.lit("town "), "city", "town"))
    names = towns.select("city", "town", name.alias("name"), F.lit(1).alias("_ord")).unionByName(towns.select("city", "town", F.lit("old").alias("name"), F.lit(0).alias("_ord")))
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("city"), F.lpad((F.col("s_suppkey") % 4).cast("string"), 3, "0").alias("town"))
    return lookups.level_names(rows, names, ["city", "town"], {"city_name": {"town": "000"}, "town_name": {}}).select("id", "city_name", "town_name")


@query("SELECT page, p AS place, a, b FROM (SELECT l_orderkey AS page, l_linenumber AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p FROM lineitem) JOIN (SELECT l_orderkey AS page, l_extendedprice AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p FROM lineitem) USING (page, p)")
def j16_positional_zip(t):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at")
    left = t.lineitem.select(F.col("l_orderkey").alias("page"), order, F.col("l_linenumber").alias("a"))
    right = t.lineitem.select(F.col("l_orderkey").alias("page"), order, F.col("l_extendedprice").alias("b"))
    return lookups.zipped(left, right, "page", "at").select("page", F.col("__place").alias("place"), "a", "b")


@query("SELECT n_name AS dataset, s_suppkey AS source, s_name AS title FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def j19_dataset_sources(t):
    links = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("dataset"), F.col("s_suppkey").alias("source"))
    return lookups.dataset_sources(t.nation.select(F.col("n_name").alias("dataset")), links, t.supplier.select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("title"))).select("dataset", "source", "title")


@query("SELECT o_custkey AS k, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS name FROM orders GROUP BY 1")
def g19_first_name(t):
    rows = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("name"))
    return lookups.first_name(rows, ["k"], "name", "o_orderkey")


@query("SELECT o_custkey AS code, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS amount, count(*) AS rows_of_code, count(*) > 1 AS repeated FROM orders GROUP BY 1")
def g25_first_by_code(t):
    rows = t.orders.select(F.col("o_custkey").alias("code"), "o_orderkey", F.col("o_totalprice").alias("amount"))
    return lookups.first_by_code(rows, "code", "o_orderkey")


YEARLY = "(SELECT c_nationkey AS k, year(o_orderdate) AS y, CASE WHEN year(o_orderdate) % 2 = 0 THEN sum(CAST(round(o_totalprice * 100) AS BIGINT)) END AS v, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def yearly(t):
    g = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k"), order_year().alias("y"))
    a = g.agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("v"), F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return a.withColumn("v", F.when(F.col("y") % 2 == 0, F.col("v")))


@query(f"SELECT t.k, CAST(arg_max(t.v, t.y) FILTER (WHERE t.v IS NOT NULL) AS BIGINT) AS v, max(t.y) FILTER (WHERE t.v IS NOT NULL) AS v_y, arg_max(t.n, t.y) AS n, max(t.y) AS n_y FROM {YEARLY} t GROUP BY t.k")
def w05_last_present(t):
    return lookups.last_present(yearly(t), ["k"], "y", "v", "n")


@query("""WITH c AS (SELECT year(o_orderdate) AS y, count(*) AS people, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS youth FROM orders GROUP BY 1), n AS (SELECT year(l_shipdate) AS y, count(*) AS v FROM lineitem GROUP BY 1)
SELECT 1996 AS year, (SELECT v FROM n WHERE y = 1996)::DOUBLE AS national_youth, 'observed' AS national_quality, a.youth AS city_youth, round(a.youth * 100.0 / a.people, 6) AS city_share, round((a.youth - b.youth) * 100.0 / b.youth, 6) AS city_yoy FROM c a, c b WHERE a.y = 1996 AND b.y = 1995""")
def q05_key_figures(t):
    city = t.orders.groupBy(order_year().alias("year")).agg(F.count("*").alias("people"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("youth")).withColumn("period", F.concat(F.col("year").cast("string"), F.lit("-12-01")))
    national = t.lineitem.groupBy(F.year("l_shipdate").alias("y")).agg(F.count("*").cast("double").alias("value")).select(F.concat(F.col("y").cast("string"), F.lit("-12-01")).alias("period_start"), "value", F.when(F.col("y") == 1997, F.array(F.lit("incomplete_coverage"))).alias("quality_flags"))
    out = recipes.key_figures(city, national, 1996)
    return out.select("year", "national_youth", "national_quality", "city_youth", r(F.col("city_share"), 6).alias("city_share"), r(F.col("city_yoy"), 6).alias("city_yoy"))


POINTS = "(SELECT year(o_orderdate) AS y, CASE WHEN o_orderstatus = 'F' THEN 'legal_budget' WHEN o_orderstatus = 'O' THEN 'proposed_budget' ELSE 'draft' END AS s, min(o_orderkey) AS o, sum(CAST(round(o_totalprice) AS BIGINT)) AS amount FROM orders WHERE NOT (year(o_orderdate) = 1995) AND NOT (year(o_orderdate) = 1997 AND o_orderstatus = 'F') GROUP BY ALL)"


@query(f"""WITH b AS (SELECT y, arg_min(amount, s) AS amount, min(s) AS s FROM {POINTS} WHERE s <> 'draft' AND y >= 1993 GROUP BY 1), g AS (SELECT unnest(range((SELECT min(y) FROM b), (SELECT max(y) + 1 FROM b)))::INT AS year),
j AS (SELECT year, amount::DOUBLE AS amount, s FROM g LEFT JOIN b ON y = year), p AS (SELECT *, last_value(amount IGNORE NULLS) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM j)
SELECT year, amount, round((amount - prior) / prior * 100, 6) AS yoy, s AS document_status, CASE WHEN amount IS NULL THEN 'unavailable' ELSE 'observed' END AS status FROM p""")
def q06_budget_points(t):
    status = F.when(F.col("o_orderstatus") == "F", "legal_budget").when(F.col("o_orderstatus") == "O", "proposed_budget").otherwise("draft")
    y = order_year()
    rows = t.orders.where(~(y == 1995) & ~((y == 1997) & (F.col("o_orderstatus") == "F"))).groupBy(y.alias("year"), status.alias("document_status")).agg(F.sum(F.round("o_totalprice").cast("long")).cast("double").alias("amount"), F.min("o_orderkey").alias("_ord"))
    out = recipes.budget_points(rows.withColumns({"row_type": F.lit("total"), "unit": F.lit("TWD_thousand")}), 1993)
    return out.select("year", "amount", r(F.col("yoy"), 6).alias("yoy"), "document_status", "status")


@query("""WITH t AS (SELECT year(o_orderdate) AS y, CASE WHEN year(o_orderdate) < 1998 THEN sum(CAST(round(o_totalprice) AS BIGINT)) END AS b, CASE WHEN year(o_orderdate) < 1996 THEN count(*) END AS e FROM orders GROUP BY 1)
SELECT (SELECT b FROM t WHERE y = 1997)::DOUBLE AS current_budget, 1997.5::DOUBLE AS budget_yoy, (SELECT e FROM t WHERE y = 1995)::DOUBLE AS execution_rate, 1995 AS execution_year, NULL::VARCHAR AS execution_failure""")
def q06_policy_block(t):
    y = F.col("year")
    trend = t.orders.groupBy(order_year().alias("year")).agg(F.sum(F.round("o_totalprice").cast("long")).cast("double").alias("b"), F.count("*").cast("double").alias("e"))
    trend = trend.select("year", F.when(y < 1998, F.col("b")).alias("budget"), (y + 0.5).alias("yoy"), F.when(y < 1996, F.col("e")).alias("execution"), F.lit("missing_settlement").alias("failure"))
    return recipes.policy_block(trend).select("current_budget", F.col("budget_yoy").cast("double").alias("budget_yoy"), "execution_rate", "execution_year", "execution_failure")


@query("""WITH w AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS p, o_totalprice AS v FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0)
SELECT v AS latest_wage, CASE WHEN substr(p, 1, 4) IN ('1997', '1998') THEN 'proxy' ELSE 'proxy_outside_window' END AS quality FROM w ORDER BY p DESC, id LIMIT 1""")
def q08_latest_wage(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(F.when(k % 3 == 0, "25-29歲").otherwise("30-34歲").alias("age_group"), F.when(k % 2 == 0, "中位數").otherwise("眾數").alias("method"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("value"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period_start"), k.alias("_ord"))
    return recipes.latest_wage(rows, [1997, 1998])


@query("WITH y AS (SELECT year(o_orderdate) AS y, sum(o_orderkey % 10) AS n FROM orders WHERE year(o_orderdate) <= 1997 AND year(o_orderdate) <> 1996 GROUP BY 1) SELECT round((a.n - b.n) * 100.0 / b.n, 6) AS talent_demand_yoy FROM y a, y b WHERE a.y = 1997 AND b.y = 1995")
def q09_talent_demand(t):
    rows = t.orders.select(order_year().alias("year"), (F.col("o_orderkey") % 10).alias("new_demand_count"))
    return recipes.demand_yoy(rows, [1993, 1994, 1995, 1997]).select(r(F.col("talent_demand_yoy"), 6).alias("talent_demand_yoy"))


@query("""WITH c AS (SELECT '0' || (1 + o_custkey % 3) AS code, o_orderkey AS o, CAST(round(o_totalprice) AS BIGINT) AS a FROM orders), f AS (SELECT code, arg_min(a, o) AS amount, count(*) AS rows_of_code FROM c GROUP BY 1)
SELECT code, amount, rows_of_code, round(amount * 100.0 / (SELECT sum(amount) FROM f), 2)::DOUBLE AS share_percent, 'duplicate_code,missing_code,total_mismatch' AS reasons FROM f""")
def q15_allocation_reasons(t):
    rows = t.orders.select(F.concat(F.lit("0"), (1 + F.col("o_custkey") % 3).cast("string")).alias("code"), F.round("o_totalprice").cast("long").alias("amount"), F.col("o_orderkey").alias("_ord"))
    return recipes.allocation(rows, rows.agg(F.sum("amount").alias("total"))).select("code", "amount", "rows_of_code", "share_percent", "reasons")


@query("SELECT 'salaries' AS dataset, count(*) AS total_rows, count(*) FILTER (WHERE o_custkey % 9 = 0) AS unmapped_rows, count(*) FILTER (WHERE o_orderstatus <> 'P') AS complete_rows FROM orders UNION ALL SELECT 'stops', count(*), 0, count(*) FROM events")
def q20_input_quality(t):
    salaries = t.orders.select(F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("district_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("salary"))
    return recipes.input_quality({"salaries": salaries, "stops": t.events.select("event_id")}, {"salaries": "salary"})


@query("SELECT unnest(['a', 'b', 'c']) AS field, unnest(['available', 'partial', 'unavailable']) AS status, unnest([count(*), count(*) FILTER (WHERE o_orderstatus = 'F'), 0]) AS present, count(*) AS expected FROM orders")
def q21_availability(t):
    rows = t.orders.select(F.col("o_orderkey").alias("a"), F.when(F.col("o_orderstatus") == "F", 1).alias("b"), F.lit(None).cast("int").alias("c"))
    return recipes.availability(rows, ["a", "b", "c"])


@query("SELECT o_orderkey AS id, o_totalprice / 1000 AS value, 'TWD_thousand' AS unit, 'ledger' AS source, CASE WHEN o_orderstatus = 'P' THEN 'unavailable' ELSE 'observed' END AS n_status FROM orders")
def q22_wrapped_metrics(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderstatus") != "P", 1).alias("n"))
    out = recipes.wrapped(rows, ["id"], {"amount": "TWD", "n": "count"}, {"amount": ["ledger"]})
    return out.select("id", "amount.value", "amount.unit", F.col("amount.source_refs")[0].alias("source"), F.col("n.status").alias("n_status"))


RECORDS = """(SELECT o_orderkey AS i, CASE WHEN o_orderkey % 2 = 0 THEN 'jobs' ELSE 'prices' END AS dataset, CASE WHEN o_orderkey % 5 = 0 THEN 'stated' END AS metric_id, CAST(round(o_totalprice) AS BIGINT) AS v, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 7 END AS positions, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS price FROM orders)"""


def records(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("record_index"), F.when(k % 2 == 0, "jobs").otherwise("prices").alias("dataset"), F.lit("11305").alias("period"), F.when(k % 5 == 0, "stated").alias("metric_id"), F.round("o_totalprice").cast("long").alias("value"), F.lit("u").alias("unit"), F.when(k % 3 > 0, k % 7).alias("positions"), F.when(k % 7 > 0, F.col("o_custkey")).alias("price"))


MEASURES = {"jobs": {"positions": "person"}, "prices": {"price": "TWD", "positions": "row"}}
EVIDENCE = f"""(SELECT dataset || ':11305:' || i || ':' || m AS evidence_id, m AS metric_id, CASE WHEN metric_id IS NULL THEN 'record_field' ELSE 'metric_id' END AS metric_source, x::VARCHAR AS value, u AS unit, dataset FROM
(SELECT *, unnest(CASE WHEN metric_id IS NOT NULL THEN [metric_id] ELSE ['positions', 'price'] END) AS m, unnest(CASE WHEN metric_id IS NOT NULL THEN [v] ELSE [positions, CASE WHEN dataset = 'prices' THEN price END] END) AS x, unnest(CASE WHEN metric_id IS NOT NULL THEN ['u'] ELSE [CASE dataset WHEN 'jobs' THEN 'person' ELSE 'row' END, 'TWD'] END) AS u FROM {RECORDS}) WHERE x IS NOT NULL)"""


@query(f"SELECT evidence_id, metric_id, metric_source, value, unit FROM {EVIDENCE}")
def q26_record_evidence(t):
    return evidence.record_evidence(records(t), MEASURES).select("evidence_id", "metric_id", "metric_source", "value", "unit")


@query(f"""WITH e AS (SELECT *, CASE WHEN metric_id = 'stated' THEN 0 ELSE 1 END AS rank FROM {EVIDENCE} WHERE metric_id IN ('stated', 'price')), p AS (SELECT *, row_number() OVER (PARTITION BY metric_source ORDER BY rank, evidence_id) AS n FROM e)
SELECT evidence_id, metric_source FROM p WHERE n <= CASE metric_source WHEN 'metric_id' THEN 20 ELSE 20 END""")
def q29_assembled_context(t):
    """Comparison metrics of all districts with the focus metrics of one, each fact once, by quota."""
    rows = evidence.record_evidence(records(t), MEASURES).withColumns({"geo_level": F.lit("city"), "district_id": F.lit(None).cast("int"), "district_name": F.lit(None).cast("string"), "period_type": F.lit("snapshot"), "youth_eligibility": F.lit("eligible")})
    out = evidence.assembled(rows, ["stated"], ["price", "stated"], ["NATION_3"], {"metric_id": 0.5, "record_field": 0.5}, 40)
    return out.select("evidence_id", "metric_source")


@query("SELECT 'customer' AS pk, c_custkey::VARCHAR AS sk, unnest(['c_mktsegment', 'c_nationkey']) AS path, unnest([c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer")
def q32_item_evidence(t):
    from talweg.sources.tables import items

    both = items(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), "customer", ["c_custkey"]).unionByName(items(t.supplier, "supplier", ["s_suppkey"]))
    return evidence.item_evidence(both, {"buyers": ["customer"]}, "buyers").where("path <> 'c_custkey'")


@query("SELECT p_brand AS key FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand IN ('Brand#1', 'Brand#2')")
def q33_selected_artifacts(t):
    keys = t.part.select(F.col("p_brand").alias("key")).distinct()
    return evidence.artifacts(keys, None, " Brands ", {"brands": ["Brand#1", "Brand#2", "Brand#none"]})


@query("SELECT o_custkey::VARCHAR AS path, greatest(count(*) OVER (PARTITION BY o_custkey) - 3, 0)::INT AS dropped, p - 1 AS place, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) QUALIFY p <= 3".replace("count(*) OVER (PARTITION BY o_custkey)", "n").replace("(SELECT *, row_number()", "(SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number()").replace("QUALIFY", "WHERE"))
def l04_row_caps(t):
    rows = t.orders.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("rows"))
    out = evidence.capped(rows, "rows", {"none": 10}, 3)
    return out.select("path", "dropped", "place", F.col("row").alias("id"))


@query("""WITH c AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'V1' ELSE 'T1' END AS t, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS d, 20 + c_custkey % 40 BETWEEN 18 AND 35 AS young, c_custkey % 3 = 0 AS won FROM customer), p AS (SELECT s_nationkey AS d, count(*) AS youth FROM supplier GROUP BY 1),
g AS (SELECT t, d, count(*) AS n, count(*) FILTER (WHERE young) AS y, count(*) FILTER (WHERE young AND won) AS e FROM c WHERE t = 'V1' GROUP BY 1, 2 UNION ALL SELECT t, NULL, count(*), count(*) FILTER (WHERE young), count(*) FILTER (WHERE young AND won) FROM c GROUP BY 1)
SELECT g.t AS election_type, g.d AS district_id, n AS candidates, y AS youth_candidates, e AS youth_elected, round(y * 100000.0 / CASE WHEN g.d IS NULL THEN (SELECT sum(youth) FROM p) ELSE youth END, 4) AS per_100k FROM g LEFT JOIN p ON g.d = p.d""")
def q10_candidacy_by_type(t):
    k = F.col("c_custkey")
    who = t.customer.select(F.when(k % 2 == 0, "V1").otherwise("T1").alias("election_type"), F.col("c_nationkey").alias("district_id"), (20 + k % 40).alias("age"), (k % 3 == 0).alias("elected"))
    people = t.supplier.groupBy(F.col("s_nationkey").alias("district_id")).agg(F.count("*").alias("youth")).withColumn("year", F.lit(2022))
    out = recipes.candidacy(who, people, 2022)
    return out.select("election_type", "district_id", "candidates", "youth_candidates", "youth_elected", r(F.col("per_100k")).alias("per_100k"))


@query("SELECT p_partkey, p_name || ' ' || lower(p_brand) AS tokens FROM part")
def x01_injected_tokenizer(t):
    """A Python tokenizer by parameter: Arrow batches."""
    words = T.udf_tokens(lambda x: x.lower().split())
    return t.part.select("p_partkey", F.array_join(words(F.concat_ws(" ", "p_name", "p_brand")), " ").alias("tokens"))


@query("SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def u01_union_with_failures(t):
    """A source that can't be opened is left out."""
    spark = t.region.sparkSession
    return sets.union_all([lambda: t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")), lambda: spark.read.parquet("/nowhere/at/all"), t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))])


@query("""WITH b AS (SELECT year(o_orderdate) AS y, sum(CAST(round(o_totalprice) AS BIGINT))::DOUBLE AS a, count(*)::DOUBLE AS n FROM orders WHERE year(o_orderdate) <> 1997 GROUP BY 1),
g AS (SELECT unnest([1996, 1997, 1998, 1999, 2000]) AS year), j AS (SELECT year, a AS amount, n FROM g LEFT JOIN b ON y = year), p AS (SELECT *, last_value(amount IGNORE NULLS) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM j)
SELECT year, amount, round((amount - prior) / prior * 100, 6) AS yoy, round(CASE year WHEN 1996 THEN n * 100.0 / (amount * 1000) WHEN 1998 THEN 77.5 END, 12) AS execution, CASE year WHEN 1996 THEN 'legal_budget_thousand_to_twd' WHEN 1999 THEN 'incompatible_budget_units' END AS conversion, CASE year WHEN 1996 THEN 'realized' WHEN 1998 THEN 'stated' END AS execution_source,
CASE year WHEN 1997 THEN 'realized_amount_unparsed' WHEN 2000 THEN 'final_settlement_unavailable' END AS failure, CASE WHEN amount IS NULL THEN 'unavailable' ELSE 'observed' END AS status FROM p""")
def q03_budget_units(t):
    """Units are aligned, a stated ratio goes first, and each failure has its code."""
    y = F.col("year")
    each = t.orders.groupBy(order_year().alias("year")).agg(F.sum(F.round("o_totalprice").cast("long")).cast("double").alias("amount"), F.count("*").cast("double").alias("n"), F.min("o_orderkey").alias("_ord"))
    budgets = each.where(y != 1997).select("year", F.lit("total").alias("row_type"), F.lit("legal_budget").alias("document_status"), F.lit("TWD_thousand").alias("unit"), "amount", "_ord")
    unit = F.when(y == 1999, "USD").otherwise("TWD")
    settled = each.where(y != 2000).select("year", F.lit("total").alias("row_type"), F.lit("final_settlement").alias("document_status"), unit.alias("unit"), F.when(y.isin(1996, 1999), F.col("n")).alias("realized"), F.when(y == 1998, 77.5).alias("ratio"), F.when(y == 1998, "prior_year_settlement_summary").otherwise("final").alias("record_type"), "_ord")
    out = recipes.budget_execution(budgets, settled, [1996, 1997, 1998, 1999, 2000])
    return out.select("year", "amount", r(F.col("yoy"), 6).alias("yoy"), r(F.col("execution"), 12).alias("execution"), "conversion", "execution_source", "failure", "status")


@query("""WITH d AS (SELECT c_nationkey AS k, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) * 1.0 / count(*) AS knowledge, avg(o_totalprice) AS wage, CASE WHEN c_nationkey <> 4 THEN max(o_totalprice) END AS house FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT 'knowledge_wage' AS scatter, count(*) AS points, count(*) AS sample, round(regr_slope(wage, knowledge), 2) AS slope, round(regr_r2(wage, knowledge), 6) AS r2 FROM d UNION ALL SELECT 'wage_house', count(*), count(house), round(regr_slope(house, wage), 4), round(regr_r2(house, wage), 6) FROM d""")
def q17_two_scatters(t):
    p = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    d = p.groupBy(F.col("c_nationkey").alias("k")).agg((F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")) / F.count("*")).alias("knowledge"), F.avg("o_totalprice").alias("wage"), F.max("o_totalprice").alias("top"))
    out = recipes.scatters(d.withColumn("house", F.when(F.col("k") != 4, F.col("top"))), {"knowledge_wage": ("knowledge", "wage"), "wage_house": ("wage", "house")})
    return out.select("scatter", "points", "sample", F.when(F.col("scatter") == "wage_house", r(F.col("slope"), 4)).otherwise(r(F.col("slope"), 2)).alias("slope"), r(F.col("r2"), 6).alias("r2"))


@query("""WITH w AS (SELECT year(o_orderdate) AS year, arg_min(o_totalprice, o_orderkey) AS wage FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 > 0 AND year(o_orderdate) <> 1995 GROUP BY 1), g AS (SELECT unnest([1993, 1994, 1995, 1996, 1997]) AS year), j AS (SELECT g.year, wage FROM g LEFT JOIN w USING (year))
SELECT a.year, a.wage, round((a.wage - b.wage) / b.wage * 100, 6) AS yoy FROM j a LEFT JOIN j b ON a.year = b.year + 1""")
def q19_wage_trend(t):
    k = F.col("o_orderkey")
    rows = t.orders.where(order_year() != 1995).select(F.when(k % 3 == 0, "25-29歲").otherwise("35-39歲").alias("age_group"), F.when(k % 4 > 0, F.col("o_totalprice")).alias("value"), order_year().alias("year"), k.alias("_ord"))
    return recipes.wage_trend(rows, [1993, 1994, 1995, 1996, 1997]).select("year", "wage", r(F.col("yoy"), 6).alias("yoy"))


@query("""SELECT 'DASHBOARD' AS pk, 'KPIS' AS sk, (SELECT count(*) FROM orders)::VARCHAR AS probe UNION ALL SELECT 'DASHBOARD', 'POLICY', (SELECT count(*) FROM lineitem)::VARCHAR UNION ALL SELECT 'DISTRICT', n_nationkey::VARCHAR, n_name FROM nation UNION ALL SELECT 'ANALYSIS', 'events', (SELECT count(DISTINCT event_type) FROM events)::VARCHAR UNION ALL SELECT 'MANIFEST', 'latest', 's1'""")
def q23_serving_plan(t):
    n = lambda df: df.agg(F.count("*").alias("n"))
    manifest = t.region.limit(1).select(F.lit("s1").alias("snapshot_id"))
    out = recipes.serving_items({"KPIS": n(t.orders), "POLICY": n(t.lineitem)}, t.nation.select(F.col("n_nationkey").alias("district_id"), "n_name"), {"events": t.events.groupBy("event_type").agg(F.count("*").alias("n"))}, manifest)
    probe = F.coalesce(F.get_json_object("body", "$.n"), F.get_json_object("body", "$.n_name"), F.get_json_object("body", "$.snapshot_id"), F.json_array_length("body").cast("string"))
    return out.select("pk", "sk", probe.alias("probe"))
