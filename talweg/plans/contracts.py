"""Smaller contracts over whole standard tables: units, scraped pages, caps and limitations, strict rollups, ordinals, whole salaries, raw baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.functions import text as T
from talweg.functions import units
from talweg.operators import evidence, recipes, sets
from talweg.operators import transforms as X
from talweg.plans.base import order_year, query, r
from talweg.plans.datasets import PRICES
from talweg.plans.recipes import EVIDENCE, MEASURES, records


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN price > 0 THEN round(price * 3.305785, 6) END AS per_ping, CASE WHEN l_extendedprice > 0 THEN round(l_extendedprice / 10000, 8) END AS wan, CASE WHEN l_linenumber <> 7 AND price > 0 THEN round(price * CASE WHEN l_linenumber % 2 = 0 THEN 1000 ELSE 1 END, 4) END AS single
FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN 0 WHEN l_linenumber = 4 THEN NULL ELSE l_quantity END AS price FROM lineitem)""")
def f18_units(t):
    n = F.col("l_linenumber")
    price = F.when(n == 3, 0.0).when(n != 4, F.col("l_quantity"))
    unit = F.when(n == 7, "億").when(n % 2 == 0, "千元").otherwise("元")
    return t.lineitem.select("l_orderkey", "l_linenumber", r(units.price_per_ping(price), 6).alias("per_ping"), r(units.to_wan(F.col("l_extendedprice")), 8).alias("wan"), r(units.from_thousand(price, unit)).alias("single"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref="([^"#][^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref="([^"#][^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages),
e AS (SELECT page_id, site, unnest(range(len(h)))::INT AS place, unnest(h) AS h, unnest(t) AS t FROM a)
SELECT page_id, place, CASE WHEN h LIKE '/%' THEN site || h ELSE h END AS url, trim(regexp_replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM e WHERE trim(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g')) <> ''""")
def s18_listed_links(t):
    return t.pages.select("page_id", F.explode(T.listed(F.col("html"), F.col("url"))).alias("a")).select("page_id", "a.*")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS heading,
md5(trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1) <> '' THEN regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1) ELSE html END, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS body FROM pages""")
def s18_detail_pages(t):
    d = t.pages.select("page_id", T.detail(F.col("html")).alias("d"))
    return d.select("page_id", "d.title", "d.heading", F.md5(F.col("d.body").cast("binary")).alias("body"))


@query("SELECT artifact, id, n AS artifact_facts, n > 4000 AS truncated FROM (SELECT l_returnflag AS artifact, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS p, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE p <= 4000")
def l05_artifact_cap(t):
    facts = t.lineitem.select(F.col("l_returnflag").alias("artifact"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return evidence.artifact_cap(facts, "artifact", "id").select("artifact", "id", "artifact_facts", "truncated")


@query(f"""WITH e AS (SELECT *, CASE WHEN metric_id = 'stated' THEN 0 ELSE 1 END AS rank FROM {EVIDENCE} WHERE metric_id IN ('stated', 'price')), p AS (SELECT *, row_number() OVER (PARTITION BY metric_source ORDER BY rank, evidence_id) AS n FROM e),
c AS (SELECT * FROM p WHERE n <= 20), h AS (SELECT metric_id, count(*) AS n FROM {EVIDENCE} GROUP BY 1), k AS (SELECT metric_id, count(*) AS n FROM c GROUP BY 1)
SELECT CASE WHEN h.n IS NULL THEN 'no_evidence' ELSE 'evidence_cut' END AS code, m AS subject, coalesce(h.n, 0) - coalesce(k.n, 0) AS n FROM (VALUES ('stated'), ('price'), ('height')) v(m) LEFT JOIN h ON h.metric_id = m LEFT JOIN k ON k.metric_id = m WHERE h.n IS NULL OR coalesce(k.n, 0) < h.n
UNION ALL SELECT 'no_district_evidence', 'NATION_3', 0 UNION ALL SELECT 'proxy_evidence', '', count(*) FROM c WHERE metric_source = 'record_field' HAVING count(*) > 0""")
def q29_limitations(t):
    """What the context of a question can't say: metrics without facts or cut, districts without any, proxies."""
    eligible = F.when(F.col("metric_source") == "record_field", "proxy").otherwise("eligible")
    rows = evidence.record_evidence(records(t), MEASURES).withColumns({"geo_level": F.lit("city"), "district_id": F.lit(None).cast("int"), "district_name": F.lit(None).cast("string"), "period_type": F.lit("snapshot"), "youth_eligibility": eligible})
    context = evidence.assembled(rows, ["stated"], ["price", "stated"], ["NATION_3"], {"metric_id": 0.5, "record_field": 0.5}, 40)
    return evidence.limitations(rows, context, ["stated", "price", "height"], ["NATION_3"])


@query("SELECT year(o_orderdate) AS year, count(*) AS units, sum(o_custkey % 40)::DOUBLE AS people, sum(o_orderkey % 7)::DOUBLE AS hours FROM orders GROUP BY 1")
def g27_strict_rollup(t):
    """Orders are courses, each of which may come once only."""
    rows = t.orders.select(order_year().alias("year"), "o_orderkey", (F.col("o_custkey") % 40).cast("double").alias("people"), (F.col("o_orderkey") % 7).cast("double").alias("hours"))
    return recipes.strict_rollup(rows, ["year"], ["year", "o_orderkey"], ["people", "hours"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders")
def w12_ordinals(t):
    return sets.ordinals(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "ordinal")


@query(f"""WITH p AS (SELECT *, try_cast(nullif(low, '0') AS DOUBLE) AS lo, try_cast(high AS DOUBLE) AS hi, try_cast(people AS BIGINT) AS n FROM {PRICES.sql})
SELECT _ord, n AS positions, lo AS salary_lower, hi AS salary_upper, (lo + hi) / 2 AS salary, lo IS NULL OR hi IS NULL AS incomplete FROM p WHERE scope IN ('county', 'district') AND n IS NOT NULL AND NOT coalesce(lo > hi, false)""")
def t08_vacancy_salaries(t):
    landed = PRICES.frame(t).withColumnsRenamed({"low": "NT_L(lower)", "high": "NT_U（upper）", "scope": "geo_scope", "people": "JOB_PERSON"})
    return X.vacancy_salaries(landed).accepted.select("_ord", "positions", *(F.col(c).cast("double").alias(c) for c in ("salary_lower", "salary_upper", "salary")), (F.size("quality_flags") > 0).alias("incomplete"))


@query("""WITH m AS (SELECT c_nationkey AS d, year(o_orderdate) AS y, month(o_orderdate) AS m, max(o_orderkey) AS o, count(*) AS people, count(*) FILTER (WHERE o_orderstatus = 'F') AS youth FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
l AS (SELECT d, y, arg_max(people, m) AS people, arg_max(youth, m) AS youth FROM m WHERE y BETWEEN 1995 AND 1998 GROUP BY 1, 2), g AS (SELECT d, y, sum(people) AS people, sum(youth) AS youth FROM l GROUP BY GROUPING SETS ((d, y), (y)))
SELECT a.d AS district_id, a.y AS year, a.people::BIGINT AS people, a.youth::BIGINT AS youth, round(a.youth * 100.0 / nullif(a.people, 0), 6) AS share, round((a.youth - b.youth) * 100.0 / nullif(b.youth, 0), 6) AS yoy FROM g a LEFT JOIN g b ON a.d IS NOT DISTINCT FROM b.d AND a.y = b.y + 1 WHERE a.y BETWEEN 1996 AND 1998""")
def q01_population_window(t):
    """Three years asked for; the change of the first is on a year that only the raw months have."""
    rows = t.orders.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("district_id")), F.col("o_custkey") == F.col("c_custkey"))
    months = rows.groupBy("district_id", order_year().alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("people"), F.count_if(F.col("o_orderstatus") == "F").alias("youth"), F.max("o_orderkey").alias("_ord"))
    out = recipes.annual_population(months, [1996, 1997, 1998])
    return out.select("district_id", "year", "people", "youth", r(F.col("share"), 6).alias("share"), r(F.col("yoy"), 6).alias("yoy"))
