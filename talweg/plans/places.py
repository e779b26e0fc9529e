"""Addresses, names in texts, points in areas and service coverage, over whole standard tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.functions import addresses as A
from talweg.functions.text import once
from talweg.operators import joins, matching, overlay, service
from talweg.plans.base import query, r
from talweg.plans.datasets import Landed


def _address(n: str) -> str:
    """An address in one of the ways that people write it, from a key: towns, sections in three scripts, sub-plates in three places, floors, lists, remarks."""
    return f"""concat(
CASE {n} % 4 WHEN 0 THEN '新北市' ELSE '' END, CASE {n} % 5 WHEN 0 THEN '板橋區' WHEN 1 THEN '臺東區' WHEN 2 THEN '八里區' ELSE '' END, CASE WHEN {n} % 11 = 0 THEN '12鄰' ELSE '' END,
CASE {n} % 3 WHEN 0 THEN '中山路' WHEN 1 THEN '文化街' ELSE '環河大道' END, CASE {n} % 7 WHEN 0 THEN '二段' WHEN 1 THEN '2段' WHEN 2 THEN '２段' WHEN 3 THEN ' 十二 段' ELSE '' END, CASE WHEN {n} % 6 = 0 THEN '18巷' ELSE '' END,
CAST({n} % 40 + 1 AS STRING), CASE {n} % 9 WHEN 0 THEN '-3號' WHEN 1 THEN '之3號' WHEN 2 THEN '號之三' WHEN 3 THEN '、9、11號' WHEN 4 THEN '' ELSE '號' END, CASE {n} % 8 WHEN 0 THEN '5樓' WHEN 1 THEN '五樓' WHEN 2 THEN 'B1樓' WHEN 3 THEN '(後棟)' ELSE '' END)"""


CUSTOMERS = Landed("customer", _ord="c_custkey", address=f"CASE WHEN c_custkey % 97 = 0 THEN ' ' WHEN c_custkey % 89 = 0 THEN NULL ELSE {_address('c_custkey')} END")
REGISTER = Landed("supplier", _ord="s_suppkey", address=_address("s_suppkey"), x="s_suppkey % 40 * 50.0", y="s_nationkey * 10.0")


def _parts_sql(source: str) -> str:
    """The parts, one expression each, in the other engine's patterns."""
    num = lambda e: f"CASE WHEN regexp_matches({e}, '^[0-9]+$') THEN {e}::BIGINT WHEN {e} = '十二' THEN 12 WHEN {e} <> '' THEN instr('一二三四五六七八九', {e}) END"
    return f"""(SELECT *, {num("sec")} AS section, {num("sub_")} AS sub, {num("flo")} AS floor FROM (SELECT *, nullif(regexp_extract(t, '^(?:新北市)?([^0-9路街]+?區)', 1), '') AS town,
nullif(regexp_extract(t, '(中山路|文化街|環河大道)', 1), '') AS street, regexp_extract(t, '([0-9一二三四五六七八九十]+)段', 1) AS sec, nullif(regexp_extract(t, '([0-9]+)巷', 1), '')::BIGINT AS lane,
nullif(regexp_extract(t, '([0-9]+)[^0-9段巷弄鄰]?[0-9之、-]*號', 1), '')::BIGINT AS plate, regexp_replace(regexp_extract(t, '(?:[之-][0-9]+號|號之[一二三])'), '[號之-]', '', 'g') AS sub_,
nullif(regexp_extract(t, '(b)[0-9]+樓$', 1), '') AS cellar, regexp_extract(t, '([0-9]+|[一二三四五])樓$', 1) AS flo
FROM (SELECT *, regexp_replace(translate(lower(address), '臺２', '台2'), '\\(.*\\)| ', '', 'g') AS t FROM {source})))"""


@query(f"SELECT _ord, town, street, section, lane, plate, sub, floor, cellar FROM {_parts_sql(CUSTOMERS.sql)} WHERE _ord % 9 <> 4")
def f31_address_parts(t):
    """Parts of every address that has a plate's unit."""
    p = A.parts(F.col("address")).alias("p")
    return CUSTOMERS.frame(t).where("_ord % 9 <> 4").select("_ord", p).select("_ord", "p.town", "p.street", "p.section", "p.lane", "p.plate", "p.sub", "p.floor", "p.cellar")


_SAME = "street, section::VARCHAR, lane::VARCHAR, plate::VARCHAR"
_KEYS = """(SELECT _ord, tier, CASE tier WHEN 0 THEN [town, {same}, sub::VARCHAR, cellar, floor::VARCHAR] WHEN 1 THEN ['', {same}, sub::VARCHAR, cellar, floor::VARCHAR]
WHEN 2 THEN ['', {same}, sub::VARCHAR, '', ''] ELSE ['', {same}, NULL, '', ''] END AS k {more} FROM {parts}, unnest([0, 1, 2, 3]) AS u(tier) WHERE plate IS NOT NULL AND (tier > 0 OR town IS NOT NULL))"""


@query(f"SELECT _ord, min(tier) AS tier, count(*) AS same_key FROM {_KEYS.format(same=_SAME, more='', parts=_parts_sql(CUSTOMERS.sql))} GROUP BY _ord, array_to_string(list_transform(k, lambda v: coalesce(v, '')), '|')")
def f31_address_keys(t):
    """The tiers of every address with a plate; a looser tier with a stricter one's key isn't repeated, so it adds to that."""
    p = CUSTOMERS.frame(t).select("_ord", A.parts(F.col("address")).alias("p")).where("p.plate IS NOT NULL").select("_ord", A.tiers(F.col("p")).alias("t"))
    rows = p.select("_ord", F.posexplode("t").alias("i", "k"), F.get("t", F.col("i") + 1)["tier"].alias("next"))
    return rows.select("_ord", F.col("k.tier").alias("tier"), (F.coalesce("next", F.lit(4)) - F.col("k.tier")).cast("long").alias("same_key"))


@query(f"""WITH q AS {_KEYS.format(same=_SAME, more="", parts=_parts_sql(CUSTOMERS.sql))}, g AS (SELECT DISTINCT array_to_string(list_transform(k, lambda v: coalesce(v, '')), '|') AS k, _ord AS place, x, y FROM {_KEYS.format(same=_SAME, more=", x, y", parts=_parts_sql(REGISTER.sql))}),
m AS (SELECT q._ord AS request, q.tier, x, y, count(*) AS n FROM (SELECT _ord, min(tier) AS tier, array_to_string(list_transform(k, lambda v: coalesce(v, '')), '|') AS k FROM q GROUP BY _ord, 3) q JOIN g USING (k) GROUP BY ALL),
w AS (SELECT request, tier, avg(x) AS cx, avg(y) AS cy, count(*) AS places, sum(n) AS total, max(n) AS top FROM m GROUP BY ALL),
f AS (SELECT request, tier, places, top, total, max(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS far FROM m JOIN w USING (request, tier) GROUP BY ALL),
h AS (SELECT request, tier, CASE WHEN places = 1 THEN 'single' WHEN far <= 150 THEN 'centroid' WHEN top >= 2 * (total - top) + 1 THEN 'dominant' END AS how FROM f)
SELECT request, min(tier) AS tier, arg_min(how, tier) AS how FROM h WHERE how IS NOT NULL GROUP BY request""")
def j11_tiered_resolution(t):
    """Every customer's address against the register of suppliers' ones: the strictest key that names one place."""
    exploded = lambda df, *more: df.select("_ord", *more, F.explode(once(A.parts(F.col("address")), lambda p: F.when(p["plate"].isNotNull(), A.tiers(p)))).alias("k")).select("_ord", *more, "k.*")
    requests = exploded(CUSTOMERS.frame(t)).withColumnRenamed("_ord", "request")
    keys = exploded(REGISTER.frame(t), "x", "y").select("_ord", "key", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    return joins.tiered(requests, keys, "request").select("request", "tier", "how")


SPOTS = Landed("orders", k="o_orderkey", x="CASE WHEN o_orderkey % 3 = 0 THEN 500.05 + o_orderkey % 7 * 0.01 ELSE (o_orderkey * 7919) % 10007 / 10.0 + 0.05 END", y="CASE WHEN o_orderkey % 3 = 0 THEN 400.05 ELSE (o_orderkey * 104729) % 10009 / 10.0 + 0.05 END")
BOXES = Landed("supplier", region="s_suppkey", x="(s_suppkey * 37) % 1000 * 1.0", y="(s_suppkey * 53) % 1000 * 1.0", side="5.0 + s_suppkey % 40")


def boxes(df, x: str, y: str, side):
    """Squares as polygons."""
    corner = lambda a, b: F.struct((F.col(x) + a * side).cast("double").alias("x"), (F.col(y) + b * side).cast("double").alias("y"))
    return df.withColumn("rings", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))))


@query(f"SELECT p.k, CASE WHEN count(b.region) = 1 THEN min(b.region) END AS region FROM {SPOTS.sql} p LEFT JOIN {BOXES.sql} b ON p.x BETWEEN b.x AND b.x + side AND p.y BETWEEN b.y AND b.y + side GROUP BY p.k")
def point_in_polygon_grid(t):
    """Points (a third of them in one spot) in squares that overlap."""
    points = SPOTS.frame(t).select("k", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return joins.located(points, boxes(BOXES.frame(t), "x", "y", F.col("side")).select("region", "rings"), "k", "region")


ASKED = Landed("customer", id="c_custkey", q="concat('how is ', CASE c_custkey % 4 WHEN 0 THEN concat('Supplier#', lpad(CAST(c_custkey % 150 AS STRING), 9, '0'), '區 and 區') WHEN 1 THEN concat('Supplier#', lpad(CAST(c_custkey % 150 AS STRING), 9, '0')) WHEN 2 THEN concat('Supplier#00000001', c_custkey % 10, ', Supplier#00000002', c_custkey % 7) ELSE concat('it, ', c_mktsegment) END)")


@query(f"SELECT q.id, s_name || '區' AS name FROM {ASKED.sql} q JOIN supplier ON contains(q.q, s_name || '區') OR (length(s_name) >= 2 AND contains(q.q, s_name))")
def f40_mentioned_districts(t):
    """Names of a whole table in questions, with their suffix or without."""
    names = t.supplier.select(F.concat("s_name", F.lit("區")).alias("name"))
    return matching.mentioned(ASKED.frame(t), "id", "q", names, "name", "區")


@query(f"SELECT q.id, arg_min(s_suppkey, s_suppkey) AS supplier FROM {ASKED.sql} q JOIN supplier ON contains(q.q, s_name) GROUP BY q.id")
def f11_first_named(t):
    """The first district, in the registry's order, that a text names."""
    return matching.first_matched(ASKED.frame(t), "id", F.col("q"), t.supplier.select("s_name", "s_suppkey", F.col("s_suppkey").alias("supplier")), "s_name", "s_suppkey", "supplier")


WORDS = "(SELECT DISTINCT regexp_extract(text, '[A-Za-z]{4,}') AS word FROM documents WHERE regexp_matches(text, '[A-Za-z]{4,}'))"


@query(f"SELECT word, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents JOIN {WORDS} ON contains(text, word) GROUP BY word")
def j18_words_in_texts(t):
    """The first long word of every document, wherever it is part of any document's text."""
    word = F.regexp_extract("text", "[A-Za-z]{4,}", 0)
    words = t.documents.select(word.alias("word")).where("word <> ''").distinct()
    return matching.matched(t.documents.select("doc_id", "text"), F.col("text"), words, "word").groupBy("word").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


#: Service points: a third in one spot, some by degrees alone, some unmatched, some nowhere.
POINTS = Landed(
    "customer",
    status="CASE WHEN c_custkey % 13 = 0 THEN 'failed' ELSE 'matched' END",
    px="CASE WHEN c_custkey % 17 = 0 OR c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 300.25 + c_custkey % 10 * 0.125 ELSE (c_custkey * 7919) % 8000 * 0.125 END",
    py="CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 410.5 + c_custkey % 7 * 0.25 ELSE (c_custkey * 10477) % 8000 * 0.125 END",
    lon="CASE WHEN c_custkey % 17 = 0 THEN 200.0 ELSE c_custkey % 150 * 1.0 END",
    lat="c_custkey % 90 * 1.0",
)
#: Villages' people by period: some have none, some a later row, the last village no row.
PEOPLE = Landed("orders", village="o_custkey", district_id="CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 20 END", people="CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderkey % 50 END", period="CAST(o_orderdate AS STRING)", _ord="o_orderkey")


@query(f"""WITH p AS (SELECT status = 'matched' AND (px IS NOT NULL AND py IS NOT NULL OR lon <= 180) AS counts, CASE WHEN px IS NOT NULL AND py IS NOT NULL THEN px ELSE lon * 4 END AS x, CASE WHEN px IS NOT NULL AND py IS NOT NULL THEN py ELSE lat * 4 END AS y FROM {POINTS.sql}),
v AS (SELECT region AS village, x AS vx, y AS vy, side, region % 30 AS d FROM {BOXES.sql}),
n AS (SELECT DISTINCT village, greatest(x - 10, vx) AS a, least(x + 10, vx + side) AS b, greatest(y - 10, vy) AS c, least(y + 10, vy + side) AS e FROM v JOIN p ON counts AND x - 10 < vx + side AND x + 10 > vx AND y - 10 < vy + side AND y + 10 > vy),
xs AS (SELECT village, x, lead(x) OVER (PARTITION BY village ORDER BY x) AS nx FROM (SELECT village, a AS x FROM n UNION SELECT village, b FROM n)), ys AS (SELECT village, y, lead(y) OVER (PARTITION BY village ORDER BY y) AS ny FROM (SELECT village, c AS y FROM n UNION SELECT village, e FROM n)),
g AS (SELECT village, sum((nx - x) * (ny - y)) AS covered FROM xs JOIN ys USING (village) WHERE EXISTS (SELECT 1 FROM n WHERE n.village = xs.village AND a <= x AND b >= nx AND c <= y AND e >= ny) GROUP BY village),
q AS (SELECT village, arg_max(coalesce(district_id, -1), (period, _ord)) AS d2, arg_max(coalesce(people, -1), (period, _ord)) AS people FROM {PEOPLE.sql} GROUP BY village),
j AS (SELECT v.village, CASE WHEN d2 >= 0 THEN d2 ELSE d END AS district_id, people, people IS NOT NULL AS has, coalesce(covered, 0) / (side * side) AS ratio FROM v LEFT JOIN g USING (village) LEFT JOIN q USING (village)),
f AS (SELECT (SELECT count(*) FILTER (WHERE counts) FROM p) AS verified_points, (SELECT count(*) FILTER (WHERE NOT coalesce(counts, false)) FROM p) AS excluded_points, count(*) AS boundaries, count(*) FILTER (WHERE has) AS joined_villages FROM j),
s AS (SELECT district_id, sum(ratio * people) AS cp, sum(people) AS pp, count(*) AS nv, count(*) FILTER (WHERE ratio > 0) AS nc FROM j WHERE people >= 0 GROUP BY GROUPING SETS ((district_id), ()))
SELECT district_id, round(cp * 100 / nullif(pp, 0), 6) AS value, round(cp, 6) AS covered_people, pp::DOUBLE AS people, nv AS villages, nc AS covered_villages, 'partial' AS status, CASE WHEN joined_villages < boundaries THEN 'incomplete_village_population_coverage' ELSE '' END AS reasons, verified_points, excluded_points, boundaries, joined_villages FROM s, f""")
def q12_service_coverage(t):
    """Districts' people within 10 (in each axis) of a verified point; villages are suppliers' squares."""
    points = service.verified(POINTS.frame(t), lambda lon, lat: (lon * 4, lat * 4))
    districts = (F.col("region") % 30).alias("district_id")
    villages = boxes(BOXES.frame(t), "x", "y", F.col("side")).select(F.col("region").alias("village"), "rings", districts, F.lit("d").alias("district_name"))
    people = PEOPLE.frame(t).withColumn("district_name", F.lit("d"))
    out = service.coverage(points, villages, people, 10.0, "square")
    return out.select("district_id", r(F.col("value"), 6).alias("value"), r(F.col("covered_people"), 6).alias("covered_people"), "people", "villages", "covered_villages", "status", F.array_join("reasons", ",").alias("reasons"), "verified_points", "excluded_points", "boundaries", "joined_villages")


@query(f"""WITH p AS (SELECT DISTINCT px AS x, py AS y FROM {POINTS.sql} WHERE px IS NOT NULL AND py IS NOT NULL), v AS (SELECT region, x AS vx, y AS vy, side FROM {BOXES.sql})
SELECT region, side * side AS area, count(x) > 0 AS touched FROM v LEFT JOIN p ON sqrt(greatest(vx - x, 0, x - vx - side) ** 2 + greatest(vy - y, 0, y - vy - side) ** 2) < 9.98 GROUP BY ALL""")
def j10_disc_overlay(t):
    """Areas that the union of discs reaches into (corners of the polygons that stand for discs are some thousandths short)."""
    points = POINTS.frame(t).select(F.col("px").alias("x"), F.col("py").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    out = overlay.coverage(boxes(BOXES.frame(t), "x", "y", F.col("side")).select("region", "rings"), points, "region", 10.0)
    return out.select("region", "area", (F.col("covered") > 0).alias("touched"))
