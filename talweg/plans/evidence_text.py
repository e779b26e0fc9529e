"""Text, keywords, pages, evidence and planning over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.functions import text as T
from talweg.operators import evidence, keywords, planner
from talweg.plans.base import query, r
from talweg.plans.datasets import Landed

WORDS = "SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM documents"
STATS = f"SELECT term, source, sum(n) AS tf, count(*) AS df FROM (SELECT term, source, doc_id, count(*) AS n FROM ({WORDS}) WHERE length(term) BETWEEN 2 AND 12 GROUP BY ALL) GROUP BY ALL"


@query(f"SELECT term, source, tf::BIGINT AS tf, df, df::DOUBLE AS support FROM ({STATS})")
def token_stats(t):
    out = keywords.term_stats(t.documents, "doc_id", F.col("text"), "source")
    return out.select("term", "source", "tf", "df", r(F.col("support")).alias("support"))


@query(f"""WITH s AS (SELECT term, sum(tf) AS tf, sum(df) AS df, sum(df) AS support, sum(CASE WHEN source = 'src1' THEN df ELSE 0 END) AS minutes_df, sum(CASE WHEN source = 'src2' THEN df ELSE 0 END) > 0 AS resolved, sum(CASE WHEN source = 'src3' THEN df ELSE 0 END) > 0 AS escalated, sum(CASE WHEN source = 'src4' THEN df ELSE 0 END) * 1.0 / sum(df) AS ratio FROM ({STATS}) GROUP BY 1 HAVING sum(df) >= 2),
m AS (SELECT max(ln(1 + tf)) AS a, max(support) AS b, max(minutes_df) AS c FROM s),
x AS (SELECT term, tf, df, ln(1 + tf) / a + support / b + coalesce(1.8 * minutes_df / nullif(c, 0), 0) + 1.2 * resolved::INT + 2.5 * escalated::INT AS raw, CASE WHEN term IN ('the', 'die') THEN 1.0 ELSE 0.25 * (length(term) >= 3 AND ratio > 0)::INT + 0.25 * ratio END AS rel FROM s, m),
y AS (SELECT term, tf, df, raw, raw + 0.8 * rel AS score FROM x ORDER BY score DESC, df DESC, tf DESC, term DESC LIMIT 23)
SELECT term, tf::BIGINT AS tf, df::BIGINT AS df, round(raw, 4) AS raw_score, round(score, 4) AS ranking_score, least(greatest(floor(1.5 + 4 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ())), 1), 5)::INTEGER AS bucket FROM y""")
def q16_keyword_ranking(t):
    """Terms ranked over all documents; sources stand in for petitions, minutes and resolutions."""
    s = keywords.term_stats(t.documents, "doc_id", F.col("text"), "source")
    of = lambda name: F.sum(F.when(F.col("source") == name, F.col("df")).otherwise(0))
    terms = s.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), F.sum("support").alias("support"), of("src1").alias("minutes_df"), (of("src2") > 0).alias("resolved"), (of("src3") > 0).alias("escalated"), (of("src4") / F.sum("df")).alias("topic_ratio"))
    out = keywords.ranked(terms, listed=["the", "die"])
    return out.select("term", "tf", "df", r(F.col("raw_score")).alias("raw_score"), r(F.col("ranking_score")).alias("ranking_score"), "bucket")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, 'https?://\S+')) AS n_url, len(regexp_extract_all(regexp_replace(text, 'https?://\S+', ' ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email FROM documents""")
def regex_scrub_counts(t):
    _, n = T.scrub(F.col("text"))
    return t.documents.select("doc_id", n["url"].cast("long").alias("n_url"), n["email"].cast("long").alias("n_email"))


@query("SELECT p_partkey, array_to_string(list_transform(range(1, greatest(length(p_brand) - 1, 1)), lambda i: substr(p_brand, i, 3)), ' ') AS trigrams FROM part")
def ngram_tokens(t):
    return t.part.select("p_partkey", F.array_join(T.ngrams(F.col("p_brand"), 3), " ").alias("trigrams"))


@query("SELECT doc_id, list_filter(['the', 'und', 'que', 'license'], lambda w: contains(lower(text), w))::VARCHAR AS matched FROM documents")
def youth_proxy_terms(t):
    found = T.matched_terms(F.lower("text"), ["the", "und", "que", "license"])
    return t.documents.select("doc_id", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("matched"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1), '(^|\.)example\.com$') AS inside FROM pages""")
def url_domain_filter(t):
    return t.pages.select("page_id", T.host(F.col("url")).alias("host"), T.under_domain(F.col("url"), ["example.com"]).alias("inside"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5, len(regexp_extract_all(html, '<a href="([^"]*)"'))::INTEGER AS n_links FROM pages""")
def html_visible_text(t):
    return t.pages.select("page_id", F.md5(T.visible_text(F.col("html")).cast("binary")).alias("text_md5"), F.size(T.links(F.col("html"))).alias("n_links"))


FACTS = """(SELECT 'supply' AS dataset, 'district' AS geo_level, n_nationkey AS district_id, n_name AS district_name, 'year' AS period_type, (1990 + n_nationkey % 5)::VARCHAR AS period, 'suppliers' AS metric_id, n_nationkey::DOUBLE AS value, 'eligible' AS youth_eligibility FROM nation
UNION ALL SELECT 'supply', 'city', NULL, r_name, 'snapshot', 'latest', 'regions', r_regionkey::DOUBLE, 'context' FROM region UNION ALL SELECT 'demand', 'district', n_nationkey, n_name, 'year', (1991 + n_nationkey % 3)::VARCHAR, 'orders', n_regionkey::DOUBLE, 'eligible' FROM nation)"""


def facts(t):
    s = lambda x: F.lit(x)
    cols = lambda d, g, i, n, pt, p, m, v, e: [x.alias(a) for x, a in zip((s(d), s(g), i, n, s(pt), p, s(m), v.cast("double"), s(e)), ("dataset", "geo_level", "district_id", "district_name", "period_type", "period", "metric_id", "value", "youth_eligibility"))]
    key, name, none = F.col("n_nationkey"), F.col("n_name"), F.lit(None).cast("int")
    a = t.nation.select(*cols("supply", "district", key, name, "year", (1990 + key % 5).cast("string"), "suppliers", key, "eligible"))
    b = t.region.select(*cols("supply", "city", none, F.col("r_name"), "snapshot", s("latest"), "regions", F.col("r_regionkey"), "context"))
    c = t.nation.select(*cols("demand", "district", key, name, "year", (1991 + key % 3).cast("string"), "orders", F.col("n_regionkey"), "eligible"))
    return a.unionByName(b).unionByName(c)


@query(f"SELECT dataset, geo_level, district_name, metric_id, value FROM {FACTS} WHERE geo_level <> 'district' OR district_name IN ('NATION_3', '7') OR district_id::VARCHAR IN ('NATION_3', '7')")
def q27_evidence_geo_exception(t):
    return evidence.scoped(facts(t), districts=["NATION_3", "7"]).select("dataset", "geo_level", "district_name", "metric_id", "value")


@query(f"SELECT dataset, district_name, period, value FROM (SELECT *, max(CASE WHEN period_type = 'year' THEN period END) OVER (PARTITION BY dataset) AS last FROM {FACTS}) WHERE period_type = 'snapshot' OR period = last")
def q28_evidence_latest_period(t):
    return evidence.period_policy(facts(t)).select("dataset", "district_name", "period", "value")


@query(f"SELECT youth_eligibility, string_agg(DISTINCT metric_id, ',' ORDER BY metric_id) AS labels, count(DISTINCT metric_id) AS n FROM {FACTS} GROUP BY 1")
def q30_evidence_inventory(t):
    return evidence.inventory(facts(t))


@query(f"SELECT sha256(count(*)::VARCHAR || ':' || sum(('0x' || substr(sha256(district_name || chr(31) || value::VARCHAR), 1, 15))::BIGINT)::VARCHAR) AS fingerprint FROM {FACTS}")
def q31_context_fingerprint(t):
    return evidence.fingerprint(facts(t), "district_name", "value")


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def q25_flatten_payloads(t):
    return evidence.flatten(t.events, "props", "event_id").select("event_id", "path", "value")


@query("SELECT 'facts' AS pk, n_nationkey::VARCHAR AS sk, n_name FROM nation")
def q23_serving_items(t):
    from talweg.sources import tables

    made = tables.items(t.nation, "facts", ["n_nationkey"])
    return made.select("pk", "sk", F.get_json_object("body", "$.n_name").alias("n_name"))


@query("""WITH s AS (SELECT s_name AS dataset, s_suppkey % 4 AS k FROM supplier), m AS (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2024-02-01', INTERVAL 1 MONTH)) AS m)
SELECT dataset, lpad((year(m) - 1911)::VARCHAR, 3, '0') || lpad(month(m)::VARCHAR, 2, '0') AS output_key FROM s, m WHERE k = 0 UNION ALL SELECT DISTINCT dataset, lpad((year(m) - 1911)::VARCHAR, 3, '0') FROM s, m WHERE k = 1 UNION ALL SELECT dataset, CASE k WHEN 2 THEN 'latest' ELSE 'all' END FROM s WHERE k > 1""")
def m01_planner_units(t):
    """Suppliers are datasets, each of a strategy."""
    k = F.col("s_suppkey") % 4
    strategy = F.when(k == 0, "MONTHLY").when(k == 1, "ANNUAL").when(k == 2, "SNAPSHOT").otherwise("ALL_AVAILABLE")
    return planner.units(t.supplier.select(F.col("s_name").alias("dataset"), strategy.alias("strategy")), "2023-11-01", "2024-02-01").select("dataset", "output_key")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN (TIMESTAMP '2024-01-20 00:00:00' - ts) >= INTERVAL 24 HOUR WHEN 1 THEN (TIMESTAMP '2024-01-20 00:00:00' - ts) >= INTERVAL 168 HOUR ELSE strftime(ts, '%Y%m') <> '202401' END AS due FROM events")
def m02_refresh_due(t):
    every = F.when(F.col("event_id") % 3 == 0, "daily").when(F.col("event_id") % 3 == 1, "weekly").otherwise("monthly")
    return t.events.select("event_id", planner.due(every, F.col("ts").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("due"))


@query("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) >= (SELECT max(year(o_orderdate)) FROM orders) - 1 OR year(o_orderdate) = 1995 GROUP BY 1")
def m05_retention_filter(t):
    rows = t.orders.select(F.year("o_orderdate").alias("y"))
    return planner.retained(rows, F.col("y"), 2, [1995]).groupBy("y").agg(F.count("*").alias("n"))


def _said(prefix: str) -> str:
    """Han phrases by key, some with a title's name or an address for the scrub."""
    return f"concat({prefix}, CASE doc_id % 6 WHEN 0 THEN ' 青年就業輔導政策' WHEN 1 THEN ' 社會住宅 租金補貼' WHEN 2 THEN ' 會議紀錄 青年就業 https://a.example/x' WHEN 3 THEN ' 王小明委員 公共托育' WHEN 4 THEN ' 租金補貼 a@b.example 2024-01-02' ELSE ' 本案 說明事項' END)"


NOTED = Landed(
    "documents",
    kind="CASE WHEN doc_id % 2 = 0 THEN 'join' ELSE 'minutes' END",
    text=_said("text"),
    topic=_said("substr(text, 1, 40)"),
    resolution="CASE WHEN doc_id % 3 = 0 THEN concat('決議 青年就業 ', substr(text, 1, 60)) END",
    escalated="doc_id % 9 = 3",
    endorsements="CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 50 - 3 END",
)
RULES = keywords.Rules(listed=("社會住宅", "licensed"), anchors=("就業", "租金", "托育", "tion"), stop=("the", "die", "and"), soft=("政策",), administrative=("本案",), suffixes=("紀錄", "事項"))


def _cut(c: str) -> str:
    """Kept tokens of a text: what the scrub leaves, Latin runs, Han grams, listed terms."""
    for rx in T.SCRUBS.values():
        c = f"regexp_replace({c}, '{rx}', ' ', 'g')"
    c = f"regexp_replace({c}, '\\p{{Han}}{{2,4}}?(?:{'|'.join(sorted(T.ROLES, key=len, reverse=True))})', ' ', 'g')"
    grams = f"flatten(list_transform(regexp_extract_all(x.c, '\\p{{Han}}+'), lambda run: flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, greatest(length(run) - n + 2, 1)), lambda i: substr(run, i, n))))))"
    kept = "lambda w: length(w) BETWEEN 2 AND 12 AND regexp_matches(w, '\\p{L}') AND w NOT IN ('the', 'die', 'and', '本案')"
    return f"(SELECT list_filter(list_concat(regexp_extract_all(lower(x.c), '[a-z][a-z0-9]+'), {grams}, list_filter(['社會住宅', 'licensed'], lambda w: contains(lower(x.c), w))), {kept}) FROM (SELECT {c} AS c) x)"


@query(f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, kind = 'join' AS j, coalesce(escalated, false) AS up, 1 + ln(1 + greatest(coalesce(endorsements, 0), 0)) AS e, {_cut("coalesce(text, '')")} AS t, {_cut("coalesce(topic, '')")} AS h, {_cut("coalesce(resolution, '')")} AS s FROM {NOTED.sql}),
o AS (SELECT id, j, up, e, unnest(t) AS term, h, s FROM d), p AS (SELECT id, j, up, e, term, count(*) AS n, list_contains(any_value(h), term) AS h, list_contains(any_value(s), term) AS s FROM o GROUP BY id, j, up, e, term),
a AS (SELECT term, sum(n) AS tf, count(*) FILTER (WHERE j) AS jd, count(*) FILTER (WHERE NOT j) AS md, count(*) AS df, count(*) FILTER (WHERE h) AS td, coalesce(sum(e) FILTER (WHERE j), 0) AS support, bool_or(NOT j AND s) AS resolved, bool_or(NOT j AND s AND up) AS escalated,
  regexp_matches(term, '就業|租金|托育|tion') AS anchor, term IN ('社會住宅', 'licensed') AS listed FROM p GROUP BY term HAVING count(*) >= 2),
b AS (SELECT * FROM a WHERE listed OR (term <> '政策' AND NOT regexp_matches(term, '(紀錄|事項)$') AND CASE WHEN length(term) >= 3 THEN td >= 1 OR (jd > 0 AND md > 0 AND tf >= 3 AND anchor) ELSE anchor AND (td >= 1 OR (jd > 0 AND md > 0 AND tf >= 3)) END)),
c AS (SELECT * FROM b WHERE listed OR NOT EXISTS (SELECT 1 FROM b l WHERE regexp_matches(l.term, '^\\p{{Han}}{{3,}}$') AND length(l.term) > length(b.term) AND contains(l.term, b.term) AND l.tf = b.tf AND l.df = b.df)),
m AS (SELECT max(ln(1 + tf)) AS x, max(support) AS y, max(md) AS z FROM c),
r AS (SELECT c.*, ln(1 + tf) / x + coalesce(support / nullif(y, 0), 0) + 1.8 * md / nullif(z, 0) + 1.2 * resolved::INT + 2.5 * escalated::INT AS raw, CASE WHEN listed THEN 1.0 ELSE 0.25 * anchor::INT + 0.25 * (length(term) >= 3 AND td > 0)::INT END + 0.25 * td / df AS rel FROM c, m),
q AS (SELECT *, raw + 0.8 * rel AS score FROM r ORDER BY score DESC, df DESC, tf DESC, term DESC LIMIT 23)
SELECT term, tf::BIGINT AS tf, jd AS join_df, md AS minutes_df, td AS topic_df, round(support, 6) AS support, resolved, escalated, CASE WHEN escalated THEN 'escalated' WHEN md > 0 THEN 'minutes' ELSE 'join' END AS signal, round(rel, 6) AS relevance, round(raw, 6) AS raw_score, round(score, 6) AS ranking_score,
  least(greatest(floor(1.5 + 4 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ())), 1), 5)::INTEGER AS bucket FROM q""")
def q16_policy_terms(t):
    """The whole recipe over all documents: scrub, Latin and Han tokens, candidate rules with anchors, nested grams, scores."""
    out = keywords.policy_ranking(NOTED.frame(t), RULES)
    return out.select("term", "tf", F.col("join_df"), "minutes_df", "topic_df", r(F.col("support"), 6).alias("support"), "resolved", "escalated", "signal", r(F.col("relevance"), 6).alias("relevance"), r(F.col("raw_score"), 6).alias("raw_score"), r(F.col("ranking_score"), 6).alias("ranking_score"), "bucket")


@query(f"SELECT doc_id, md5(array_to_string({_cut('x')}, ' ')) AS tokens FROM (SELECT doc_id, {_said('text')} AS x FROM documents)")
def f29_mixed_tokens(t):
    """Kept tokens of every document, in order."""
    words = T.kept_tokens(T.mixed_tokens(T.scrub(F.expr(_said("text")), T.ROLES)[0], list(RULES.listed)), [*RULES.stop, *RULES.administrative], list(RULES.listed))
    return t.documents.select("doc_id", F.md5(F.array_join(words, " ").cast("binary")).alias("tokens"))


REPORTS = Landed("events", unit="CONCAT('u', user_id)", ts="ts", every="CASE user_id % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'never' END", status="CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'no_data' WHEN 'error' THEN 'failed' ELSE 'transform_failed' END", has_output="event_id % 2 = 0", has_raw="event_id % 3 = 0")


@query(f"""WITH o AS (SELECT unit, ts, max(struct_pack(a := every, b := status, c := has_output, d := has_raw)) AS r FROM {REPORTS.sql} WHERE ts <= TIMESTAMP '2024-01-25' GROUP BY unit, ts),
n AS (SELECT unit, ts, r, lead(ts) OVER w AS nx, lag(ts) OVER w AS pt, lag(r) OVER w AS p, CASE r.a WHEN 'daily' THEN ts + INTERVAL 1 DAY WHEN 'weekly' THEN ts + INTERVAL 7 DAY WHEN 'monthly' THEN date_trunc('month', ts) + INTERVAL 1 MONTH END AS due, ts + INTERVAL 2 DAY AS gone FROM o WINDOW w AS (PARTITION BY unit ORDER BY ts)),
q AS (SELECT *, CASE WHEN pt + INTERVAL 2 DAY >= ts THEN p END AS b FROM n)
SELECT unit, ts AS at, 'report' AS kind, CASE WHEN b.c AND b.b = 'ok' THEN 'reuse_output' WHEN b.d AND b.b IN ('ok', 'transform_failed') THEN 'reuse_raw' WHEN b.b = 'no_data' THEN 'keep_no_data' ELSE 'download' END AS action FROM q
UNION ALL SELECT unit, due, 'due', NULL FROM q WHERE due < gone AND due <= TIMESTAMP '2024-01-25' AND (nx IS NULL OR nx > due) UNION ALL SELECT unit, gone, 'gone', NULL FROM q WHERE gone <= TIMESTAMP '2024-01-25' AND (nx IS NULL OR nx > gone)""")
def m04_unit_states(t):
    """Users are units, events their reports: actions, due moments and units given up; the stream form gives the same (tests)."""
    from talweg.streaming import units

    reports = REPORTS.frame(t).withColumn("ts", F.col("ts").cast("timestamp"))
    out = units.batch(reports, 2, F.lit("2024-01-25 00:00:00").cast("timestamp"))
    return out.select("unit", F.col("at").cast("timestamp_ntz").alias("at"), "kind", "action")
