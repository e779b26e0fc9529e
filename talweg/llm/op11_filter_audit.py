"""Filter interaction audit: which of five filters removes what, alone, together and in every order.

A document's five failure flags are bits. For each of the 32 sets of filters one
aggregate counts the documents that fail all of it (a sum of flag products), per
part and for the three populations: all documents, good ones, toxic ones. All
else follows from these 32 numbers a part:

* survivors of a set: inclusion-exclusion over its subsets;
* what a filter removes after others, and what it alone fails: the Moebius
  inversion over the others' subsets, starting from the filter itself;
* Shapley: a set that fails together has the Harsanyi dividend (-1)^(size + 1)
  times its count in the game "documents removed", and its members share it
  alike; times the 120 orders that is a whole number.

Filter E (a text met under a smaller id) is taken by the text's SHA-256. Rows are
counted by text, part and labels before that: a group of copies is one row a part
and task when texts meet, however large it is, and what comes out of the
aggregates grows with the number of parts alone.

Nulls: a null text is empty; a null lang is the empty string; a row without an id
is no copy of another, no other is a copy of it, and it has no labels. Rows that
repeat an id and a text are no copies of each other (no id is smaller). Labels
that repeat an id count if any of them says so. Texts of any length are read
whole. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.llm import common

FILTERS = "ABCDE"
SUBSETS = range(1 << len(FILTERS))
#: Which rows count, as 0 or 1.
POPULATIONS = {"n": "1", "good": "quality", "toxic": "toxic"}
SALTS = 1024


def text_flags(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one non-null text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, quality, toxic, A..E, n): documents of one text, part and labels, counted; A..D are 0 or 1, E is how many of the n fail it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flags = {k: f.cast("int") for k, f in text_flags(text).items()}
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("hash"), *(f.alias(k) for k, f in flags.items()))
    # Rows without an id have no labels; the second key spreads them.
    own = own.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("hash"), F.lit(SALTS))).otherwise(F.lit(0)))
    said = {c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in ("quality", "toxic")}
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("salt")).agg(*said.values())
    kind = ["hash", "part", "quality", "toxic", *"ABCD"]
    same = own.join(known, ["doc_id", "salt"], "left").fillna(0, ["quality", "toxic"]).groupBy("doc_id", "salt", *kind).agg(F.count("*").alias("same"))
    kinds = same.groupBy(*kind).agg(F.sum("same").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("same"))), F.lit(0)).alias("with_id"), F.min("doc_id").alias("first"), F.min_by("same", "doc_id").alias("at_first"))
    # A text has a row for each part and pair of labels by now, whatever its copies.
    least = F.min("first").over(Window.partitionBy("hash"))
    return kinds.withColumn("E", F.col("with_id") - F.when(F.col("first") == least, F.col("at_first")).otherwise(F.lit(0)))


def joint_failures(kinds: DataFrame) -> DataFrame:
    """One row a part: for each population an array that has, at a set's bits, how many documents fail all of that set."""

    def failing(subset: int, who: Column) -> Column:
        product = F.col("E" if subset >> 4 else "n") * who
        for bit, name in enumerate("ABCD"):
            if subset >> bit & 1:
                product = product * F.col(name)
        return F.sum(product)

    return kinds.groupBy("part").agg(*(F.array(*(failing(s, F.expr(who)) for s in SUBSETS)).alias(name) for name, who in POPULATIONS.items()))


def moebius(joint: Column, own: Column, others: Column) -> Column:
    """How many documents fail all of ``own`` and none of ``others``, both sets as bits."""
    within = F.filter(F.sequence(F.lit(0), F.lit(len(SUBSETS) - 1)), lambda s: s.bitwiseAND(others) == s)
    return F.aggregate(within, F.lit(0).cast("long"), lambda acc, s: acc + (1 - 2 * (F.bit_count(s) % 2)) * F.get(joint, s.bitwiseOR(own)))


def shapley(joint: Column, own: Column) -> Column:
    """The filter's removals summed over all orders: its shares of the dividends of the sets that it belongs to."""
    holding = F.filter(F.sequence(F.lit(1), F.lit(len(SUBSETS) - 1)), lambda s: s.bitwiseAND(own) == own)
    share = lambda s: (2 * (F.bit_count(s) % 2) - 1) * F.get(joint, s) * (F.lit(math.factorial(len(FILTERS))) / F.bit_count(s)).cast("long")
    return F.aggregate(holding, F.lit(0).cast("long"), lambda acc, s: acc + share(s))


def bits(letters: Column) -> Column:
    """A set of filters, written as letters, as bits."""
    return F.aggregate(F.array(*(F.when(F.contains(letters, F.lit(f)), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(FILTERS))), F.lit(0), lambda acc, x: acc + x)


def audit(joint: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    steps = joint.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("own", bits(F.expr("substring(filter_order, step, 1)"))).withColumn("before", bits(F.expr("substring(filter_order, 1, step - 1)")))
    n, own, before = F.col("n"), F.col("own"), F.col("before")
    removed = moebius(n, own, before)
    return steps.select(
        "part",
        "filter_order",
        "step",
        moebius(n, F.lit(0), before.bitwiseOR(own)).alias("kept"),
        removed.alias("removed"),
        (F.get(n, own) - removed).alias("redundant"),
        moebius(n, own, F.lit(len(SUBSETS) - 1) - own).alias("unique_fails"),
        moebius(F.col("good"), own, before).alias("good_lost"),
        moebius(F.col("toxic"), own, before).alias("toxic_lost"),
        shapley(n, own).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order and step of the five filters over all of ``documents``, by language."""
    return audit(joint_failures(flagged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))))


ORACLE_SQL = r"""
WITH RECURSIVE own AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), seen AS (
  SELECT body, min(doc_id) AS least FROM own GROUP BY body
), kinds AS (
  SELECT part, doc_id,
    (len(words) < 100) AS A,
    (100 * len(list_distinct(words)) < 80 * len(words)) AS B,
    (100 * length(regexp_replace(own.body, '[^A-Z]', '', 'g')) > 10 * length(own.body)) AS C,
    regexp_matches(own.body, '[#$%&*|]') AS D,
    coalesce(doc_id > least, false) AS E
  FROM own JOIN seen USING (body)
), said AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part,
    CASE WHEN A THEN 'A' ELSE '' END || CASE WHEN B THEN 'B' ELSE '' END || CASE WHEN C THEN 'C' ELSE '' END
      || CASE WHEN D THEN 'D' ELSE '' END || CASE WHEN E THEN 'E' ELSE '' END AS fails,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM kinds LEFT JOIN said USING (doc_id) GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), steps AS (
  SELECT filter_order, s::INT AS step, filter_order[s] AS f, substring(filter_order, 1, s - 1) AS earlier
  FROM orders, unnest([1, 2, 3, 4, 5]) AS t(s)
), counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN regexp_extract(fails, '[' || earlier || f || ']') = '' THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, f) AND (earlier = '' OR regexp_extract(fails, '[' || earlier || '_]') = '') THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, f) AND earlier <> '' AND regexp_extract(fails, '[' || earlier || '_]') <> '' THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, f) AND (earlier = '' OR regexp_extract(fails, '[' || earlier || '_]') = '') THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, f) AND (earlier = '' OR regexp_extract(fails, '[' || earlier || '_]') = '') THEN toxic ELSE 0 END) AS toxic_lost
  FROM failing, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
