"""Many patterns in many texts: which texts contain which strings, in time linear in the texts.

While the patterns are few enough to go to every task (their characters are
counted first), one automaton of all of them reads each text once. Beyond that,
a pattern's first ``ANCHOR`` characters meet the substrings of the distinct
texts by a shuffled join, and what meets is verified.

Null texts contain nothing, null patterns are in nothing, the empty pattern is in every text.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of all patterns that may be broadcast, and of an anchor.
MOST, ANCHOR = 8_000_000, 8
_automata: dict[str, object] = {}


def _automaton(token: str, patterns: list[str]):
    """The automaton of a worker for the patterns broadcast as ``token``."""
    if token not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            made.add_word(p, i)
        made.make_automaton()
        _automata.clear()
        _automata[token] = made
    return _automata[token]


def _scanner(spark, patterns: list[str]):
    """A column function: numbers of the patterns that a text contains, ascending."""
    held, token = spark.sparkContext.broadcast([p for p in patterns if p]), uuid.uuid4().hex
    back = spark.sparkContext.broadcast([i for i, p in enumerate(patterns) if p])
    always = [i for i, p in enumerate(patterns) if not p]

    def scan(texts: pd.Series) -> pd.Series:
        made = _automaton(token, held.value) if held.value else None
        each = lambda t: None if t is None else sorted([*always, *({back.value[i] for _, i in made.iter(t)} if made else ())])
        return texts.map(each, na_action=None)

    return F.pandas_udf(scan, "array<int>")


def matched(df: DataFrame, text: Column, rules: DataFrame, pattern: str, most: int = MOST) -> DataFrame:
    """Each row of ``df`` with each row of ``rules`` whose pattern its text contains."""
    spark = df.sparkSession
    distinct = rules.select(pattern).where(F.col(pattern).isNotNull()).distinct()
    if (distinct.agg(F.sum(F.length(pattern) + 1)).first()[0] or 0) <= most:
        patterns = sorted(r[0] for r in distinct.collect())
        numbered = spark.createDataFrame(list(enumerate(patterns)), "__i int, __p string")
        named = rules.join(F.broadcast(numbered), F.col(pattern) == F.col("__p")).drop("__p")
        return df.withColumn("__i", F.explode(_scanner(spark, patterns)(text))).join(named, "__i").drop("__i")
    keyed = df.withColumns({"__t": text, "__h": F.sha2(text, 256)})
    found = contained(keyed.where("__t IS NOT NULL").select("__h", "__t"), distinct, pattern)
    return keyed.drop("__t").join(found, "__h").drop("__h").join(rules.withColumnRenamed(pattern, "__p"), "__p").withColumnRenamed("__p", pattern)


def contained(texts: DataFrame, patterns: DataFrame, pattern: str, anchor: int = ANCHOR) -> DataFrame:
    """(__h, __p): distinct texts (__h, __t) and the patterns in them, by their anchors."""
    texts = texts.groupBy("__h").agg(F.first("__t").alias("__t"))
    size = F.least(F.length(pattern), F.lit(anchor))
    rules = patterns.select(F.col(pattern).alias("__p"), F.left(pattern, size).alias("__a"))
    lengths = rules.agg(F.array_sort(F.collect_set(F.length("__a"))).alias("sizes"))  # at most ANCHOR and one for the empty pattern
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("__t") - n + 1, F.lit(1))), lambda i: F.substring("__t", i, n))
    pieces = texts.crossJoin(F.broadcast(lengths)).select("__h", F.explode(F.array_distinct(F.flatten(F.transform("sizes", grams)))).alias("__a"))
    near = pieces.join(rules, "__a").select("__h", "__p").distinct()
    return near.join(texts, "__h").where(F.contains("__t", F.col("__p"))).select("__h", "__p")


def first_matched(df: DataFrame, key: str, text: Column, rules: DataFrame, pattern: str, order: str, value: str) -> DataFrame:
    """(key, value) of the rule of least ``order`` whose pattern the row's text contains; rows without one are left out."""
    hit = matched(df.select(key, text.alias("__text")), F.col("__text"), rules.select(pattern, order, value), pattern)
    return hit.groupBy(key).agg(F.min_by(value, order).alias(value))


def mentioned(questions: DataFrame, key: str, question: str, names: DataFrame, name: str, suffix: str) -> DataFrame:
    """(key, name) of each name that a question has in full, or without its suffix if two characters are left."""
    known = names.select(name).where(F.col(name) != "").distinct()
    short = F.regexp_replace(F.col(name), f"{suffix}$", "")
    ways = known.select(name, F.explode(F.array_distinct(F.array(F.col(name), F.when(F.length(short) >= 2, short).otherwise(F.col(name))))).alias("__way"))
    return matched(questions.select(key, question), F.col(question), ways, "__way").select(key, name).distinct()


def intents(questions: DataFrame, key: str, question: str, rules: DataFrame, comparing: list[str], headline: list[str]) -> DataFrame:
    """(key, metric_ids): metrics of the rules (keyword, metric_ids) that a question hits; a question that only compares gets the headline ones."""
    from talweg.functions.predicates import any_in

    hit = matched(questions.select(key, question), F.col(question), rules, "keyword").groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("metric_ids")))).alias("met"))
    fallback = F.when(any_in(F.col(question), comparing), F.array(*map(F.lit, sorted(headline)))).otherwise(F.array().cast("array<string>"))
    return questions.join(hit, key, "left").select(key, F.coalesce("met", fallback).alias("metric_ids"))
