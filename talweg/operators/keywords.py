"""Keyword ranking: term statistics by source, candidate rules, weighted scores, top N and 1-to-5 buckets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions import text as T
from talweg.sources import scratch


@dataclass(frozen=True)
class Weights:
    frequency: float = 1.0
    join: float = 1.0
    minutes: float = 1.8
    resolved: float = 1.2
    escalated: float = 2.5
    bonus: float = 0.8


def term_stats(docs: DataFrame, doc: str, body: Column, source: str, endorsements: Column | None = None, stop: list[str] = (), tokenizer: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """tf, df and support (1 + ln(1 + endorsements) summed over documents) of each term and source; a row is a document.

    ``tokenizer``: text to an array of tokens, ``T.tokens`` or another (``T.udf_tokens`` wraps a Python one).
    A text's tokens and its distinct tokens both leave its row, the latter marked:
    the one shuffle takes partial sums by term and source.
    """
    found = docs.select(F.col(source).alias("source"), (1 + F.log1p(F.coalesce(endorsements, F.lit(0)).cast("double")) if endorsements is not None else F.lit(1.0)).alias("__e"), T.kept_tokens(tokenizer(body), list(stop)).alias("__t"))
    once = F.transform(F.array_distinct("__t"), lambda t: F.struct(t.alias("term"), F.lit(True).alias("once")))
    each = F.transform("__t", lambda t: F.struct(t.alias("term"), F.lit(False).alias("once")))
    words = found.select("source", "__e", F.explode(F.concat(once, each)).alias("w")).select("source", "__e", "w.*")
    return words.groupBy("term", "source").agg(F.count_if(~F.col("once")).alias("tf"), F.count_if("once").alias("df"), F.sum(F.when(F.col("once"), F.col("__e")).otherwise(0.0)).alias("support"))


def ranked(stats: DataFrame, listed: list[str] = (), min_df: int = 2, n: int = 23, w: Weights = Weights()) -> DataFrame:
    """The top n candidates with raw and ranking scores and buckets.

    ``stats``: term, tf, df, support, minutes_df, resolved, escalated (boolean),
    topic_ratio. Maxima are over candidates only.
    """
    c = stats.where(F.col("df") >= min_df)
    m = c.agg(F.max(F.log1p("tf")).alias("m_tf"), F.max("support").alias("m_s"), F.max("minutes_df").alias("m_m"))
    part = lambda x, top: F.coalesce(F.try_divide(x, F.col(top)), F.lit(0.0))
    raw = w.frequency * part(F.log1p("tf"), "m_tf") + w.join * part(F.col("support"), "m_s") + w.minutes * part(F.col("minutes_df"), "m_m") + w.resolved * F.col("resolved").cast("double") + w.escalated * F.col("escalated").cast("double")
    is_listed = F.col("term").isin(*listed) if listed else F.lit(False)
    relevance = F.when(is_listed, 1.0).otherwise(0.25 * ((F.length("term") >= 3) & (F.col("topic_ratio") > 0)).cast("double") + 0.25 * F.col("topic_ratio"))
    scored = c.crossJoin(F.broadcast(m)).withColumn("raw_score", raw).withColumn("ranking_score", F.col("raw_score") + w.bonus * relevance)
    top = scored.orderBy(F.desc("ranking_score"), F.desc("df"), F.desc("tf"), F.desc("term")).limit(n)
    return bucketed(top.drop("m_tf", "m_s", "m_m"), "ranking_score", "bucket")


def bucketed(df: DataFrame, score: str, name: str) -> DataFrame:
    """floor(1 + 4 share of the range + 0.5), within 1 to 5; 3 where all are equal."""
    all_ = Window.partitionBy()
    lo, hi = F.min(score).over(all_), F.max(score).over(all_)
    return df.withColumn(name, F.when(hi > lo, F.least(F.greatest(F.floor(1.5 + 4 * (F.col(score) - lo) / (hi - lo)), F.lit(1)), F.lit(5))).otherwise(F.lit(3)).cast("int"))


@dataclass(frozen=True)
class Rules:
    """Which terms may rank. ``mode``: "policy_relevant", or "dynamic" where short terms need no anchor."""

    listed: tuple[str, ...] = ()
    anchors: tuple[str, ...] = ()
    stop: tuple[str, ...] = ()
    soft: tuple[str, ...] = ()
    administrative: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    mode: str = "policy_relevant"
    min_df: int = 2
    min_frequency: int = 3
    low: int = 2
    high: int = 12
    nested: bool = True


def mentions(docs: DataFrame, rules: Rules, tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Term statistics over petitions and minutes: tf, join_df, minutes_df, topic_df, support, resolved, escalated.

    ``docs``: kind ("join" or "minutes"), text, topic, resolution, escalated,
    endorsements; one row a document. Metadata is scrubbed before tokens are cut,
    listed terms count as tokens wherever the text contains them. A term of an
    escalated document is escalated only if its resolution has it.
    """
    cut = tokenizer or (lambda c: T.mixed_tokens(c, list(rules.listed)))
    words = lambda c: T.kept_tokens(cut(T.scrub(F.coalesce(c, F.lit("")), T.ROLES)[0]), [*rules.stop, *rules.administrative], list(rules.listed), rules.low, rules.high)
    # What a document says of a term once goes beside its occurrences: one shuffle of partial sums by term.
    # The three token lists are made once a document, not once a token.
    lists = F.struct(words(F.col("text")).alias("t"), words(F.col("topic")).alias("h"), words(F.col("resolution")).alias("s"))
    first = lambda d: F.transform(F.array_distinct(d["t"]), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("n"), F.array_contains(d["h"], t).alias("h"), F.array_contains(d["s"], t).alias("s")))
    each = lambda d: F.transform(d["t"], lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("n"), F.lit(False).alias("h"), F.lit(False).alias("s")))
    said = T.once(lists, lambda d: F.concat(first(d), each(d)))
    rows = docs.select((F.col("kind") == "join").alias("join"), F.log1p(F.greatest(F.coalesce("endorsements", F.lit(0)), F.lit(0)).cast("double")).alias("e"), F.coalesce("escalated", F.lit(False)).alias("up"), F.explode(said).alias("w")).select("join", "e", "up", "w.*")
    minutes = ~F.col("join")
    return rows.groupBy("term").agg(
        F.sum("n").alias("tf"),
        F.sum(F.when(F.col("join"), F.col("df")).otherwise(0)).alias("join_df"),
        F.sum(F.when(minutes, F.col("df")).otherwise(0)).alias("minutes_df"),
        F.count_if("h").alias("topic_df"),
        F.sum(F.when(F.col("join") & (F.col("df") == 1), 1 + F.col("e")).otherwise(0.0)).alias("support"),
        F.bool_or(minutes & F.col("s")).alias("resolved"),
        F.bool_or(minutes & F.col("s") & F.col("up")).alias("escalated"),
    )


def anchored(term: Column, anchors: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, anchors)), lambda a: F.contains(term, a)) if anchors else F.lit(False)


def candidates(stats: DataFrame, rules: Rules) -> DataFrame:
    """The terms that may rank, with ``df``, ``anchor`` and ``is_listed``."""
    term, listed = F.col("term"), F.col("is_listed")
    s = stats.withColumns({"df": F.col("join_df") + F.col("minutes_df"), "anchor": anchored(term, rules.anchors), "is_listed": term.isin(*rules.listed) if rules.listed else F.lit(False)})
    s = s.where(F.col("df") >= rules.min_df)
    soft = term.isin(*rules.soft) if rules.soft else F.lit(False)
    office = F.lit(False)
    for x in rules.suffixes:
        office = office | F.endswith(term, F.lit(x))
    if rules.administrative:
        office = office | term.isin(*rules.administrative)
    long_, topic = F.length(term) >= 3, F.col("topic_df") >= 1
    spread = (F.col("join_df") > 0) & (F.col("minutes_df") > 0) & (F.col("tf") >= rules.min_frequency)
    compound = topic | (spread & F.col("anchor"))
    if rules.mode == "policy_relevant":
        ok = ~soft & ~office & F.when(long_, compound).otherwise(F.col("anchor") & (topic | spread))
    elif not rules.listed:
        ok = F.lit(True)
    else:
        ok = F.when(soft, topic | spread).otherwise(~office & F.when(long_, compound).otherwise((F.col("topic_df") >= 2) | (spread & F.col("anchor"))))
    kept = s.where(listed | ok) if rules.listed else s.where(ok | F.lit(rules.mode != "policy_relevant"))
    return subsumed(kept) if rules.nested else kept


def subsumed(terms: DataFrame) -> DataFrame:
    """Without the Han terms that a longer one holds and that occur as often in as many documents: they are never met outside it. Listed terms stay."""
    han = terms.where(F.col("term").rlike(r"^\p{IsHan}{3,}$")).select("term", "tf", "df")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.length("term") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.length("term") - n + 1), lambda i: F.substring("term", i, n))))
    held = han.select(F.explode(F.array_distinct(inner)).alias("term"), "tf", "df").distinct()
    return terms.where("is_listed").unionByName(terms.where("NOT is_listed").join(held, ["term", "tf", "df"], "left_anti").select(*terms.columns))


def policy_ranking(docs: DataFrame, rules: Rules, n: int = 23, w: Weights = Weights(), tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """The top n terms with their counts, scores, signal and bucket; maxima are over candidates only."""
    # Read by the maxima, the scores and the nested terms: one row a term, written, so that texts are cut once.
    c = candidates(scratch.kept(mentions(docs, rules, tokenizer), "terms"), rules)
    m = c.agg(F.max(F.log1p("tf")).alias("m_tf"), F.max("support").alias("m_s"), F.max("minutes_df").alias("m_m"))
    part = lambda x, top: F.coalesce(F.try_divide(x, F.col(top)), F.lit(0.0))
    ratio = F.try_divide(F.col("topic_df"), F.col("df"))
    other = 0.25 * F.col("anchor").cast("double") + 0.25 * ((F.length("term") >= 3) & (F.col("topic_df") > 0)).cast("double")
    raw = w.frequency * part(F.log1p("tf"), "m_tf") + w.join * part(F.col("support"), "m_s") + w.minutes * part(F.col("minutes_df"), "m_m") + w.resolved * F.col("resolved").cast("double") + w.escalated * F.col("escalated").cast("double")
    scored = c.crossJoin(F.broadcast(m)).withColumns({"raw_score": raw, "relevance": F.when(F.col("is_listed"), 1.0).otherwise(other) + 0.25 * ratio})
    scored = scored.withColumn("ranking_score", F.col("raw_score") + w.bonus * F.col("relevance"))
    signal = F.when(F.col("escalated"), "escalated").when(F.col("minutes_df") > 0, "minutes").otherwise("join")
    top = scored.withColumn("signal", signal).orderBy(F.desc("ranking_score"), F.desc("df"), F.desc("tf"), F.desc("term")).limit(n)
    return bucketed(top.drop("m_tf", "m_s", "m_m"), "ranking_score", "bucket")
