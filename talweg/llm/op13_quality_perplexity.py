"""Quality rules: fixed counts of a text, and bands of perplexity under a modified Kneser-Ney model.

The model is one of characters: a word is the sequence of its characters and an
end mark, after start marks, and every n-gram lies within one word. So the model
needs each language's words and their counts alone, unknown words are measured
too, and a text's log-probability is the sum of its words'.

Spark counts the words of all documents by language and fold (a hash of the
text, so that copies share it), then the n-grams of the distinct words. Lower
orders count the distinct characters to the left. For an n-gram with context h

    P(c | h) = max(count - D(count), 0) / total(h) + back(h) P(c | shorter h)

with three discounts an order (Chen and Goodman), from the numbers of n-grams
seen once to four times; back(h) is what the discounts leave of 1. Below single
characters lies an even share for each character known to the language, and one for
all others. Every n-gram is in the model, however rare.

A document is scored by the model of the other fold: neither it nor an exact copy is
in it. So the n-grams of the highest order that one fold holds are what the other
fold's model is asked for: ``conditionals`` carries them through the orders beside the
model's own and gives log P of each, in whole units of 1 / ``UNITS``. The ``MOST`` that are
met most often are broadcast as arrays sorted by a 64-bit hash of language, fold and
characters, and a slice's distinct words look theirs up by binary search; the
others' occurrences leave the documents and join the table of all of them. Sums are of
whole numbers, so a document's doesn't depend on which way an n-gram took.

``fit`` makes a model of bounded size for words of no table (``Model.word_scores``); the
query doesn't use it. It leaves out n-grams below a ``share`` of their order's counts,
and their part goes to the shorter ones.

A document's log-perplexity is minus the mean log-probability of its characters
and end marks. Each language has a band: from the first quartile less ``FENCE``
times the spread between the quartiles to the third quartile and as much, of the
documents that pass the base rules (the quartiles are exact to 1/``GRAIN``), and
at least so far that the perplexity is ``LEAST_FACTOR`` times a quartile's (copies
can bring the quartiles together). Documents outside it are rejected. A language with fewer than ``LEAST_DOCUMENTS`` documents that pass has no band, nor has one
without a model for both folds.

Nulls: a null text has no words, so it fails the base rules; a null lang is the
empty string; a null id stays. Repeated rows each count. Texts of any length are
read whole. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from talweg.llm import common, tokens
from talweg.llm.words import split_words

ORDER, SHARE = 5, 2.0**-20
#: n-grams that are broadcast, at most, and units of log P; what stands for a log P that no model gives.
MOST, UNITS, NONE = 1 << 20, 1 << 28, -(1 << 62)
FENCE, LEAST_FACTOR, GRAIN, LEAST_DOCUMENTS = 3.0, 4.0, 1000, 100
#: Marks before a word's first and after its last character; both are white space and so in no word.
START, END = "\t", "\n"
#: Discounts where too few counts are known to estimate them.
PLAIN = (0.5, 1.0, 1.5)
MIN_WORDS, REPEAT_WINDOW, MAX_REPEATS = 20, 8, 30
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


# Counting

def folded(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with _lang, _fold (0 or 1) and _text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, F.coalesce("lang", F.lit("")).alias("_lang"), F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("_fold"), text.alias("_text"))


def words_of_models(part: pa.RecordBatch, other: bool = False) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(languages, distinct words, then for every pair of model and word: language, fold, word; and each occurrence's pair and text) of a slice.

    ``other`` takes the model of the fold that a text isn't in.
    """
    names, at, size = split_words(part.column("_text"))
    langs = part.column("_lang").dictionary_encode()
    fold = part.column("_fold").to_numpy().astype(np.int64)
    model = langs.indices.to_numpy().astype(np.int64) * 2 + (1 - fold if other else fold)
    pairs, occurrence = np.unique(np.repeat(model, size) * max(len(names), 1) + at, return_inverse=True)
    return langs.dictionary, names, pairs // max(len(names), 1), pairs % max(len(names), 1), occurrence, np.repeat(np.arange(len(size)), size)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, fold, word, n): every word of every text, counted in slices, then by Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.slices(batch.column("_text")):
                langs, names, model, word, occurrence, _ = words_of_models(batch.slice(a, b - a))
                n = np.bincount(occurrence, minlength=len(model)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(model // 2)).cast(pa.string()), pa.array((model % 2).astype(np.int32)), names.take(pa.array(word)).cast(pa.string()), pa.array(n)], names=["lang", "fold", "word", "n"])

    rows = folded(docs, []).mapInArrow(counted, "lang string, fold int, word string, n long")
    return rows.groupBy("lang", "fold", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """(lang, gram, n0, n1) of each order from 1, each written: an n-gram's counts in the two folds.

    The highest order counts occurrences, the others distinct characters to the left; but what
    starts a word has start marks there alone and keeps its occurrences.
    """
    marked = F.concat(F.lit(START * (order - 1)), "word", F.lit(END))
    starts = F.sequence(F.lit(1), F.length("word") + 1)
    grams = words.select("lang", "fold", "n", F.explode(F.transform(starts, lambda i: F.substring(marked, i, F.lit(order)))).alias("gram"))
    own = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in (0, 1)]
    out = [common.written(grams.groupBy("lang", "gram").agg(*own), "grams")]
    for k in range(order - 1, 0, -1):
        shorter = out[-1].withColumn("gram", F.right("gram", F.lit(k)))
        left = [F.sum(F.when(F.startswith("gram", F.lit(START)), F.col(c)).otherwise((F.col(c) > 0).cast("long"))).alias(c) for c in ("n0", "n1")]
        out.append(common.written(shorter.groupBy("lang", "gram").agg(*left), "grams"))
    return out[::-1]


def by_model(grams: DataFrame) -> DataFrame:
    """(lang, fold, gram, n, uses): a row for the model of either fold; n is its own count, uses the other fold's, whose texts it scores."""
    rows = F.array(*(F.struct(F.lit(f).alias("fold"), F.col(f"n{f}").alias("n"), F.col(f"n{1 - f}").alias("uses")) for f in (0, 1)))
    return grams.select("lang", "gram", F.explode(rows).alias("_m")).select("lang", "_m.fold", "gram", "_m.n", "_m.uses")


# Estimation

def discounts(counted: list[DataFrame]) -> DataFrame:
    """(k, lang, fold, d1, d2, d3, whole): an order's discounts from how many n-grams have each of the counts 1 to 4, and its counts over all languages."""
    grams = reduce(DataFrame.union, [by_model(g).select(F.lit(k).alias("k"), "lang", "fold", "n") for k, g in enumerate(counted, 1)])
    seen = grams.groupBy("k", "lang", "fold").agg(*(F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)), F.sum("n").alias("own"))
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0))
    d = {k: k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0)) for k in (1, 2, 3)}
    whole = F.sum("own").over(Window.partitionBy("k"))
    return seen.select("k", "lang", "fold", *(F.when(x.between(0, k), x).otherwise(F.lit(PLAIN[k - 1])).alias(f"d{k}") for k, x in d.items()), whole.alias("whole"))


def levels(words: DataFrame, order: int, share: float = 0.0) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each order from 0: (lang, fold, gram, uses, p, stored) and (lang, fold, context, total, back, used), each written.

    An n-gram that only the other fold holds has a count of 0 and the p of the shorter ones; p is null where a fold has no model.
    """
    counted = gram_counts(words, order)
    known = common.hinted(discounts(counted))
    chars = F.count(F.when(F.col("n") > 0, 1))
    lower = by_model(counted[0]).groupBy("lang", "fold").agg(F.when(chars > 0, 1 / (chars + 1)).alias("p")).select("lang", "fold", F.lit("").alias("gram"), F.lit(0).cast("long").alias("uses"), "p", F.col("p").isNotNull().alias("stored"))
    lower = common.written(lower, "level")
    yield lower, None
    for k, grams in enumerate(counted, 1):
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        stored = (F.col("n") > 0) & (F.col("n") >= F.col("whole") * share)
        here = by_model(grams).join(known.where(F.col("k") == k).drop("k"), ["lang", "fold"]).select("lang", "fold", "gram", "n", "uses", F.when(stored, F.col("n") - d).otherwise(0.0).alias("left"), stored.alias("stored"))
        here = here.withColumn("context", F.left("gram", F.lit(k - 1))).withColumn("suffix", F.right("gram", F.lit(k - 1)))
        contexts = here.groupBy("lang", "fold", "context").agg(F.sum("n").alias("total"), F.sum("left").alias("held"), F.max("stored").alias("used"))
        part = lambda x: F.coalesce(x / F.nullif("total", F.lit(0)), F.lit(0.0))
        contexts = common.written(contexts.select("lang", "fold", "context", "total", (1 - part(F.col("held"))).alias("back"), "used"), "contexts")
        below = lower.select("lang", "fold", F.col("gram").alias("suffix"), F.col("p").alias("below"))
        p = part(F.col("left")) + F.col("back") * F.col("below")
        lower = common.written(here.join(contexts, ["lang", "fold", "context"]).join(below, ["lang", "fold", "suffix"]).select("lang", "fold", "gram", "uses", p.alias("p"), "stored"), "level")
        yield lower, contexts


def conditionals(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, fold, gram, uses, score), written: log P in ``UNITS`` of every n-gram that the texts of the other fold hold, by the whole model; ``NONE`` without a model."""
    for lower, _ in levels(words, order):
        pass
    return lower.where("uses > 0").select("lang", "fold", "gram", "uses", F.coalesce(F.round(F.log("p") * UNITS).cast("long"), F.lit(NONE)).alias("score"))


def estimate(words: DataFrame, order: int = ORDER, share: float = 0.0) -> DataFrame:
    """(kind, lang, fold, gram, value) of a model with the n-grams from ``share`` of their order's counts: logarithms of P ("p") and of back ("b") by n-gram and context; the empty n-gram has P of an unknown character."""
    kept = []
    for lower, contexts in levels(words, order, share):
        kept.append(lower.where("stored").select(F.lit("p").alias("kind"), "lang", "fold", "gram", F.col("p").alias("value")))
        if contexts is not None:
            kept.append(contexts.where("used").select(F.lit("b").alias("kind"), "lang", "fold", F.col("context").alias("gram"), F.col("back").alias("value")))
    return reduce(DataFrame.union, kept).withColumn("value", F.log("value"))


# Stored n-grams

def salt(lang: str, fold: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{fold}{lang}".encode(), digest_size=8).digest(), "little"))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    return h ^ (h >> np.uint64(27))


def codes(words: list[str], before: int = 0, after: str = "") -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words with their marks, length of each)."""
    marked = [START * before + w + after for w in words]
    return np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), np.array([len(w) for w in marked], np.int64)


def window_hashes(code: np.ndarray, end: np.ndarray, size: int, salts: np.ndarray) -> np.ndarray:
    """Hash of the ``size`` characters before each place ``end``, with its model's salt."""
    h = np.full(len(end), np.uint64(size + 1))
    for j in range(size, 0, -1):
        h = h * ODD + code[end - j]
    return mixed(mixed(h) ^ salts)


def gram_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(length, hash with its model's salt) of a batch's n-grams."""
    grams = batch.column("gram").to_pylist()
    code, size = codes(grams)
    end = np.cumsum(size)
    salts = np.array([salt(*x) for x in zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist())], np.uint64)
    h = np.zeros(len(grams), np.uint64)
    for k in np.unique(size).tolist():
        own = size == k
        h[own] = window_hashes(code, end[own], k, salts[own])
    return size, h


def places(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all marked words; for each character and end mark that is predicted: its word, and the place after it)."""
    code, size = codes(words, order - 1, END)
    predicted = size - (order - 1)
    word = np.repeat(np.arange(len(words)), predicted)
    return code, word, np.repeat(np.cumsum(size) - np.cumsum(predicted), predicted) + np.arange(len(word)) + 1


@dataclass
class Model:
    """Logarithms by sorted hashes: P by n-gram and back by context, of each order from 0."""

    p: list[tuple[np.ndarray, np.ndarray]]
    back: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def found(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        """The values of hashes; not a number where there is none."""
        keys, values = table
        if not len(keys):
            return np.full(len(h), np.nan)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], np.nan)

    def word_scores(self, words: list[str], salts: np.ndarray) -> np.ndarray:
        """Log-probability of each word with its end mark under the model of its salt; not a number without that model."""
        order = len(self.p) - 1
        code, word, end = places(words, order)
        own = salts[word]
        total, left = np.zeros(len(word)), np.arange(len(word))
        for k in range(order, -1, -1):
            got = self.found(self.p[k], window_hashes(code, end[left], k, own[left]))
            total[left] += np.where(np.isnan(got), 0.0 if k else np.nan, got)
            left = left[np.isnan(got)]
            if not k or not len(left):
                break
            total[left] += np.nan_to_num(self.found(self.back[k - 1], window_hashes(code, end[left] - 1, k - 1, own[left])))
        return np.bincount(word, weights=total, minlength=len(words))


def model(entries: DataFrame, order: int = ORDER) -> Model:
    """The stored entries as arrays on the driver."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, h = gram_hashes(batch)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(size.astype(np.int32)), pa.array(h.view(np.int64)), batch.column("value").cast(pa.float32())], names=["kind", "k", "hash", "value"])

    rows = entries.select("kind", "lang", "fold", "gram", "value").mapInArrow(hashed, "kind string, k int, hash long, value float").toArrow()
    kind, k, h, value = rows["kind"].to_numpy(), rows["k"].to_numpy(), rows["hash"].to_numpy().view(np.uint64), rows["value"].to_numpy().astype(np.float32)

    def tables(which: str) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for size in range(order + 1):
            own = np.flatnonzero((kind == which) & (k == size))
            own = own[np.argsort(h[own])]
            out.append((h[own], value[own]))
        return out

    return Model(tables("p"), tables("b"))


@dataclass
class Frequent:
    """Scores of the n-grams that are met most often, by sorted hashes."""

    order: int
    keys: np.ndarray
    scores: np.ndarray

    def word_scores(self, words: list[str], salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(sum of each word's known scores, whether one of them is ``NONE``; then for each n-gram that isn't held: its word and itself)."""
        code, word, end = places(words, self.order)
        h = window_hashes(code, end, self.order, salts[word])
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        held = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        got = self.scores[at[held]]
        total, lost = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        np.add.at(total, word[held], np.where(got == NONE, 0, got))
        lost[word[held][got == NONE]] = True
        rest = end[~held]
        grams = code[rest[:, None] + np.arange(-self.order, 0)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return total, lost, word[~held], [grams[k : k + self.order] for k in range(0, len(grams), self.order)]


def frequent(scores: DataFrame, order: int = ORDER, most: int = MOST) -> Frequent:
    """``most`` n-grams of ``conditionals`` at most, those of the greatest ``uses``, as arrays on the driver."""
    grade = F.floor(8 * F.log2("uses")).cast("int")
    room, least = most, 1 << 20
    # Some hundred grades at any size.
    for grade_, n in sorted(((r[0], r[1]) for r in scores.groupBy(grade.alias("grade")).agg(F.count("*")).collect()), reverse=True):
        room -= n
        if room < 0:
            break
        least = grade_

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(gram_hashes(batch)[1].view(np.int64)), batch.column("score")], names=["hash", "score"])

    rows = scores.where(grade >= least).select("lang", "fold", "gram", "score").mapInArrow(hashed, "hash long, score long").toArrow()
    keys, values = rows["hash"].to_numpy().view(np.uint64), rows["score"].to_numpy()
    by = np.argsort(keys)
    return Frequent(order, keys[by], values[by])


def fit(docs: DataFrame, order: int = ORDER, share: float = SHARE) -> Model:
    """A model of bounded size: two entries for each of the order's 1 / share, at most."""
    return model(estimate(common.written(word_counts(docs), "words"), order, share), order)


# Scoring

def repeated_words(at: np.ndarray, size: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of so many (a power of two) words that the text holds twice or more."""
    rank, width = at, 1
    while width < window and len(rank) > width:
        # Alike windows of twice the width have alike halves.
        rank = np.unique(rank[:-width] * (int(rank.max()) + 1) + rank[width:], return_inverse=True)[1]
        width *= 2
    text, ends = np.repeat(np.arange(len(size)), size), np.cumsum(size)
    start = np.flatnonzero(np.arange(len(at)) + window <= ends[text]) if len(at) else at
    if not len(start):
        return np.zeros(len(size), np.int64)
    _, which, times = np.unique(text[start] * (int(rank.max()) + 1) + rank[start], return_inverse=True, return_counts=True)
    twice = start[times[which] > 1]
    inside = np.cumsum(np.bincount(twice, minlength=len(at) + 1) - np.bincount(twice + window, minlength=len(at) + 1))[: len(at)] > 0
    return np.bincount(text[inside], minlength=len(size))


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    lines = lists.flatten()
    text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy().astype(np.int64)))
    coded = lines.dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    worded = pc.match_substring_regex(coded.dictionary, r"[^ \t-\r]").to_numpy(zero_copy_only=False)[at] if len(at) else np.zeros(0, bool)
    text, at = text[worded], at[worded]
    distinct = np.unique(text * max(len(coded.dictionary), 1) + at) // max(len(coded.dictionary), 1)
    return np.bincount(text, minlength=len(lists)) - np.bincount(distinct, minlength=len(lists))


def base_counts(texts: pa.Array, names: pa.Array, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The columns of ``BASE``."""
    text = np.repeat(np.arange(len(size)), size)
    of_words = lambda each: np.bincount(text, weights=each.to_numpy(zero_copy_only=False).astype(np.int64)[at] if len(at) else None, minlength=len(size)).astype(np.int64)
    return [size, of_words(pc.utf8_length(names)), of_words(pc.count_substring_regex(names, r"[#*$%&|<>]")), duplicate_lines(texts), repeated_words(at, size)]


def score(docs: DataFrame, fitted: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with ``BASE``, lang and log_perplexity (null without words or without a model) by a bounded model."""
    held = docs.sparkSession.sparkContext.broadcast(fitted)  # bounded, see ``fit``
    schema = StructType([*docs.select(*keep).schema.fields])
    for column in BASE.split(", "):
        schema = schema.add(column.split()[0], "long")
    schema = schema.add("lang", "string").add("log_perplexity", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.slices(batch.column("_text")):
                part = batch.slice(a, b - a)
                names, at, size = split_words(part.column("_text"))
                base = base_counts(part.column("_text"), names, at, size)
                langs, names, of, word, occurrence, text = words_of_models(part, other=True)
                salts = np.array([salt(lang, fold) for lang in langs.to_pylist() for fold in (0, 1)], np.uint64)
                each = held.value.word_scores(names.take(pa.array(word)).to_pylist(), salts[of])
                n = base[1] + size
                with np.errstate(invalid="ignore", divide="ignore"):
                    log_perplexity = -np.bincount(text, weights=each[occurrence] if len(text) else None, minlength=len(part)) / n
                lost = np.isnan(log_perplexity)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x.astype(np.int64)) for x in base), part.column("_lang"), pa.array(log_perplexity, pa.float64(), mask=lost)], names=schema.names)

    return folded(docs, keep).mapInArrow(scored, schema)


def rest_lists(text: np.ndarray, occurrence: np.ndarray, word: np.ndarray, grams: list[str], pairs: int, texts: int) -> pa.Array:
    """For each text its n-grams that aren't held, each with its number of times; ``word`` and ``grams`` are those of the ``pairs`` of model and word, ``occurrence`` the pair of each word of a ``text``."""
    coded = pa.array(grams, pa.string()).dictionary_encode()
    each = np.bincount(word, minlength=pairs)
    start, times = np.cumsum(each) - each, each[occurrence]
    total = np.cumsum(times)
    at = np.repeat(start[occurrence] - (total - times), times) + np.arange(int(total[-1]) if len(total) else 0)
    codes_, of = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    found, n = np.unique(np.repeat(text, times) * of + codes_[at], return_counts=True)
    rows = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(found % of)), pa.array(n.astype(np.int64))], names=["gram", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(found, np.arange(texts + 1) * of).astype(np.int32)), rows)


def score_whole(docs: DataFrame, keep: list[str], order: int = ORDER, most: int = MOST) -> DataFrame:
    """``score`` by the whole model of ``docs`` themselves: n-grams beyond the ``most`` that are broadcast come from a join."""
    scores = conditionals(common.written(word_counts(docs), "words"), order)
    held = docs.sparkSession.sparkContext.broadcast(frequent(scores, order, most))  # bounded by ``most``
    schema = StructType([*docs.select(*keep).schema.fields])
    for column in BASE.split(", "):
        schema = schema.add(column.split()[0], "long")
    rest_type = StructType().add("gram", "string").add("n", "long")
    schema = schema.add("lang", "string").add("_row", "long").add("_fold", "integer").add("_known", "long").add("_rest", ArrayType(rest_type))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.slices(batch.column("_text")):
                part = batch.slice(a, b - a)
                names, at, size = split_words(part.column("_text"))
                base = base_counts(part.column("_text"), names, at, size)
                langs, names, of, word, occurrence, text = words_of_models(part, other=True)
                salts = np.array([salt(lang, fold) for lang in langs.to_pylist() for fold in (0, 1)], np.uint64)
                each, lost, missing, grams = held.value.word_scores(names.take(pa.array(word)).to_pylist(), salts[of])
                known, without = np.zeros(len(part), np.int64), np.zeros(len(part), bool)
                np.add.at(known, text, each[occurrence])
                without[text[lost[occurrence]]] = True
                rest = rest_lists(text, occurrence, missing, grams, len(of), len(part))
                fold = (1 - part.column("_fold").to_numpy()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x.astype(np.int64)) for x in base), part.column("_lang"), part.column("_row"), pa.array(fold), pa.array(known, mask=without), rest.cast(pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64())])))], names=schema.names)

    rows = common.written(folded(docs, keep).withColumn("_row", F.monotonically_increasing_id()).mapInArrow(scored, schema), "known")
    rest = rows.select("_row", F.col("lang").alias("_lang"), "_fold", F.explode("_rest").alias("_g")).select("_row", "_lang", "_fold", F.col("_g.gram").alias("_gram"), F.col("_g.n").alias("_n"))
    values = scores.select(F.col("lang").alias("_lang"), F.col("fold").alias("_fold"), F.col("gram").alias("_gram"), "score")
    more = rest.join(values, ["_lang", "_fold", "_gram"]).groupBy("_row").agg(F.sum(F.col("_n") * F.nullif("score", F.lit(NONE))).alias("_more"), F.max(F.col("score") == NONE).alias("_lost"))
    total = F.when(~F.coalesce("_lost", F.lit(False)), F.col("_known") + F.coalesce("_more", F.lit(0)))
    log_perplexity = -total / UNITS / F.nullif(F.col("word_chars") + F.col("n_words"), F.lit(0))
    return rows.join(more, "_row", "left").select(*keep, *(c.split()[0] for c in BASE.split(", ")), "lang", log_perplexity.alias("log_perplexity"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATS * F.col("n_words"))


def bands(scored: DataFrame) -> DataFrame:
    """(lang, lower, upper): a language's bounds of log-perplexity, from exact quartiles of its documents that pass the base rules."""
    grain = scored.where(~base_failed() & F.col("log_perplexity").isNotNull()).groupBy("lang", F.floor(F.col("log_perplexity") * GRAIN).alias("grain")).agg(F.count("*").alias("n"))
    # A language has one row a grain, whatever its documents.
    own = Window.partitionBy("lang")
    grain = grain.withColumn("upto", F.sum("n").over(own.orderBy("grain"))).withColumn("all", F.sum("n").over(own))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("grain"))) / GRAIN
    quartiles = grain.groupBy("lang").agg(F.max("all").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3")).where(F.col("n") >= LEAST_DOCUMENTS)
    far = F.greatest(FENCE * (F.col("q3") - F.col("q1")), F.lit(math.log(LEAST_FACTOR)))
    return quartiles.select("lang", (F.col("q1") - far).alias("lower"), (F.col("q3") + far).alias("upper"))


def judged(scored: DataFrame) -> DataFrame:
    """``scored`` (a written table: it is read twice) with base_failed, the language's band and kept."""
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    return scored.join(common.hinted(bands(scored)), "lang", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)


def op13_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, log-perplexity and verdict of every document."""
    docs = common.table(spark, sf_dir, "documents")
    scored = common.written(score_whole(docs, ["doc_id"]), "scored")
    return judged(scored).select(F.col("doc_id").cast("long").alias("doc_id"), *(c.split()[0] for c in BASE.split(", ")), "base_failed", "kept", "log_perplexity")
