"""Periodic runs of words, found by probing harmonic grids.

A run is a stretch of words with smallest period q, at least ``LEAST_PERIODS``
times q and ``LEAST_WORDS`` long, that no neighbouring word extends. For each
period p the words at the multiples of p are compared with those one p on. A run
of four periods holds four multiples, so three adjoining pairs must be equal, and
so must words at any offset up to two periods on (``PROBES``): all that in whole
arrays. Grid points that survive are extended to both sides, chunk by chunk in
doubling lengths, until two words differ; points in a stretch that this period
has found already, or in a run whose period divides p, are skipped (a stretch of
period p that lies over a whole p of such a run is that run). Summed over p the
grids hold n ln n points.

The texts of an Arrow slice are laid end to end, longest first, a word of its own
between any two, so that one comparison serves all texts that are long enough
for p. A slice is a bounded number of bytes, or one text; nothing is shuffled.

Nulls: a null text has no words; a row without an id is never altered. Repeated
rows give repeated results. Of runs with the greatest exponent the first start,
then the shortest period counts. Texts of any length are read whole. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import common, tokens
from talweg.llm.words import split_words

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Offsets from a grid point that are compared before it is extended, as far as two periods reach; words in the first chunk.
PROBES, CHUNK = (1, 2, 3, 5, 8, 13, 21), 32
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def reach(words: np.ndarray, i: int, p: int, step: int) -> int:
    """From ``i`` in direction ``step`` (1 or -1): how many words in a row equal those p on."""
    n, chunk = 0, CHUNK
    while True:
        a = i + step * n
        left = len(words) - p - a if step > 0 else a + 1
        if left <= 0:
            return n
        size = min(chunk, left)
        lo = a if step > 0 else a - size + 1
        same = words[lo : lo + size] == words[lo + p : lo + p + size]
        if not same.all():
            return n + int(np.argmin(same if step > 0 else same[::-1]))
        n, chunk = n + size, chunk * 2


@dataclass
class Found:
    """Runs so far: bounds and periods."""

    start: list[int]
    end: list[int]
    period: list[int]

    def covered(self, points: np.ndarray, p: int) -> np.ndarray:
        """Which points lie, with the word p on, in a run whose period divides p."""
        start, end, period = (np.array(x, np.int64) for x in (self.start, self.end, self.period))
        use = np.flatnonzero((p % period == 0) & (end - start > p)) if len(period) else period
        if not len(use):
            return np.zeros(len(points), bool)
        use = use[np.argsort(start[use], kind="stable")]
        furthest = np.maximum.accumulate(end[use])
        last = np.searchsorted(start[use], points, "right") - 1
        return (last >= 0) & (furthest[np.maximum(last, 0)] > points + p)


def periodic_runs(words: np.ndarray, longest: int, bound=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in an array of word numbers; ``bound(p)`` says how far words may have period p."""
    found = Found([], [], [])
    for p in range(1, longest // LEAST_PERIODS + 1):
        far = bound(p) if bound else len(words)
        grid = words[:far:p]
        pair = grid[1:] == grid[:-1]
        if len(pair) < LEAST_PERIODS - 1:
            continue
        points = np.flatnonzero(pair[:-2] & pair[1:-1] & pair[2:]) * p
        for o in PROBES:
            if o > 2 * p or not len(points):
                break
            points = points[words[points + o] == words[points + o + p]]
        if not len(points):
            continue
        done = 0
        for i in points[~found.covered(points, p)].tolist():
            if i + p < done:
                continue
            start, done = i - reach(words, i - 1, p, -1), i + reach(words, i, p, 1) + p
            if done - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.start.append(start)
                found.end.append(done)
                found.period.append(p)
    order = np.lexsort((found.period, found.start))
    return tuple(np.array(x, np.int64)[order] for x in (found.start, found.end, found.period))


def planted(n: int, h: int) -> tuple[int, int] | None:
    """(first word, period) of the repetition that an id with this hash writes over a text of n words."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def altered(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """A text's word numbers with the repetition that its id asks for."""
    how = planted(len(words), zlib.crc32(str(doc_id).encode())) if doc_id is not None else None
    if how is None:
        return words
    a, p = how
    return np.concatenate([words[:a], words[a + np.arange(len(words) - a) % p]])


def runs_of_texts(parts: list[np.ndarray], vocabulary: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each text's runs; all texts are probed together."""
    size = np.array([len(x) for x in parts], np.int64)
    order = np.argsort(-size, kind="stable")
    first = np.cumsum(size[order] + 1) - size[order] - 1
    laid = np.concatenate([np.append(parts[k], vocabulary + j) for j, k in enumerate(order)]) if len(parts) else np.zeros(0, np.int64)
    ascending = size[order][::-1]

    def bound(p: int) -> int:
        """The texts of at least four times p words come first."""
        many = len(ascending) - int(np.searchsorted(ascending, LEAST_PERIODS * p))
        return int(first[many]) if many < len(first) else len(laid)

    start, end, period = periodic_runs(laid, int(size.max(initial=0)), bound)
    text = np.searchsorted(first, start, "right") - 1
    out: list = [None] * len(parts)
    lo = np.searchsorted(text, np.arange(len(parts) + 1))
    for j, k in enumerate(order):
        own = slice(lo[j], lo[j + 1])
        out[k] = start[own] - first[j], end[own] - first[j], period[own]
    return out


def best(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> int:
    """The run of greatest length over period, exactly; runs come by start, then period."""
    at = 0
    length = (end - start).tolist()
    q = period.tolist()
    for k in range(1, len(length)):
        if length[k] * q[at] > length[at] * q[k]:
            at = k
    return at


def kept_words(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """False for words that some run holds after its first period."""
    turn = np.bincount(start + period, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(turn)[:n] == 0


def collapse(docs: DataFrame, alter: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed): each text's runs and its words without repetitions; ``alter`` writes the repetitions that ids ask for."""

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        out = [([dict(start=int(s), length=int(e - s), period=int(q)) for s, e, q in zip(*runs)], " ".join(words)) for runs, words in analysed(part, alter)]
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], names=["doc_id", "runs", "collapsed"])

    return by_slices(docs, rows, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def analysed(part: pa.RecordBatch, alter: bool) -> Iterator[tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[str]]]:
    """Each row's runs and kept words."""
    vocabulary, at, size = split_words(part.column("text"))
    names = vocabulary.to_pylist()
    parts = np.split(at, np.cumsum(size)[:-1]) if len(size) else []
    if alter:
        parts = [altered(x, i) for x, i in zip(parts, part.column("doc_id").to_pylist())]
    for words, runs in zip(parts, runs_of_texts(parts, len(names))):
        yield runs, [names[w] for w in words[kept_words(len(words), *runs)].tolist()]


def by_slices(docs: DataFrame, rows, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.slices(batch.column("text")):
                yield rows(batch.slice(a, b - a))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """A row a document: the number of runs, the greatest one, and hashes of all runs and of the collapsed text."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in names[1:]]
        for (start, end, period), words in analysed(part, True):
            one: list = [len(start), None, None, None, None]
            if len(start):
                k = best(start, end, period)
                length, q = int(end[k] - start[k]), int(period[k])
                one = [len(start), int(start[k]), length, q, 1000 * length // q]
            listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()))
            for column, x in zip(columns, [*one, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(words).encode()).hexdigest()]):
                column.append(x)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return by_slices(docs, rows, SCHEMA)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of ``documents``, a tenth of which repeat themselves from some word on."""
    return digests(common.table(spark, sf_dir, "documents"))
