"""Licence scan: Dice coefficient over word bigrams against licence templates.

Text and templates are normalised alike: lower case, whatever is neither letter
nor digit is a space. A text is compared as a whole, line by line, and by each
run of adjoining lines in which half of the bigrams are a template's (a licence
wrapped over lines inside a longer text). Besides, whatever the lines, a template
of which a text holds enough bigrams is compared with every window of words that
starts and ends at one of them; a window half of which a better one covers
doesn't count. What repeats itself over and over (``op12_periodic_runs``) is shortened
to three periods for that: the windows in the rest hold the same bigrams. With m and n distinct bigrams a
coefficient of at least t needs m and n within a factor of (2 - t) / t, so
templates whose size is out of bounds are never compared; nor are passages that
share fewer bigrams with all templates together than the smallest needs. A
passage counts for the template that it is most like.

The templates are a parameter and small; each task looks them up locally, so a
scan is one pass without a shuffle, a slice of a batch at a time.

Nulls and empty texts match nothing. Repeated rows match alike and stay. A tie
between passages or templates goes to the first; texts of any length are read whole. An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from talweg.llm import common, tokens
from talweg.llm.licences import TEMPLATES
from talweg.llm.op12_periodic_runs import periodic_runs

THRESHOLD = 0.8
MATCHES = "doc_id long, license string, score double, passage string, first_word long, n_words long, template long"


def normalise(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def without_repetitions(pairs: np.ndarray) -> np.ndarray:
    """Places of the bigrams that are left when every run of four periods or more keeps three: its first two, and its end in the same phase."""
    kept = np.ones(len(pairs), bool)
    free = 0
    for start, end, period in zip(*(x.tolist() for x in periodic_runs(pairs, len(pairs)))):
        if start >= free:
            kept[start + 2 * period : start + 2 * period + (end - start - 3 * period) // period * period] = False
            free = end
    return np.flatnonzero(kept)


class Scanner:
    """Templates made ready, and the scan of one Arrow array of texts."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD):
        self.names = [n for n, _ in templates]
        self.t = threshold
        words: dict[str, int] = {}
        sets = []
        for _, text in templates:
            ids = [words.setdefault(w, len(words)) for w in normalise(text)]
            sets.append(set(zip(ids, ids[1:])))
        self.words, self.size = words, [len(s) for s in sets]
        self.inverted: dict[int, list[int]] = defaultdict(list)
        self.table = np.zeros((len(words) + 1, len(words) + 1), bool)  # the last is any other word
        for k, s in enumerate(sets):
            for a, b in s:
                self.inverted[a * (len(words) + 1) + b].append(k)
                self.table[a, b] = True
        self.least = min((n for n in self.size if n), default=1) * threshold / (2 - threshold)

    def compare(self, pairs: np.ndarray, known: np.ndarray, best: dict[str, tuple], passage: str, first: int) -> None:
        """Give the passage to its best template, each licence keeping its best passage. ``pairs``: the passage's bigrams; ``known``: as templates' bigrams, or -1."""
        m = len(np.unique(pairs))
        shared = Counter(k for key in np.unique(known[known >= 0]).tolist() for k in self.inverted[key])
        top = (0.0, 0)
        for k, both in shared.items():
            n = self.size[k]
            if m > n * (2 - self.t) / self.t or n > m * (2 - self.t) / self.t:
                continue
            top = max(top, (2 * both / (m + n), -k))
        score, k = top[0], -top[1]
        if score >= self.t and score > best.get(self.names[k], (0,))[0]:
            best[self.names[k]] = (score, passage, first, len(pairs) + 1, k)

    def windows(self, pairs: np.ndarray, keys: np.ndarray, best: dict[str, tuple]) -> None:
        """Give each template its best windows of a text's bigrams, but for those of which a better one covers half."""
        shared = Counter(k for key in np.unique(keys[keys >= 0]).tolist() for k in self.inverted[key])
        prior, found, back = None, [], np.zeros(0, np.int64)
        for k, both in shared.items():
            n = self.size[k]
            if both < n * self.t / (2 - self.t):
                continue
            if prior is None:  # where each bigram stood last
                back = without_repetitions(pairs)
                pairs, keys = pairs[back], keys[back]
                place: dict[int, list[int]] = defaultdict(list)
                for x, key in zip(np.flatnonzero(keys >= 0).tolist(), keys[keys >= 0].tolist()):
                    place[key].append(x)
                order = np.argsort(pairs, kind="stable")
                prior = np.full(len(pairs), -1)
                again = pairs[order[1:]] == pairs[order[:-1]]
                prior[order[1:][again]] = order[:-1][again]
            own = np.zeros(len(pairs), bool)
            for key in place:
                if k in self.inverted[key]:
                    own[place[key]] = True
            most = n * (2 - self.t) / self.t
            for a in np.flatnonzero(own).tolist():
                reach = int(most) + 1
                while True:
                    fresh = prior[a : a + reach] < a
                    m = np.cumsum(fresh)
                    if m[-1] > most or a + reach >= len(pairs):
                        break
                    reach *= 2
                score = np.where(m <= most, 2 * np.cumsum(fresh & own[a : a + reach]) / (m + n), 0)
                end = int(score.argmax())
                if score[end] >= self.t:
                    found.append((-float(score[end]), k, a, a + end + 1))
        taken: list[tuple[int, int]] = []
        for score, k, a, b in sorted(found):
            if all(2 * (min(b, d) - max(a, c)) < b - a for c, d in taken):
                taken.append((a, b))
                if -score > best.get(self.names[k], (0,))[0]:
                    first, last = int(back[a]), int(back[b - 1])
                    best[self.names[k]] = (-score, "words", first, last - first + 2, k)

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, str, tuple]]:
        """(row, licence, its best match) of every text."""
        x = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        x = pc.replace_substring_regex(x, r"[^\p{L}\p{N}\n]+", " ")
        lists = pc.split_pattern(pc.replace_substring(x, "\n", " \n "), " ")
        if not len(lists):
            return
        coded = lists.flatten().dictionary_encode()
        vocabulary = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = coded.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        other = len(self.words)
        known = np.array([-1 if w == "\n" else -2 if w == "" else self.words.get(w, other) for w in vocabulary])[at]
        line = np.cumsum(known == -1)
        real = known >= 0
        at, row, known, line = at[real], row[real], known[real], line[real]
        if len(at) < 2:
            return
        same_row, same_line = row[1:] == row[:-1], (row[1:] == row[:-1]) & (line[1:] == line[:-1])
        hit = self.table[known[:-1], known[1:]] & same_row
        pairs = at[:-1] * len(vocabulary) + at[1:]
        keys = np.where(hit, known[:-1] * (other + 1) + known[1:], -1)
        starts = np.flatnonzero(np.r_[True, ~same_row])
        ends = np.r_[starts[1:], len(at)]
        hits = np.r_[0, np.cumsum(hit)]
        for a, b in zip(starts.tolist(), ends.tolist()):
            if hits[b - 1] - hits[a] < self.least:
                continue
            best: dict[str, tuple] = {}
            self.compare(pairs[a : b - 1], keys[a : b - 1], best, "text", 0)
            bounds = np.r_[a, np.flatnonzero(~same_line[a : b - 1]) + a + 1, b]
            if len(bounds) > 2:
                lo, hi = bounds[:-1], bounds[1:]
                inside = hits[hi - 1] - hits[lo]
                for i in np.flatnonzero(inside >= self.least).tolist():
                    self.compare(pairs[lo[i] : hi[i] - 1], keys[lo[i] : hi[i] - 1], best, "line", int(lo[i] - a))
                dense = np.r_[False, 2 * inside >= np.maximum(hi - lo - 1, 1), False]
                edges = np.flatnonzero(np.diff(dense.astype(np.int8)))
                for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    if j - i > 1:
                        self.compare(pairs[lo[i] : hi[j - 1] - 1], keys[lo[i] : hi[j - 1] - 1], best, "lines", int(lo[i] - a))
            self.windows(pairs[a : b - 1], keys[a : b - 1], best)
            for name in sorted(best):
                yield int(row[a]), name, best[name]


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and licence that a passage of it matches, with the best match (``MATCHES``)."""
    templates = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            names = batch.column(0)
            for a, b in tokens.slices(batch.column(1)):
                rows = [(names[a + i].as_py(), name, *match) for i, name, match in scanner.scan(batch.column(1).slice(a, b - a))]
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in MATCHES.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(scan, MATCHES)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all ``documents`` against the standing templates."""
    return license_scan(common.table(spark, sf_dir, "documents"))
