import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tests.llm.helpers import DOCS, prose, write

from talweg.llm import op12_periodic_runs as P


def plain_runs(w):
    """Every run by its definition: stretches of equal words p apart, the smallest p of a stretch."""
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            a = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > a and i + p - a >= max(6, 4 * p):
                found.setdefault((a, i + p), p)
            i = max(i, a + 1)
    return sorted((a, b, p) for (a, b), p in found.items())


def plain_row(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    drop = {k for a, b, p in runs for k in range(a + p, b)}
    top = [None] * 4
    if runs:
        a, b, p = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))
        top = [a, b - a, p, 1000 * (b - a) // p]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return [i, len(runs), *top, sha("".join(f"{a},{b - a},{p}\n" for a, b, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in drop))]


def noisy(rng):
    few = rng.choice([1, 2, 3, 6])
    w = [rng.randrange(few) for _ in range(rng.randint(0, 90))]
    for _ in range(rng.randint(0, 4)):
        at, p = rng.randint(0, len(w)), rng.randint(1, 14)
        w[at:at] = [rng.randrange(few) for _ in range(p)] * rng.randint(2, 8)
    return w


def test_runs_of_many_texts_at_once_are_those_of_the_definition():
    rng, total = random.Random(2), 0
    for _ in range(150):
        texts = [noisy(rng) for _ in range(rng.randint(0, 12))]
        got = P.runs_of_texts([np.array(t, np.int64) for t in texts], 6)
        for t, runs in zip(texts, got):
            assert [tuple(map(int, r)) for r in zip(*runs)] == plain_runs(t)
            total += len(runs[0])
    assert total > 1000


def test_long_periods_and_fibonacci_words():
    rng = random.Random(3)
    block = [rng.randrange(50) for _ in range(700)]
    fib = ["0", "01"]
    while len(fib[-1]) < 2000:
        fib.append(fib[-1] + fib[-2])
    for w in (block * 4, block * 3, [1, *block * 5, 2], [int(c) for c in fib[-1]], [0, 0, 0, 0, 0, 0, 1] * 40, [0] * 5, [0] * 6):
        assert [tuple(map(int, r)) for r in zip(*P.runs_of_texts([np.array(w, np.int64)], 50)[0])] == plain_runs(w)


def test_extension_stops_at_the_ends_whatever_the_chunks():
    w = np.array([9] + [1, 2, 3] * 400 + [7], np.int64)
    for i in (1, 300, 1100):
        assert i - P.reach(w, i - 1, 3, -1) == 1 and i + P.reach(w, i, 3, 1) + 3 == len(w) - 1
    assert P.reach(np.zeros(1000, np.int64), 0, 1, 1) == 999 and P.reach(np.zeros(1000, np.int64), 998, 1, -1) == 999


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    texts = [" ".join(f"w{x}" for x in noisy(rng)) for _ in range(150)] + [prose(rng, n) for n in (1, 50, 3000)]
    texts += [None, "", " \t\x0b ", "a\x1cb " * 8, "x y\n" * 50, "la " * 4000, "É é " * 9]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts * 2)] + [(None, "a b " * 9, "en", "s", 0), (7, texts[7], "en", "s", 0)]


def test_query_rows(spark, rows, tmp_path):
    d = write(spark, rows, DOCS, tmp_path, "documents")
    got = P.op12_periodic_runs(spark, d)
    assert got.columns == [c.split()[0] for c in P.SCHEMA.split(", ")]
    assert sorted(map(list, got.collect()), key=repr) == sorted((plain_row(r[0], r[1]) for r in rows), key=repr)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 10


def test_collapse_keeps_one_period(spark):
    docs = spark.createDataFrame([(1, "start " + "a b c " * 5 + "end", 1), (2, None, 1)], "doc_id long, text string, runs int")
    one, none = P.collapse(docs).orderBy("doc_id").collect()
    assert one.collapsed == "start a b c end" and [tuple(r) for r in one.runs] == [(1, 15, 3)]
    assert none.collapsed == "" and none.runs == []
    assert P.collapse(docs.limit(0)).count() == 0
