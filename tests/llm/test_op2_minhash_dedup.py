"""Consistent weighted sampling, exact block products, and classes against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from tests.llm.helpers import DOCS, docs, prose, word, write

from talweg.llm import common
from talweg.llm import op2_minhash_dedup as D


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def plain(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = word(rng) + "x"
    return " ".join(w)


def test_shingles_match_plain_counting():
    rng = random.Random(1)
    texts = ["", None, "one", "a b c d", "a b c d e", "a b c d e f a b c d e f", "  Tab\tand\nline  ", prose(rng, 300), "x " * 3000]
    s = D.Shingles(pa.array(texts))
    assert s.size.tolist() == [len(shingles(t)) for t in texts]
    assert s.count.sum() == sum(sum(shingles(t).values()) for t in texts)
    keys = [tuple(k) for k in D.Shingles(pa.array(["A b", "a  B\n", "b a", "", None])).keys.tolist()]
    assert keys[0] == keys[1] != keys[2] and keys[3] == keys[4] == (0, 0)
    assert len(D.Shingles(pa.array([], pa.string())).keys) == 0


def test_samples_agree_as_often_as_weighted_jaccard_says():
    rng = np.random.default_rng(0)
    error, spread = [], []
    for _ in range(120):
        n = 200
        ids = np.sort(rng.choice(1 << 44, n, replace=False).astype(np.uint64))
        w = rng.choice([1.0, 1.5, 2.0, 7.0], n).astype(np.float32)
        k = int(rng.integers(0, n))
        a, b = (ids[: n - k // 2], w[: n - k // 2]), (ids[k // 2 :], w[k // 2 :] * rng.choice([1, 1, 2], n - k // 2).astype(np.float32))
        got = D.samples(np.r_[a[0], b[0]], np.r_[a[1], b[1]], np.array([len(a[0]), len(b[0])]), draws=128)
        true = D.jaccard(a, b)
        error.append((got[0] == got[1]).mean() - true)
        spread.append(true * (1 - true) / 128)
    assert abs(np.mean(error)) < 4 * np.sqrt(np.mean(spread) / 120) and np.std(error) < 1.3 * np.sqrt(np.mean(spread))


def test_block_products_are_weighted_jaccard():
    rng = random.Random(2)
    base = prose(rng, 80)
    texts = [edited(rng, base, k % 12) for k in range(30)] + ["a a a a a a a a a", "a a a a a a", "", base + " " + base]
    s = D.Shingles(pa.array(texts))
    idf = (1 + np.random.default_rng(3).random(D.DF_BUCKETS) / 4).astype(np.float32)
    w, ends = s.weights(idf), np.cumsum(s.size)
    vectors = [(s.id[e - n : e], w[e - n : e]) for e, n in zip(ends, s.size)]
    x, y = np.arange(0, 20), np.arange(10, len(texts))
    got = D.overlaps(s, idf, x, y)
    want = np.array([[D.jaccard(vectors[i], vectors[j]) for j in y] for i in x])
    other = x[:, None] != y[None, :]  # a row is not compared with itself
    assert np.abs(got - want)[other].max() < 1e-5


def corpus(rng):
    bases = [prose(rng, rng.choice([20, 60, 150])) for _ in range(25)]
    texts = [prose(rng, 60) for _ in range(60)]
    for b in bases:
        texts += [b] * rng.randint(1, 3) + [edited(rng, b, e) for e in (1, 2, 4)]
    hot = prose(rng, 100)
    texts += [edited(rng, hot, rng.randint(0, 9)) for _ in range(150)]
    rng.shuffle(texts)
    return texts


def test_classes_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 40)
    texts = corpus(random.Random(5))
    path = write(spark, docs(texts), DOCS, tmp_path, "documents")
    got = {r.doc_id: r.class_id for r in D.op2_minhash_dedup(spark, path).collect()}
    assert len(got) == len(texts)
    s = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            similarity = plain(s[i], s[j])
            if texts[i] == texts[j] or similarity >= 0.85:  # further from the threshold than the weights can move it
                assert got[i] == got[j], similarity
    # No class holds what no chain of near copies connects.
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if plain(s[i], s[j]) >= 0.74:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for i, c in got.items():
        assert find(i) == find(c) and c <= i


def test_edge_cases(spark):
    rows = [(7, None, "x"), (3, "", "y"), (9, "   ", None), (4, "Same words here", "z"), (4, "Same words here", "z"), (5, "same  words HERE", "z"), (None, "same words here", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = sorted(map(tuple, D.near_duplicates(df).collect()))
    assert got == [(3, 3, True), (4, 4, True), (5, 4, False), (7, 3, False), (9, 3, False)]
    assert D.near_duplicates(df.limit(0)).count() == 0


def test_different_texts_under_one_id_each_keep_a_class(spark):
    rows = [(5, "alpha one", 1), (7, "alpha ONE", 2), (5, "beta two", 3), (2, "beta  two", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    assert sorted(map(tuple, D.near_duplicates(df).collect())) == [(2, 2, True), (5, 2, False), (5, 5, True), (7, 5, False)]
    assert {r.text for r in D.one_of_each(df.drop("kept")).collect()} == {"alpha one", "beta  two"}


def test_every_class_keeps_one_document_and_no_text_vanishes(spark):
    rng = random.Random(8)
    bases = [prose(rng, 80) for _ in range(12)]
    rows = [(rng.choice([None, *range(-20, 20)]), rng.choice([None, "", b, b, b.upper(), edited(rng, b, 1)]), k % 3) for k, b in enumerate(rng.choices(bases, k=200))]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies int")
    got = D.classes(df).collect()
    distinct = {(i, t or "") for i, t, _ in rows if i is not None}
    assert len(got) == len(distinct) and sum(r.copies for r in got) == sum(i is not None for i, _, _ in rows)
    members = {}
    for r in got:
        members.setdefault(bytes(r["class"]), []).append(bytes(r.name))
    assert all(c == min(m) for c, m in members.items())
    kept = D.one_of_each(df).collect()
    named = [r for r in kept if r.doc_id is not None]
    assert len(named) == len(members) and len(kept) - len(named) == sum(i is None for i, _, _ in rows)
    for _, t in distinct:
        assert any(plain(shingles(t), shingles(r.text)) > 0.7 or not (t or r.text) for r in named)


def test_blocks_link_outsiders_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 4)
    rng = random.Random(12)
    a, b = prose(rng, 60), prose(rng, 60)
    texts = [edited(rng, a, 1) for _ in range(14)] + [edited(rng, b, 1) for _ in range(9)]
    docs_ = D.named(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    # One bucket: ten of the first kind are one component, all others still alone.
    rest = docs_.selectExpr("1L bucket", "name a", "IF(doc_id < 10, 1, doc_id) k")
    first = docs_.where("doc_id = 0").first().name
    from pyspark.sql import functions as F

    rest = rest.select("bucket", "a", F.when(F.col("k") == 1, F.lit(bytearray(first))).otherwise(F.col("a")).alias("component"))
    idf = spark.sparkContext.broadcast(np.ones(D.DF_BUCKETS, np.float32))
    edges = D.compared(rest, docs_, idf, 0.8)
    inside = rest.where(F.col("a") != F.col("component")).select(F.col("a").alias("src"), F.col("component").alias("dst"))
    got = common.connected_components(edges.union(inside)).toPandas()
    sizes = sorted(got.groupby(got["component"].map(bytes)).size().tolist())
    want = {}
    for i in range(len(texts)):
        want[i] = next((want[j] for j in range(i) if plain(shingles(texts[i]), shingles(texts[j])) >= 0.8), i)
    if sorted(Counter(want.values()).values()) == [9, 14]:
        assert sizes == [9, 14]


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5300)] + [(None, 1), (2, 2)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    while True:
        new = dict(label)
        for a, b in edges:
            if a in new and b in new:
                new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    assert got == label
