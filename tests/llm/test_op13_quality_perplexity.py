import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.helpers import DOCS, prose

from talweg.llm import op13_quality_perplexity as Q


def plain_model(words, order=5, share=0.0, whole=None):
    """Modified Kneser-Ney from word counts, n-gram by n-gram; returns a function of (context, character)."""
    s, e = Q.START, Q.END
    levels = {order: Counter()}
    for w, n in words.items():
        m = s * (order - 1) + w + e
        for i in range(len(w) + 1):
            levels[order][m[i : i + order]] += n
    for k in range(order - 1, 0, -1):
        levels[k] = Counter()
        for g, n in levels[k + 1].items():
            levels[k][g[1:]] += n if g[1:].startswith(s) else 1
    d = {}
    for k, grams in levels.items():
        n = [sum(c == i for c in grams.values()) for i in range(5)]
        d[k] = list(Q.PLAIN)
        for i in (1, 2, 3):
            if n[i] and n[1] + 2 * n[2]:
                own = i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i]
                d[k][i - 1] = own if 0 <= own <= i else Q.PLAIN[i - 1]
    totals, held = defaultdict(float), defaultdict(float)
    least = {k: share * (whole or {}).get(k, sum(g.values())) for k, g in levels.items()}
    for k, grams in levels.items():
        for g, n in grams.items():
            totals[k, g[:-1]] += n
            if n >= least[k]:
                held[k, g[:-1]] += n - d[k][min(n, 3) - 1]

    def p(h, c, k=order):
        if not k:
            return 1 / (len(levels[1]) + 1)
        h = h[len(h) - k + 1 :]
        below = p(h[1:], c, k - 1)
        if (k, h) not in totals:
            return below
        n = levels[k].get(h + c, 0)
        own = n - d[k][min(n, 3) - 1] if n and n >= least[k] else 0
        return own / totals[k, h] + (1 - held[k, h] / totals[k, h]) * below

    return p, levels


def word_log(p, w, order=5):
    m = Q.START * (order - 1) + w + Q.END
    return sum(math.log(p(m[i : i + order - 1], m[i + order - 1])) for i in range(len(w) + 1))


def corpus():
    rng = random.Random(8)
    out = [prose(rng, rng.randint(25, 120)) for _ in range(240)]
    other = ["".join(rng.choice("xyzöäüß") for _ in range(rng.randint(2, 9))) for _ in range(80)]
    return [(i, t, "en", "s", 0) for i, t in enumerate(out)] + [(1000 + i, " ".join(rng.choice(other) for _ in range(40)), "de", "s", 0) for i in range(120)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.mark.parametrize("share", [0.0, 1e-3])
def test_scores_are_those_of_a_plain_model(spark, docs, share):
    fold = {(r._text, r._lang): r._fold for r in Q.folded(docs, []).collect()}
    counts = defaultdict(Counter)
    for _, t, lang, *_ in corpus():
        counts[lang, fold[t, lang]].update(t.split())
    whole = Counter()
    for c in counts.values():
        for k, grams in plain_model(c)[1].items():
            whole[k] += sum(grams.values())
    plain = {k: plain_model(c, share=share, whole=whole)[0] for k, c in counts.items()}
    fitted = Q.fit(docs, share=share)
    # Known and unknown words, unknown characters.
    for lang in ("en", "de"):
        words = [*list(counts[lang, 0])[:60], *list(counts["de", 1])[:20], "qqq", "日本", "a" * 50, "th"]
        for f in (0, 1):
            got = fitted.word_scores(words, np.full(len(words), Q.salt(lang, f), np.uint64))
            assert np.allclose(got, [word_log(plain[lang, f], w) for w in words], atol=1e-4)
    if share:
        assert sum(len(t[0]) for t in fitted.p) < sum(len(t[0]) for t in Q.fit(docs, share=0.0).p)
    # Documents go by the other fold's model.
    rows = {r.doc_id: r for r in Q.score(docs, fitted, ["doc_id"]).collect()}
    for i, t, lang, *_ in corpus()[::40]:
        w = t.split()
        want = -sum(word_log(plain[lang, 1 - fold[t, lang]], x) for x in w) / sum(len(x) + 1 for x in w)
        assert abs(rows[i].log_perplexity - want) < 1e-4


def test_probabilities_add_up_to_one():
    words = Counter({"the": 5, "then": 2, "and": 3, "an": 1, "hen": 1, "tan": 4})
    for share in (0.0, 0.05):
        p, levels = plain_model(words, share=share)
        known = [g for g in levels[1]]
        for h in ("\t\t\t\t", "\t\tth", "\tthe", "zzzz"):
            assert abs(sum(p(h, c) for c in known) + p(h, "?") - 1) < 1e-9


def plain_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    inside = {k for i, x in enumerate(windows) if x in twice for k in range(i, i + 8)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)]


def test_base_counts_against_plain_python():
    rng = random.Random(9)
    texts = [None, "", "\n\n", "one", "a b c d e f g h a b c d e f g h", "x\n x\nx\nx ", "la " * 30, "É|#\x0b\x1c<> \x1c"]
    for _ in range(150):
        few = [f"w{k}" for k in range(rng.choice([1, 2, 5, 40]))]
        texts.append("".join(rng.choice(few) + rng.choice([" ", "\n", " ", "\t", " | "]) for _ in range(rng.randint(0, 80))))
    block = " ".join(rng.choice("abcdefgh") for _ in range(8))
    texts += [f"{prose(rng, 30)} {block} {prose(rng, 5)} {block}", prose(rng, 3000)]
    arr = pa.array([t or "" for t in texts])
    got = np.stack(Q.base_counts(arr, *Q.split_words(arr)), 1).tolist()
    assert got == [plain_base(t) for t in texts]


def test_bands_reject_other_languages_and_keep_clean_text(spark):
    rng = random.Random(10)
    strange = [(5000, " ".join("ḁḃḉḋ" * 3 for _ in range(1)) + " " + " ".join("".join(rng.choice("日本語中文字") for _ in range(5)) for _ in range(40)), "en", "s", 0)]
    few = [(6000 + i, prose(rng, 30), "nl", "s", 0) for i in range(5)]
    odd = [(7000, None, "en", "s", 0), (7001, "", None, "s", 0), (None, prose(rng, 60), "en", "s", 0), (7002, "again and again " * 50, "en", "s", 0), (7003, prose(rng, 20_000), "en", "s", 0)]
    hot = [(8000 + i, corpus()[3][1], "en", "s", 0) for i in range(400)]
    rows = corpus() + strange + few + odd + hot + [corpus()[0]]
    docs = spark.createDataFrame([(*r, "x", "y", 1.0, "z") for r in rows], DOCS + ", n_words string, _text string, log_perplexity double, kept string")
    got = Q.judged(Q.common.written(Q.score(docs, Q.fit(docs), ["doc_id"]), "scored")).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[5000] and not any(r.base_failed for r in got if r.doc_id == 5000)
    assert all(kept[i] for i, *_ in corpus()) and all(kept[i] for i, *_ in few + hot) and kept[None] and kept[7003]
    assert not kept[7000] and not kept[7001] and not kept[7002]
    copies = {r.log_perplexity for r in got if r.doc_id is not None and r.doc_id >= 8000}
    assert len(copies) == 1


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert Q.judged(Q.common.written(Q.score(docs, Q.fit(docs), ["doc_id"]), "scored")).count() == 0


def whole_models(rows, fold):
    counts = defaultdict(Counter)
    for _, t, lang, *_ in rows:
        counts[lang or "", fold[t or "", lang or ""]].update((t or "").split())
    return {k: plain_model(c)[0] for k, c in counts.items()}


def test_rare_n_grams_keep_their_own_probabilities_beside_millions_of_others(spark, tmp_path):
    # More than 2 ** 21 counts of an order: n-grams seen once or twice are below 2 ** -20 of them.
    line = "the same old words of the hot document "
    rows = corpus() + [(9000 + i, line * 700 + str(i), "en", "s", 0) for i in range(120)]
    assert sum(len(r[1]) for r in rows) > 3 << 20
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    fold = {(r._text, r._lang): r._fold for r in Q.folded(docs, []).collect()}
    plain = whole_models(rows, fold)
    got = {r.doc_id: r.log_perplexity for r in Q.op13_quality_perplexity(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, lang, *_ in rows[:360:30]:
        w = t.split()
        want = -sum(word_log(plain[lang, 1 - fold[t, lang]], x) for x in w) / sum(len(x) + 1 for x in w)
        assert abs(got[i] - want) < 1e-6


def test_scores_are_the_same_whatever_is_broadcast(spark):
    rows = corpus()[::3] + [(6000, "einzig allein", "xx", "s", 0), (6001, None, None, "s", 0), (None, "a \U0001f600 b", "en", "s", 0), corpus()[0], (6002, "same text", "yy", "s", 0), (6003, "same text", "yy", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    runs = [sorted(Q.score_whole(docs, ["doc_id"], most=most).collect(), key=key) for most in (Q.MOST, 300, 0)]
    assert len(runs[0]) == len(rows) and runs[0] == runs[1] == runs[2]
    # No model of the other fold, or no words.
    assert [r.log_perplexity for r in runs[0] if r.doc_id in (6000, 6001, 6002, 6003)] == [None] * 4
    fold = {(r._text, r._lang): r._fold for r in Q.folded(docs, []).collect()}
    plain = whole_models(rows, fold)
    texts = {i: (t, lang) for i, t, lang, *_ in rows}
    for r in runs[0]:
        t, lang = texts[r.doc_id]
        if r.log_perplexity is not None:
            w = t.split()
            want = -sum(word_log(plain[lang, 1 - fold[t, lang]], x) for x in w) / sum(len(x) + 1 for x in w)
            assert abs(r.log_perplexity - want) < 1e-6
