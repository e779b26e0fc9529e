import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talweg.llm import op5_pii as P

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for kind, rx in PLAIN.items():
        for m in rx.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p or 0) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def results(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    found = P.find(df).select("doc_id", F.size("base").alias("n"), P.joined(F.col("base")).alias("base"), P.joined(F.col("added")).alias("added"))
    return {r.doc_id: r for r in found.collect()}


def test_base_spans_match_the_plain_expressions(spark):
    texts = [
        "", None, "a@b.c_d@e.f x@y", "é 1.2.3.4 999.1.1.1 00000255.01.1.0001 1.2.3.4.5.6.7.8", "4111 1111 1111 1111, 4111-1111-1111-1112 1 2 3",
        "call +1 (377) 555-0271 now +12 +1234567890123456789", "a@b.com.", "日本 x@y.jp 語 +44 20 7946 0958", "5 " * 4000 + "end", "a" * 30000 + "@", "1" * 20000,
        "x.y@z-1.co.uk,4012888888881881;4012888888881881", "1 2.3.4.5 6", "++1 23456789 0", "@@ a@b@c.d",
    ]
    got = results(spark, [(i, t, "k") for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        assert got[i].base == ",".join(brute(t)), t


def test_random_texts(spark):
    pieces = st.sampled_from(["a", "@", ".", "b.c", "1", "12", "255", "256", "0", " ", "-", "+", "+1", "(", ")", "4111111111111111", "é", "_", "%", "\n"])
    seen = []

    @settings(max_examples=400, database=None, derandomize=True)
    @given(st.lists(pieces, max_size=25))
    def gather(parts):
        seen.append("".join(parts))

    gather()
    got = results(spark, [(i, t, "k") for i, t in enumerate(seen)])
    for i, t in enumerate(seen):
        assert got[i].base == ",".join(brute(t)), repr(t)


def test_bootstrap_finds_identifiers_in_learnt_contexts(spark):
    rows = [(i, f"Some words then please write to user{i}@mail.example.com today", "k") for i in range(12)]
    rows += [(100, "More text, please write to ID-88231x today", "k"), (101, "An unrelated code is here: ID-99231x today", "k"), (102, None, "k"), (103, "", "k")]
    got = results(spark, rows)
    assert [k for k, r in got.items() if r.added] == [100]
    start, end = map(int, got[100].added.split(":")[1:])
    assert rows[12][1][start:end] == "ID-88231x"


def test_bootstrap_takes_many_unknown_and_a_second_generation(spark):
    rows = [(i, f"Just call me at +1 377 555 {1000 + i} soon", "seed") for i in range(40)]
    rows += [(100 + i, f"Just call me at 0377/555{2000 + i} soon", "unknown") for i in range(80)]
    rows += [(300 + i, f"The old member number was 0377/555{2000 + i} then", "second") for i in range(20)]
    rows += [(400 + i, f"The old member number was 0488-77{300 + i} then", "second") for i in range(20)]
    # As many counterexamples as seeds: a context of addresses and of years.
    rows += [(500 + i, f"It was made in user{i}@mail.example.com once", "base") for i in range(20)]
    rows += [(600 + i, f"It was made in {1950 + i} once", "year") for i in range(20)]
    rows += [(700, "It was made in QX-771234 once", "other")]
    rows += [(800, "Just call me at 2024-01-31 soon", "date")]
    got = results(spark, rows)
    for i, text, kind in rows:
        spans = [tuple(map(int, x.split(":")[1:])) for x in got[i].added.split(",") if x]
        assert len(spans) == (kind in ("unknown", "second")), text
        assert all(any(c.isdigit() for c in text[a:b]) for a, b in spans)


def test_contexts_at_a_start_in_lists_and_after_long_words(spark):
    far = "x" * 300
    rows = [(i, f"Kundennummer: user{i}@mail.example.com", "seed") for i in range(12)]
    rows += [(20 + i, f"These are the {far} user{i}@mail.example.com ok", "seed") for i in range(12)]
    rows += [(50, "Kundennummer: 12345678", 1), (51, "Kundennummer: 12345678, 23456789, 34567890", 3), (52, f"Those are the {far} 12345678", 1), (54, "12345678", 0), (55, "Kundennummer: " + "23456789, " * 40, 40)]
    got = results(spark, rows)
    for i, text, n in rows:
        assert len([x for x in got[i].added.split(",") if x]) == (0 if n == "seed" else n), text[:60]


def test_right_contexts_and_identifiers_of_few_digits(spark):
    rows = [(i, f"{'abcdefghijkl'[i]} +1 377 555 {1000 + i} is where we answer", "seed") for i in range(12)]
    rows += [(20, "or else AB-CDEF/7 is where we answer", "found"), (21, "or else 21st is where we answer", "none"), (22, "or else 12kg is where we answer", "none"), (23, "or else word is where we answer", "none")]
    got = results(spark, rows)
    assert {i for i, r in got.items() if r.added} == {20}


def plain_bootstrap(mentions):
    """The rounds over dictionaries: (key, start, end) that are added. ``mentions``: key, start, end, seed, instance, pattern."""
    edges = {}
    for _, _, _, seed, instance, pattern in mentions:
        edges[pattern, instance] = max(edges.get((pattern, instance), -2), seed)
    seeds = {}
    for (_, i), s in edges.items():
        seeds[i] = max(seeds.get(i, -2), s)
    belief, accepted = dict(seeds), {}
    for _ in range(P.ROUNDS):
        accepted = {}
        for p in {p for p, _ in edges}:
            known = [belief[i] for q, i in edges if q == p and belief[i] != 0]
            score = sum(max(b, 0) for b in known) / (len(known) + 1)
            if sum(b > 0 for b in known) >= P.SUPPORT and score >= P.ACCEPT:
                accepted[p] = score
        for i, s in seeds.items():
            belief[i] = s if s != 0 else max((accepted[p] for p, j in edges if j == i and p in accepted), default=0.0)
    return {(k, a, b) for k, a, b, s, _, p in mentions if s == 0 and p in accepted}


def test_bootstrap_against_plain_rounds(spark):
    import random

    rng = random.Random(7)
    some = 0
    for n in (40, 400):
        kinds = {i: rng.choice([1.0, 1.0, 1.0, -1.0, 0.0, 0.0, 0.0]) for i in range(n)}
        rows = [(f"k{r}", r, r + 5, kinds[i], i, rng.choice([i % 7, i % 11, rng.randrange(15)])) for r, i in enumerate(rng.choices(range(n), k=3 * n))]
        got = P.bootstrap(spark.createDataFrame(rows, "row_key string, start int, end int, seed double, instance long, pattern long")).collect()
        want = plain_bootstrap(rows)
        assert {tuple(r) for r in got} == want
        some += len(want)
    assert some


def test_empty_table_repeated_rows_and_query_columns(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.find(empty).count() == 0
    rows = [(1, "x@y.org"), (1, "x@y.org"), (None, "1.2.3.4"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op5_pii(spark, str(tmp_path)).collect()
    assert sorted((r.n_email, r.n_ip, r.spans) for r in got) == [(0, 0, ""), (0, 1, "ip:0:7"), (1, 0, "email:0:7"), (1, 0, "email:0:7")]
    assert {r.base_sha256 for r in got if r.n_email} == {hashlib.sha256(b"email:0:7").hexdigest()}


def test_redact_replaces_spans_and_keeps_the_rest(spark):
    rows = [(1, "mail a@b.com and +1 (377) 555-0271.", "x"), (1, "mail a@b.com and +1 (377) 555-0271.", "x"), (2, None, "y"), (3, "nothing", None), (4, "4111111111111111", "z"), (5, "é c@d.org", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text, r.source) for r in P.redact(df).fillna("-").collect())
    assert got == [(1, "mail [EMAIL] and [PHONE].", "x")] * 2 + [(2, "-", "y"), (3, "nothing", "-"), (4, "[CARD]", "z"), (5, "é [EMAIL]", "z")]
