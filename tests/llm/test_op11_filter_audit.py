import random
from itertools import permutations

import duckdb
import pytest
from tests.llm.helpers import DOCS, prose, write

from talweg.llm import op11_filter_audit as A


def failing(rows):
    """Each row's failing filters, from the contract's words."""
    import re

    out = {}
    for at, (i, text, *_) in enumerate(rows):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t))
        f += "D" * any(c in "#$%&*|" for c in t) + "E" * (i is not None and any(j is not None and j < i and (x or "") == t for j, x, *_ in rows))
        out[at] = f
    return out


def plain(rows, labels):
    fails, out = failing(rows), {}
    for part in {r[2] or "" for r in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        said = lambda k, c: any(x[0] == rows[k][0] and x[c] == 1 for x in labels) and rows[k][0] is not None
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in fails[k] for k in own) - len(gone), sum(fails[k] == f for k in own), sum(said(k, 1) for k in gone), sum(said(k, 2) for k in gone)]
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return {k: [*v, total[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def corpus():
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (5, 120, 150, 300) for _ in range(4)]
    texts += [t.upper() for t in texts[::3]] + [f"{t} #1" for t in texts[::2]] + [" ".join(["again"] * n) for n in (90, 130)] + ["", None, "A", "É" * 20, "a\x0bb\x0cc\x1cd"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""]), "s", 0) for i in range(120)]
    return [*rows, *rows[:7], (None, texts[1], "en", "s", 0), (None, texts[1], None, "s", 0)]


def labelled():
    rng = random.Random(5)
    return [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(0, 1, 1), (4, 0, 0), (None, 1, 1)]


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("audit"))
    write(spark, corpus(), DOCS, d, "documents")
    write(spark, labelled(), "doc_id long, quality int, toxic int", d, "labels")
    return d, {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in A.op11_filter_audit(spark, d).collect()}


def test_every_order_and_step_as_applied_one_by_one(got):
    assert got[1] == plain(corpus(), labelled())


def test_the_sql_gives_the_same(got):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{got[0]}/{t}.parquet/*.parquet'")
    cursor = c.execute(A.ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    pick = lambda r, *k: [r[names.index(x)] for x in k]
    assert {tuple(pick(r, "part", "filter_order", "step")): pick(r, "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley") for r in rows} == got[1]


def test_empty_tables_extra_columns_and_shares(spark, got):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(A.joint_failures(A.flagged(docs, labels))).count() == 0
    wide = spark.createDataFrame([(1, "few words", "en", "s", 0, "x", "y", 3)], DOCS + ", part string, hash string, n int")
    rows = A.audit(A.joint_failures(A.flagged(wide, labels))).collect()
    assert len(rows) == 600 and {(r.removed, r.shapley) for r in rows if r.filter_order[r.step - 1] == "A"} == {(1, 120)}
    # What all filters remove together is shared out without a rest.
    for part in {k[0] for k in got[1]}:
        own = {k[1][k[2] - 1]: v for k, v in got[1].items() if k[0] == part}
        removed = sum(v[1] for k, v in got[1].items() if k[:2] == (part, "ABCDE"))
        assert sum(v[6] for v in own.values()) == 120 * removed
