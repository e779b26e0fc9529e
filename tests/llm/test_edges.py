"""Clashing extra columns, repeated rows, ties and very long texts, for the operators whose own tests have none."""

import random

import numpy as np
from tests.llm.helpers import DOCS, prose, write

import corpus_pipeline
from talweg.llm import common, op4_packing
from talweg.llm import op1_license_scan as L
from talweg.llm import op3_toxicity as T
from talweg.llm import op6_embedding_dedup as E
from talweg.llm import op7_token_codes as C
from talweg.llm import op9_mixing as M

CLASH = ["_tokens", "_p0", "_scored", "score", "predicted", "license", "start", "n_tokens", "class_id", "kept", "_name", "row_key", "text_a"]
MIT = "Licensed under the MIT License."


def clashing(spark, rows):
    """Documents with columns that the operators use themselves."""
    wide = [(*r, *["x"] * len(CLASH)) for r in rows]
    return spark.createDataFrame(wide, DOCS + "".join(f", {c} string" for c in CLASH))


def documents():
    rng = random.Random(13)
    long = prose(rng, 60_000)
    rows = [(i, prose(rng, 30), "en", "s", 1) for i in range(30)]
    rows += [(40, f"{prose(rng, 9)}\n{MIT}\n{prose(rng, 9)}", "en", "s", 1)] * 3
    rows += [(41, f"{long} {MIT}", "de", "s", 1), (42, None, None, None, None), (43, "", "en", "s", 0)]
    return rows


def test_licences(spark):
    got = L.license_scan(clashing(spark, documents())).collect()
    mit = [r.doc_id for r in got if r.license == "MIT"]
    assert sorted(mit) == [40, 40, 40, 41]
    # Passages and templates that are alike: the first of each.
    twice = L.license_scan(spark.createDataFrame([(1, f"{MIT}\n{MIT}")], "doc_id long, text string"), [("A", MIT), ("B", MIT)]).collect()
    assert [(r.license, r.score, r.first_word) for r in twice if r.score == 1.0][0] == ("A", 1.0, 0)


def test_toxicity(spark):
    df = clashing(spark, documents())
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(30)] + [(0, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.fit(df, labels)
    got = T.score(df, model, ["doc_id", "lang"]).collect()
    assert len(got) == len(documents()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 40}) == 1 and len({r.score for r in got if r.doc_id in (42, 43)}) == 1


def test_mixing_counts_repeated_rows_each(spark):
    df = clashing(spark, documents())
    domains = M.fit(df, M.labelled_domains(df, spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(41, 1, 0)], "doc_id long, quality int, toxic int")))
    members = common.written(M.memberships(df, domains, ["doc_id"]), "members")
    got = members.withColumn("rate", M.rate(M.fit_rates(members, domains), 0.0)).toPandas()
    assert len(got) == len(documents()) and (got.rate >= 0).all()
    assert np.ptp(got[got.doc_id == 40].to_numpy(), axis=0).max() < 1e-9 and got[got.doc_id == 41]._tokens.iloc[0] > 60_000 and (got[got.doc_id.isin([42, 43])]._tokens == 0).all()


def test_codes_and_packing(spark, tmp_path):
    df = clashing(spark, documents())
    C.write(df, str(tmp_path / "codes"))
    got = C.read_documents(spark, str(tmp_path / "codes")).toPandas()
    assert len(got) == len(documents()) and got[got.doc_id == 40].ids_crc32.nunique() == 1
    pieces = op4_packing.pack_documents(df).toPandas()
    assert pieces.length.sum() == got.n_tokens.sum() and (pieces[pieces.doc_id == 40].groupby("doc_id").length.sum() == got[got.doc_id == 40].n_tokens.sum()).all()


def test_pivots_that_tie(spark):
    # Vectors as near to one pivot as to another: the first pivot counts, on every run.
    v = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 1.0, 1.0], [-1.0, -1.0, -1.0]]
    rows = [(i, x) for i, x in enumerate(v * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    first, again = ({r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(d, nearest=2).collect()} for d in (df, df.repartition(3)))
    assert first == again == {i: (2, i % 5) for i in range(15)}
    assert (np.array([c for _, c in first.values()]) < 5).all()


def test_pipeline_over_clashing_repeated_and_differing_rows(spark, tmp_path):
    rows = documents() + [(5, "another text altogether under the same id as one before it", "en", "s", 1)]
    path = write(spark, rows, DOCS, tmp_path, "documents")
    write(spark, [(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int", path, "labels")
    docs = clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, path), "stage")
        assert docs.columns == common.DOCUMENT_COLUMNS, name
        if name == "minhash near-dedup":
            kept = docs.toPandas()
            assert (kept.doc_id == 5).sum() == 2 and (kept.doc_id == 40).sum() == 1 and kept.doc_id.isin([42, 43]).sum() == 1
    assert corpus_pipeline.packing(spark, docs, path).count() >= docs.count()
