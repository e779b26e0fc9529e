"""The pipeline's stages on a planted corpus, each on what its predecessor kept."""

import random

from tests.llm.helpers import DOCS, edited_copy, prose, write

import corpus_pipeline
from talweg.llm import common


def planted(rng):
    rows, labels, kinds = [], [], {}

    def put(text, kind, lang="en"):
        i = len(rows)
        rows.append((i, text, lang, f"src{i % 2}", len(text or "")))
        kinds.setdefault(kind, []).append(i)
        return i

    bad = ["idiotish", "scumlike", "morontalk"]
    for _ in range(220):
        put(prose(rng, rng.choice([20, 60, 150])), "clean")
    for _ in range(60):
        w = prose(rng, 60).split()
        for _ in range(4):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        put(" ".join(w), "toxic")
    for i in kinds["clean"][:15]:
        put(rows[i][1], "copy")
        put(edited_copy(rng, rows[i][1]), "near")
    put("Write to someone@mail.example.com or +1 (377) 555-0271 soon, all of you.", "private")
    put(None, "null")
    for i in kinds["clean"] + kinds["toxic"]:
        if rng.random() < 0.8:
            labels.append((i, 1, int(i in set(kinds["toxic"]))))
    return rows, labels, kinds


def test_stages(spark, tmp_path):
    rows, labels, kinds = planted(random.Random(9))
    path = write(spark, rows, DOCS, tmp_path, "documents")
    write(spark, labels, "doc_id long, quality int, toxic int", path, "labels")
    docs, kept = common.table(spark, path, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, path), "stage")
        kept[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == common.DOCUMENT_COLUMNS
    names = [n for n, _ in corpus_pipeline.STAGES]
    first, second, third, fourth, last = (kept[n] for n in names)
    clean = set(kinds["clean"])
    # A classifier of 40 confirmed examples.
    assert len(set(kinds["toxic"]) & set(first.doc_id)) <= 0.1 * len(kinds["toxic"])
    assert len(clean - set(first.doc_id)) <= 0.05 * len(clean)
    copies_of_kept = {c for k in ("copy", "near") for c, i in zip(kinds[k], kinds["clean"]) if i in set(first.doc_id)}
    assert not copies_of_kept & set(second.doc_id) and (clean & set(first.doc_id)) <= set(second.doc_id)
    private = third[third.doc_id == kinds["private"][0]].text.iloc[0]
    assert private == "Write to [EMAIL] or [PHONE] soon, all of you."
    assert len(third) == len(second) and third[third.doc_id == kinds["null"][0]].text.isna().all()
    assert set(fourth.doc_id) == set(third.doc_id)
    pieces = last.groupby("doc_id").length.sum()
    copies = fourth.doc_id.value_counts()
    tokens = last.groupby("doc_id").doc_tokens.first()
    assert (pieces == tokens * copies.reindex(pieces.index)).all()
    assert (last.groupby("sequence_id").length.sum() <= 4096).all()


def test_run_equals_its_stages_and_empty_tables(spark, tmp_path):
    rows, labels, _ = planted(random.Random(10))
    path = write(spark, rows[:60], DOCS, tmp_path, "documents")
    write(spark, labels[:40], "doc_id long, quality int, toxic int", path, "labels")
    assert corpus_pipeline.run(spark, path).count() > 0
    empty = write(spark, [], DOCS, tmp_path / "none", "documents")
    write(spark, [], "doc_id long, quality int, toxic int", empty, "labels")
    assert corpus_pipeline.run(spark, empty).count() == 0
