"""Tokens, directly addressable codes and packing: exact round trips against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.helpers import DOCS, docs, prose, write
from tokenizers import Tokenizer

from talweg.llm import dac, op4_packing, op7_token_codes, tokens

ODD = ["don't stop... it's,ok", "A.B.C,,.. d", "İstanbul x", "<|endoftext|> a<|startoftext|>b|c", "", None, "  ", "café ́x", "a　b\x1cc!\x1c!", "Σας ΣΑΣ.", "x\r\ny,z", " . , .", "½¾ ñ,", "ab's'll 12345 a1b2", "\n\n\t", "😀,a😀b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return ODD + [prose(rng, rng.choice([1, 5, 40, 300])) for _ in range(60)] + [prose(rng, 9000), "x " * 5000]


def test_encoder_gives_the_library_s_ids(library, corpus):
    encoder = tokens.Encoder(tokens.tokenizer_path())
    for _ in range(2):  # the second time from the cache
        ids, lengths = encoder.encode(pa.array(corpus))
        want = [ids_of(library, t) for t in corpus]
        assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert encoder.encode(pa.array([], pa.string()))[0].tolist() == []
    assert encoder.encode(pa.array([None, "a"]), end_id=None)[1].tolist() == [0, 1]


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 3000])
def test_dac_random_access(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.3, rng.integers(0, 2**32, n), np.where(rng.random(n) < 0.5, rng.integers(0, 60000, n), rng.integers(0, 256, n))).astype(np.uint32)
    reader = dac.Reader(dac.encode(ids))
    assert len(reader) == n and [reader[i] for i in range(n)] == ids.tolist()
    for _ in range(30):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (reader.slice(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        reader[n]
    with pytest.raises(ValueError):
        dac.Reader(b"none of ours")


def test_op7_round_trip(spark, tmp_path, library, corpus, monkeypatch):
    monkeypatch.setattr(op7_token_codes, "SEGMENT_IDS", 500)
    path = write(spark, docs(corpus), DOCS, tmp_path, "documents")
    got = sorted(map(tuple, op7_token_codes.op7_token_codes(spark, path).collect()))
    start, want = 0, []
    for i, t in enumerate(corpus):
        ids = ids_of(library, t)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_op7_nulls_repeats_and_an_empty_table(spark, tmp_path):
    rows = [(5, "b"), (5, "a"), (None, "first"), (1, None)]
    out = str(tmp_path / "codes")
    op7_token_codes.write(spark.createDataFrame(rows, "doc_id long, text string"), out)
    got = op7_token_codes.read_documents(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 5, 5] and got[0].start == 0 and got[-1].start == sum(r.n_tokens for r in got[:-1])
    empty = str(tmp_path / "empty")
    op7_token_codes.write(spark.createDataFrame([], "doc_id long, text string"), empty)
    assert op7_token_codes.read_documents(spark, empty).count() == 0


def check_packing(rows, texts, library, limit=4096):
    at = {i: 0 for i in range(len(texts))}
    ids = [np.array(ids_of(library, t), "<u4") for t in texts]
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and r.length == len(piece) > 0 and r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(piece.tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
    assert all(at[i] == len(x) for i, x in enumerate(ids))
    full = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values(), default=0) <= limit
    return sum(op4_packing.padded(n, limit) for n in full.values())


def test_op4_packs_every_id_once_without_padding(spark, tmp_path, library, corpus):
    path = write(spark, docs(corpus), DOCS, tmp_path, "documents")
    assert check_packing(op4_packing.op4_packing(spark, path).collect(), corpus, library) == 0


def test_op4_many_tiny_documents_close_sequences_by_segments(spark, library, monkeypatch):
    texts = ["a"] * 700 + [None]
    monkeypatch.setattr(op4_packing, "BUFFER", 50)
    rows = op4_packing.pack_documents(spark.createDataFrame(docs(texts), DOCS).coalesce(1), segments=16).collect()
    assert check_packing(rows, texts, library) == 0
    per = {}
    for r in rows:
        per[r.sequence_id] = per.get(r.sequence_id, 0) + 1
    assert max(per.values()) <= 16
    assert op4_packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_op4_loss_and_segment_limits_bind_on_rows_with_prompts(spark, library, monkeypatch):
    monkeypatch.setattr(op4_packing, "BUFFER", 40)
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([3, 30, 120, 700])) for _ in range(120)] + ["", None]
    prompts = [rng.choice([None, -4, 0, 10, 60, 10**6]) for _ in texts]
    rows = [(i, t, p, "clash") for i, (t, p) in enumerate(zip(texts, prompts))]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt long, sequence_id string").coalesce(1)
    got = op4_packing.pack_documents(df, limit=512, segments=5, loss_limit=200, prompt_col="prompt").collect()
    check_packing(got, texts, library, 512)
    loss, segments, length = {}, {}, {}
    for r in got:
        prompt = max(0, min(r.doc_tokens, prompts[r.doc_id] or 0))
        assert r.loss_tokens == max(0, r.start + r.length - max(r.start, prompt))
        for total, n in ((loss, r.loss_tokens), (segments, 1), (length, r.length)):
            total[r.sequence_id] = total.get(r.sequence_id, 0) + n
    assert max(loss.values()) == 200 and max(segments.values()) == 5 and max(length.values()) == 512
    with pytest.raises(ValueError):
        op4_packing.pack_vectors(np.array([3]), np.array([3]), 10, 5, 0)


def test_pack_vectors_keeps_all_three_limits():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 900, 300)
    loss = (sizes * rng.random(300)).astype(int)
    for cut in (True, False):
        bins = op4_packing.pack_vectors(sizes, loss, 1000, 6, 600 if cut else 900, cut=cut)
        done = np.zeros(300, int)
        for items in bins:
            assert 0 < len(items) <= 6 and sum(b - a for _, a, b in items) <= 1000
            assert sum(b - max(a, min(b, sizes[i] - loss[i])) for i, a, b in items) <= (600 if cut else 900)
            for i, a, b in items:
                assert a == done[i]
                done[i] = b
                assert cut or (a, b) == (0, sizes[i])
        assert (done == sizes).all()
    with pytest.raises(ValueError):
        op4_packing.pack_vectors(np.array([11]), np.array([1]), 10, cut=False)
    assert op4_packing.pack_vectors(np.zeros(0, int), np.zeros(0, int)) == []
