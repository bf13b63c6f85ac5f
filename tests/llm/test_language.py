"""Hyperdimensional language profiles: against a direct computation, held-out accuracy, odd rows."""

import os
import zlib

import numpy as np
import pytest

from tickloom.llm import language as L
from tickloom.llm import queries

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def direct(text: str, width: int) -> np.ndarray:
    """One trigram at a time, as the method says."""
    import unicodedata

    letters = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text]
    letters = [x if unicodedata.category(c)[0] in "LM" else 0 for x, c in zip(letters, text, strict=True)]
    padded, out = [0, *letters, 0], np.zeros(width)
    vector = lambda x: L.letter_vectors(np.array([x]), width)[0].astype(float)
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        if b:
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


@pytest.mark.parametrize("cells,size", [(1 << 23, 1 << 20), (64, 7), (1, 1)])
def test_bundles_equal_the_direct_sum(monkeypatch, cells, size):
    texts = ["Les élèves, là.", "x", "", "ein Übergang 中文 é!", "İ ß " * 5, "...", "a\U0001f600b"]
    monkeypatch.setattr(L, "CELLS", cells)
    monkeypatch.setattr(L, "HELD", 3)
    monkeypatch.setattr(L, "pieces", lambda t, f=L.pieces: f(t, size))
    got = {i: (v, letter) for i, v, letter in L.text_vectors(texts, 128)}
    assert set(got) == {i for i, t in enumerate(texts) if t}
    for i, (v, letter) in got.items():
        assert np.array_equal(v, direct(texts[i], 128))
        assert letter == any(c.isalpha() for c in texts[i])


def test_letter_vectors_are_nearly_orthogonal():
    v = L.letter_vectors(np.arange(200)).astype(float)
    cosines = v @ v.T / L.WIDTH - np.eye(200)
    assert np.abs(cosines).max() < 0.15


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    held = docs.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 4 == 2)
    vectors = np.zeros((len(docs), L.WIDTH))
    for i, v, _ in L.text_vectors([t or "" for t in docs.text]):
        vectors[i] = v
    names = sorted(docs.lang[~held].dropna().unique())
    prototypes = np.stack([vectors[(~held & (docs.lang == n)).to_numpy()].sum(axis=0) for n in names])
    cosines = vectors @ prototypes.T / np.linalg.norm(prototypes, axis=1) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
    rows = {r.doc_id: r for r in queries.op11_hyperdimensional_language(spark, SF).collect()}
    assert len(rows) == len(docs)
    for k, h, c, t in zip(docs.doc_id, held, cosines, docs.text, strict=True):
        r = rows[k]
        assert r.held_out == h
        if t and any(ch.isalpha() for ch in t):
            assert r.lang_pred == names[int(np.round(c, 6).argmax())] and abs(r.score - max(c.max(), 0)) < 1e-5
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


@pytest.mark.skipif(not os.path.isdir(SF2), reason="needs the given tables")
def test_held_out_accuracy(spark):
    got = queries.op11_hyperdimensional_language(spark, SF2).filter("held_out").join(spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.995


def test_odd_rows(spark, docs):
    rows = L.language_id(docs).collect()
    assert len(rows) == docs.count()
    by = {(r.doc_id, r.lang_pred, r.held_out) for r in rows}
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (2, 3, 5))
    assert not next(r for r in rows if r.doc_id is None).held_out
    assert all(0 <= r.score <= 1 for r in rows) and all(r.lang_pred != "de" for r in rows), by  # the only German row has no id
    assert L.language_id(docs.limit(0)).collect() == []
    nothing = L.language_id(docs.selectExpr("doc_id", "text", "CAST(NULL AS string) lang")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_held_out_rows_teach_nothing(spark):
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 4 == 2)
    other = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2)
    rows = spark.createDataFrame([(key, "zzz yyy", "xx", "a"), (other, "the end", "en", "a")], "doc_id long, text string, lang string, source string")
    assert {r.lang_pred for r in L.language_id(rows).collect()} == {"en"}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 2)
    rows = spark.createDataFrame([("aa", "x"), ("bb", "y"), ("cc", "z")], "text string, lang string")
    with pytest.raises(ValueError):
        L.learned(rows, 64)
