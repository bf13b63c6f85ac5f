"""The frequency-vector trie: against all pairs, with cut and uncut tries."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import queries
from tickloom.llm import spelling as S

SF = "/root/testdata/sf0.001"


def one_edit(u: str, v: str) -> bool:
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(words: dict[str, int], ratio: int = 5) -> set[tuple]:
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        if best and words[best] >= ratio * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def counts(rows, dropped_of=None, least=6, count=5) -> dict[str, int]:
    out = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if dropped_of and h % dropped_of == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= count}


letters = st.text("aebpfé", min_size=0, max_size=6)


@settings(max_examples=60, deadline=None)
@given(st.lists(letters, min_size=1, max_size=40, unique=True), st.lists(letters, min_size=1, max_size=10, unique=True))
def test_trie_finds_all_pairs(words, searches):
    vector = lambda w: [len(w)] + [sum(w.count(c) for c in g) for g in S.GROUPS]
    sub = S.Subtrie(words, np.arange(1, len(words) + 1))
    trie = S.Trie(np.array([vector(w) for w in words]))
    sub.at = trie.order
    n_near, best = sub.near(trie, searches, np.array([vector(w) for w in searches]))
    for w, n, b in zip(searches, n_near, best, strict=True):
        near = [o for o in words if one_edit(w, o)]
        assert n == len(near)
        assert (words[b] if b >= 0 else None) == max(near, key=words.index, default=None)


@pytest.mark.parametrize("most", [20_000, 60, 3])
def test_cut_tries_equal_brute_force(spark, most):
    rng = random.Random(7)
    base = ["".join(rng.choice("aeinrsté×") for _ in range(rng.randint(5, 9))) for _ in range(120)]
    rows = []
    for w in base:
        n = rng.choice([1, 2, 5, 30, 200])
        rows += [w] * n
        for _ in range(4):
            i = rng.randrange(len(w))
            rows += [rng.choice([w[:i] + w[i + 1 :], w[:i] + "k" + w[i:], w[:i] + "z" + w[i + 1 :]])] * rng.choice([1, 5, 6])
    anagrams = ["".join(rng.sample("aabbee", 6)) for _ in range(60)]  # one leaf, more than it may hold
    rows += anagrams * 6
    docs = [(k, " ".join(rows[k::50])) for k in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in S.spelling_variants(frame, dropped_of=199, most=most).collect()}
    assert got == brute(counts(docs, 199))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.op12_spelling_trie(spark, SF).collect()} == brute(counts(rows, 199))


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{k}", 5 * 5**k, f"w{k + 1}" if k < 11 else None) for k in range(12)], "word string, n long, form string")
    assert {r.root for r in S.with_roots(chain, 5).collect()} == {"w11"}


def test_odd_rows(spark, docs):
    assert {tuple(r) for r in S.spelling_variants(docs, dropped_of=199, count=1).collect()} == brute(counts([(r.doc_id, r.text) for r in docs.collect()], 199, count=1))
    assert S.spelling_variants(docs.limit(0)).collect() == []
    assert S.spelling_variants(docs.filter("text IS NULL")).collect() == []


def test_flushes_do_not_change_counts(spark, docs, monkeypatch):
    want = {tuple(r) for r in S.counted_words(docs, 1, 3).collect()}
    monkeypatch.setattr(S, "HELD", 0)
    assert {tuple(r) for r in S.counted_words(docs, 1, 3).collect()} == want
