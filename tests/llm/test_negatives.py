"""Kronecker-packed products: exact at any size; hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import negatives as N


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 5), st.integers(0, 7), st.integers(1, 5), st.sampled_from([1, 3, 200, 4000, 2**20, 2**23]), st.integers(0, 10**6))
def test_products_are_exact(n, m, width, size, seed):
    rng = np.random.default_rng(seed)
    a, c = rng.integers(-size, size + 1, (n, width)), rng.integers(-size, size + 1, (m, width))
    assert np.array_equal(N.packed_products(a, c), a @ c.T)


def test_products_of_any_size():
    a = np.array([[10**30, -3], [0, 0]], object)
    c = np.array([[7, -(10**25)], [-(10**30), 1], [10**5, 5]], object)
    got = N.packed_products(a, c)
    assert got[0].tolist() == [2**63 - 1, -(2**63), 2**63 - 1] and got[1].tolist() == [0, 0, 0]
    big = np.array([[2**31 + 7, -(2**29)]], object)
    assert N.packed_products(big, big)[0, 0] == (2**31 + 7) ** 2 + 2**58


def brute(rows, anchor=lambda k: k % 10 == 0, most=5, percent=80):
    best = {}
    for k, v, label in rows:
        if k is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            best[k] = min(best.get(k, (label, q)), (label, q))
    out = set()
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))
    for a in filter(anchor, best):
        scores = sorted((-dot(best[a][1], q), k) for k, (_, q) in best.items() if k != a)
        own = [(k, -s) for s, k in scores if best[k][0] == best[a][0]][:most]
        for p, ps in own:
            band = [(k, -s) for s, k in scores if best[k][0] != best[a][0] and percent * ps <= -100 * s <= 100 * ps][:most]
            out |= {(a, p, i + 1, k, ps, s) for i, (k, s) in enumerate(band)}
    return out


def made(seed, n, width, labels, spread):
    rng = random.Random(seed)
    hot = [rng.uniform(-1, 1) for _ in range(width)]
    return [(k, hot if rng.random() < 0.3 else [h + rng.uniform(-spread, spread) for h in hot], rng.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("block,group,together", [(4096, 256, 256), (7, 2, 3)])
def test_equals_all_pairs(spark, monkeypatch, block, group, together):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "GROUP", group)
    monkeypatch.setattr(N, "TOGETHER", together)
    rows = made(3, 90, 6, 3, 0.4)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in N.hard_negatives(frame, F.col("vec_id") % 10 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_odd_rows(spark):
    rows = made(5, 40, 4, 2, 0.5)
    rows += [
        (50, None, 1), (60, [0.1, None, 0.2, 0.3], 1), (70, [float("nan")] * 4, 0), (80, [float("inf"), 0.0, 0.0, 0.0], 0), (90, [0.5] * 4, None), (None, [0.5] * 4, 1),
        (100, [], 1), (110, [1e30, -1e30, 0.0, 1.0], 0), (120, [0.1, 0.2], 1), (10, rows[10][1], 1), (10, rows[10][1], 0), (20, [9.0] * 4, 1), rows[3], rows[3],
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, score string")
    cut = lambda x: max(min(x, 2**63 - 1), -(2**63))
    got = {tuple(r) for r in N.hard_negatives(frame, F.col("vec_id") % 10 == 0).collect()}
    assert got >= {r for r in brute(rows) if max(abs(r[4]), abs(r[5])) < 2**63 and r[0] != 110 and 110 not in (r[1], r[3])} - {r for r in brute(rows) if r[0] == 110}
    assert all(cut(r[4]) == r[4] for r in got) and N.hard_negatives(frame.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert N.hard_negatives(frame.filter("vec_id % 10 > 0"), F.col("vec_id") % 10 == 0).collect() == []


def test_label_expression(spark):
    rows = made(9, 60, 3, 4, 0.3)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    moved = [(k, np.array(v, np.float32).astype(float).tolist(), (label + 1) % 10 if k % 7 == 0 else label) for k, v, label in rows]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert {tuple(r) for r in N.hard_negatives(frame, F.col("vec_id") % 10 == 0, label=label).collect()} == brute(moved)
