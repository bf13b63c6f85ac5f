import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import suffix


def brute(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), by a table of first owners of every string."""
    first = {}
    for did, text in rows:
        b = (text or "").encode()
        d = did if did is not None else -(1 << 63)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for did, text in rows:
        b = (text or "").encode()
        d = did if did is not None else -(1 << 63)
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < d:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((did, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(4)
    words = ["the", "of", "and", "é", "中文", "house", "tree", "a", "to", "in", "water", "b\x00c", "\n"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [text(30) for _ in range(6)] + ["License, version 2.0 of this very common line that many documents share."]
    rows = []
    for k in range(120):
        t = text(r.randrange(0, 60)) + r.choice(shared) + text(r.randrange(0, 60)) + r.choice(shared + [""])
        cut = r.randrange(0, 12)
        rows.append((r.randrange(0, 90), t[cut:]))
    rows += [(5, "x" * 400), (6, "x" * 49), (7, "x" * 50), (8, "ab" * 300), (9, "ab" * 300), (9, "ab" * 300), (3, None), (4, ""), (None, shared[0]), (None, shared[0])]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rid": F.lit("clash"), "bucket": F.lit(1), "did": F.lit("x")}).repartition(3)
    want = brute(rows)
    assert sum(w[2] for w in want) > 1000
    for shard_bytes in (suffix.SHARD_BYTES, 700, 150):  # of 150 bytes: the same 16 bytes in more contexts than fit, by all hashes
        got = sorted((tuple(r) for r in suffix.without_repeats(df, shard_bytes).collect()), key=str)
        assert got == want
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tickloom_texts")]
    assert suffix.without_repeats(df.limit(0)).collect() == []


def test_suffix_order():
    t = np.frombuffer(("banana" * 40 + "abracadabra" * 20).encode(), np.uint8)
    order, keys = suffix.suffix_array(t)
    b = t.tobytes()
    heads = [b[k : k + 50] for k in order]
    assert heads == sorted(heads) and sorted(order) == list(range(len(b)))


def test_common_prefixes():
    r = random.Random(7)
    parts = [bytes(r.choice(b"ab") for _ in range(r.choice([50, 51, 60, 84]))) for _ in range(60)] + [b"x" * 84, b"x" * 70, b"ab" * 42, b"ab" * 42]
    for _ in range(40):
        parts.append(r.choice(parts)[r.randrange(20) :].ljust(50, b"c"))
    t, lengths = np.frombuffer(b"".join(parts), np.uint8), [len(x) for x in parts]
    offsets = np.concatenate([np.arange(n) for n in lengths])
    room = np.concatenate([n - np.arange(n) for n in lengths])
    order, keys = suffix.suffix_array(t)
    order = order[room[order] >= 50]
    b = t.tobytes()

    def shared(x, y):
        return next((k for k in range(50) if b[x + k] != b[y + k]), 50)

    assert suffix.common_prefixes(order, keys, offsets).tolist() == [0] + [shared(x, y) for x, y in zip(order, order[1:])]


def test_long_texts(spark):
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long), (2, "start " + long[100_000:200_000] + " end"), (3, "y" * 200_000), (4, "z" + "y" * 100_000)]
    got = sorted(tuple(x) for x in suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_equal_windows_name_equal_anchors():
    r = random.Random(1)
    common = bytes(r.randrange(97, 104) for _ in range(90))
    for _ in range(20):
        left = bytes(r.randrange(97, 104) for _ in range(r.randrange(200)))
        b = np.frombuffer(left + common, np.uint8)
        at, own, h = suffix.anchors(b)
        alone, _, _ = suffix.anchors(np.frombuffer(common, np.uint8))
        assert (at[len(left) :] - len(left) == alone).all() and set(at) == set(own)
