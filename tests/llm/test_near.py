import random

from pyspark.sql import functions as F

from tickloom.llm import graph, near


def corpus():
    r = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for group in range(25):
        base = [r.choice(words) for _ in range(r.randrange(40, 160))]
        for _ in range(r.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((n, " ".join(w) + r.choice(["", " ", "\n"])))
            n += 1
    shared = " ".join(r.choice(words) for _ in range(30))
    rows += [(n + k, shared + " " + " ".join(r.choice(words) for _ in range(30))) for k in range(20)]
    rows += [(500, "a b c"), (501, "a b  c "), (502, "a b d"), (503, ""), (504, None), (505, " \n"), (506, "same id one two three four"), (506, "other text for this id here"), (None, "no id"), (None, "no id")]
    return rows


def brute(rows):
    """Components over rows by all pairs."""
    grams = [near.ngrams(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if near.alike(grams[a], grams[b]) or (rows[a][1] or "").split() == (rows[b][1] or "").split():
                parent[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k])
    return sorted(sorted(((i is not None, i or 0), t or "") for i, t in g) for g in groups.values())


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("clash"), "bands": F.lit(1)})
    got = near.near_duplicates(df).collect()
    assert len(got) == len(rows)
    keyed = {(r.doc_id, r.tk): r.class_id for r in df.select("doc_id", near.text_key(F.col("text")).alias("tk"), F.lit(0).alias("class_id")).collect()}
    assert set(keyed) == {(r.doc_id, r.tk) for r in got}
    tk = {r.text: r.tk for r in df.select(F.coalesce("text", F.lit("")).alias("text"), near.text_key(F.col("text")).alias("tk")).distinct().collect()}
    by = {(r.doc_id, r.tk): r.class_id for r in got}
    want = brute(rows)
    for group in want:
        classes = {by[(i[1] if i[0] else None, tk[t])] for i, t in group}
        assert len(classes) == 1
    assert len({by[(g[0][0][1] if g[0][0][0] else None, tk[g[0][1]])] for g in want}) == len(want) - 1  # 506 names two classes
    kept = near.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == len(want)
    assert near.near_duplicates(df.limit(0)).collect() == []


def test_large_buckets_and_blocks(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [r.choice(words) for _ in range(120)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(near, "LARGE", 3)
    monkeypatch.setattr(near, "BLOCK", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for x in near.near_duplicates(df).collect():
        got.setdefault(x.class_id, []).append(x.doc_id)
    want = [[k[0][1] for k in g] for g in brute(rows)]
    assert len(want) > 3 and sorted(sorted(v) for v in got.values()) == sorted(map(sorted, want))


def test_links_equal_brute_force(spark, monkeypatch):
    r = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for n in (12, 50, 3):
        base = [r.choice(words) for _ in range(150)]
        for _ in range(n):
            w = list(base)
            for _ in range(r.randrange(1, 5)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [(900, "a b c"), (901, "a  b c"), (902, rows[0][1] + " "), (903, None)]
    texts = {" ".join((t or "").split()) for _, t in rows}
    grams = {t: near.ngrams(t) for t in texts}
    want = {i: sum(near.alike(grams[" ".join((t or "").split())], grams[o]) for o in texts if o != " ".join((t or "").split())) for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.n_links for x in near.near_duplicates(df).collect()} == want and max(want.values()) > 11
    monkeypatch.setattr(near, "LARGE", 3)
    monkeypatch.setattr(near, "BLOCK", 7)
    assert {x.doc_id: x.n_links for x in near.near_duplicates(df).collect()} == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (200, 100), (7, 7)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in (100, 101, 102, 200)}}


def test_least_matches_follow_the_posterior():
    bounds = near.least_matches()
    assert bounds == sorted(bounds) and 0 < bounds[-1] < near.COMPARED * 0.8


def test_long_texts(spark):
    r = random.Random(11)
    base = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    other = list(base)
    for k in range(0, 60_000, 60):  # 55 of 60 windows stay: 55 / 65 is over 0.8
        other[k] = "new"
    far = list(base)
    for k in range(0, 60_000, 15):
        far[k] = "new"
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(far)), (4, "  ".join(base))]
    want = {i: sum(near.alike(near.ngrams(t), near.ngrams(o)) for o in {" ".join(x.split()) for _, x in rows} if o != " ".join(t.split())) for i, t in rows}
    got = {x.doc_id: (x.class_id, x.n_links) for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: n for i, (_, n) in got.items()} == want and want[1] == 1 and got[4][0] == 1 and got[3][0] == 3
