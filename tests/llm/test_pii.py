import hashlib
import random
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tickloom.llm import pii

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    n = lambda m: len(re.findall("[0-9]", m[0]))
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)] if "@" in t else []
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(t) if 12 <= n(m) <= 19 and pii.luhn("".join(re.findall("[0-9]", m[0])))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 9 <= n(m) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))


def test_rules_equal_the_plain_patterns():
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("ab1234 0.@+-()%é\n:") for _ in range(r.randrange(70)))
        assert pii.rule_spans(t) == brute(t), repr(t)
    for t in ("a@b.c@d.e@f.g", "x@@y.z", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (212) 555-0100 +4", "256.1.1.1 000255.0.0.1"):
        assert pii.rule_spans(t) == brute(t)


def test_field_adds_disguised_data_and_leaves_plain_numbers():
    crf = pii.train_field(["Mail a.b12@mail3.example.com or call +1 (974) 555-3436 now", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" of', "License, version 3. It 2353820953013749 is"])
    find = lambda t: [t[a:b] for a, b, _ in pii.all_spans(t, crf)[1]]
    assert find("please write to sam.roe [at] mail5 [dot] example [dot] net today") == ["sam.roe [at] mail5 [dot] example [dot] net"]
    assert find("the host 10[.]20[.]30[.]40 answers") == ["10[.]20[.]30[.]40"]
    assert find("ring (646) 555-0199 at noon") == ["(646) 555-0199"]
    for t in ("On 2023-11-30 at 14:05 version 2.1.0 cost $1,299.00", "License, version 3.", 'token = "8ef5f278dec875d2b96fdf291615913d21aee5ca" x', "The 9807915762804491 units", ""):
        assert find(t) == [], t


def test_marginals_sum_over_segmentations():
    crf = pii.SemiCRF({("email", "a"): 0.7, ("ip", "a"): -0.2, ("card", "b"): 1.1}, {("", "email"): 0.3, ("email", ""): -0.4})
    segments = [(0, 1, ["a"]), (0, 2, ["b"]), (1, 3, ["a", "b"]), (2, 3, ["a"])]
    scored = crf.scored(segments)
    import math

    paths = []

    def walk(k, last, score, used):
        if k == 3:
            paths.append((score, used))
            return
        walk(k + 1, "", score + crf.moves.get((last, ""), 0.0), used)
        for i, j, y, s in scored:
            if i == k:
                walk(j, y, score + s + crf.moves.get((last, y), 0.0), [*used, (i, j, y)])

    walk(0, "", 0.0, [])
    z = sum(math.exp(s) for s, _ in paths)
    got, _ = crf.marginals(3, scored)
    for seg, p in got.items():
        assert abs(p - sum(math.exp(s) for s, used in paths if seg in used) / z) < 1e-9
    assert crf.decode(3, scored) == max(paths, key=lambda x: x[0])[1]


def test_queries_over_odd_rows(spark, docs):
    got = pii.find_pii(docs.withColumn("spans", F.lit("clash"))).collect()
    want = sorted((str(r.doc_id), hashlib.sha256(pii.listed(brute(r.text or "")).encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    row = next(r for r in got if r.doc_id == 4)
    assert (row.n_email, row.n_phone) == (1, 1) and "email:" in row.spans and "phone:" in row.spans
    assert pii.find_pii(docs.limit(0)).collect() == []
    red = pii.redact_pii(docs).collect()
    assert len(red) == docs.count() and red[0].__fields__ == docs.columns
    text = next(r for r in red if r.doc_id == 4)
    assert text.text.endswith("Mail me: [EMAIL], [PHONE].") and text.n_chars == len(text.text)


def all_at_once(text, crf, taken, least=0.5):
    """The field's spans by whole lists of segments with their features."""
    out = []
    for a, b in pii.windows(text):
        tokens, segments = pii.candidates(text, a, b)
        scored = crf.scored(segments)
        best = crf.decode(len(tokens), scored)
        sure, _ = crf.marginals(len(tokens), scored)
        for i, j, y in best:
            start, end = tokens[i].start(), tokens[j - 1].end()
            if all(end <= s or e <= start for s, e, _ in taken) and sure.get((i, j, y), 0.0) >= least:
                out.append((start, end, y))
    return out


def test_flat_windows_equal_lists_of_features():
    crf = pii.train_field(["Mail a.b12@mail3.example.com or call +1 (974) 555-3436 now", "It 2353820953013749 is", "ring 646-555-0199"])
    r, found = random.Random(5), 0
    parts = ["12", "4111 1111", " ", "a", "é", "²", "٣", ".", "@", "(at)", " [at] ", " at ", "+", "-", "\n", "  ", "tel ", "_", "IP: ", "255.1.2.3", "[.]", "x", "mail5", " [dot] ", "(646) 555-0199", "a_longer_word"]
    for _ in range(1200):
        text = "".join(r.choice(parts) for _ in range(r.randrange(50)))
        base = pii.rule_spans(text)
        want = all_at_once(text, crf, base)
        assert pii.field_spans(text, crf, base) == want, repr(text)
        found += len(want)
    assert found > 30


@pytest.mark.parametrize("kind", ["numbers", "addresses"])
def test_very_long_texts_with_triggers(kind):
    """One window as long as the text: memory and time in proportion to it."""
    crf = pii.train_field(["Mail a.b12@mail3.example.com or call +1 (974) 555-3436 now"])
    r = random.Random(1)
    text = " ".join(str(r.randrange(10 ** r.randrange(1, 9))) for _ in range(20_000)) if kind == "numbers" else " ".join(f"user{k}@host{k % 97}.example.org" for k in range(4_000))
    began = time.perf_counter()
    base, spans = pii.all_spans(text, crf)
    assert set(base) <= set(spans) and time.perf_counter() - began < 30
    tracemalloc.start()
    pii.Window(text[:10_000], 0, 10_000, pii.Scores(crf))
    assert tracemalloc.get_traced_memory()[1] < 10 << 20
    tracemalloc.stop()


def test_long_texts_in_query_and_stage(spark):
    text = "12 345 6789 " * 2500 + "a@b.example.org"
    df = spark.createDataFrame([(1, text), (2, "x@y.example.org " * 2000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert (got[1].n_email, got[2].n_email) == (1, 2000)
    red = {r.doc_id: r.text for r in pii.redact_pii(df).collect()}
    assert red[1].endswith("[EMAIL]") and red[2] == "[EMAIL] " * 2000
