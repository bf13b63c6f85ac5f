import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tickloom.llm import byte_bpe, token_shards

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=300):
    r = random.Random(5)
    alphabet = "aaabcdefgh 's'll 12\n\té 　中\U0001f600\x1c\x85́THE"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)] + ["", "<|endoftext|>", "aaaa" * 50, " x y"]


def test_ids_equal_the_rank_library_and_decode_back():
    c, t = byte_bpe.codec(RANKS, P.PATTERN), reference()
    for text in odd_texts():
        ids = c.encode(text)
        assert ids == t.encode_ordinary(text), repr(text)
        assert c.decode(ids) == text
        assert c.encode_digits(text)[1] == ",".join(map(str, ids))


def test_offsets_and_split_characters():
    c = byte_bpe.codec(RANKS, P.PATTERN)
    text = "ab \U0001f9ff c"
    ids = c.encode(text)
    spans = c.offsets(ids)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    split = [s for s, i in zip(spans, ids) if b"\x9f" in c.to_bytes[i] or len(c.to_bytes[i].decode("utf-8", "ignore")) == 0]
    assert all(s[0] <= 3 for s in split)
    assert c.decode(ids[:1]) and "�" in c.decode([c.encode("é中\U0001f9ff")[-1]])


def test_round_trip_over_odd_rows(spark, docs):
    out = byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    assert len(out) == docs.count()
    t = reference()
    want = sorted((str(r.doc_id), len(t.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in out) == want
    assert byte_bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).collect() == []
    enc = byte_bpe.encode_documents(docs, RANKS, P.PATTERN)
    assert sorted(r.text for r in byte_bpe.decode_documents(enc, RANKS, P.PATTERN).collect()) == sorted(r.text or "" for r in docs.collect())


@pytest.mark.parametrize("vocab", [50, 49408, 70000])
def test_repair_blocks_expand_to_the_same_ids(vocab):
    r = np.random.default_rng(3)
    docs = [r.zipf(1.5, r.integers(0, 400)) % vocab for _ in range(80)] + [np.full(1000, 7), np.zeros(0, int), np.arange(vocab), np.tile(np.arange(40), 90)]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    packed = token_shards.pack(np.concatenate(docs).astype(np.uint32), starts)
    b = token_shards.Block(packed)
    ids, at = b.documents()
    assert (ids == np.concatenate(docs)).all() and (at == starts).all()
    for k, d in enumerate(docs):
        assert (b.document(k) == d).all()
    assert len(b.rules) > 0 and len(b.symbols) < len(ids)
    # the grammar is at its end: what is still frequent has too few occurrences that do not overlap
    inner = np.setdiff1d(np.arange(len(b.symbols) - 1), b.starts[1:] - 1)
    pairs, n = np.unique(np.stack([b.symbols[inner], b.symbols[inner + 1]], 1), axis=0, return_counts=True)
    assert n.max() < token_shards.LEAST
    assert b.symbols.itemsize == (4 if vocab == 70000 else 2)


def test_a_grammar_that_outgrows_two_bytes():
    # 60,000 ids and more frequent pairs than two bytes can name besides
    pairs = np.random.default_rng(1).permutation(60000).reshape(-1, 2)
    docs = [pairs[np.random.default_rng(k).permutation(30000)].ravel() for k in range(14)]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    b = token_shards.Block(token_shards.pack(np.concatenate(docs).astype(np.uint32), starts))
    assert b.symbols.itemsize == 4 and len(b.rules) >= 30000
    assert (b.documents()[0] == np.concatenate(docs)).all() and (b.document(3) == docs[3]).all()


def test_documents_are_read_from_the_files_one_by_one(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    r = random.Random(2)
    rows = [(k % 70, " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randrange(300)))) for k in range(80)] + [(None, "no key"), (100, None), (101, "one two " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    token_shards.write_shards(df, f"{tmp_path}/shards", path, 2)
    shards = spark.read.parquet(f"{tmp_path}/shards")
    got = token_shards.read_documents(shards, spark.createDataFrame([(3,), (3,), (69,), (100,), (101,), (999,)], "doc_id long")).collect()
    e = token_shards.word_encoder(path)
    want = [(i, e.model.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows if i in (3, 69, 100, 101)]
    assert sorted((r.doc_id, r.ids) for r in got) == sorted(want)
    assert token_shards.read_documents(shards, df.limit(0)).collect() == []


def test_words_encode_as_the_whole_text_does():
    e = token_shards.word_encoder(P.path("word_bpe_49k.json"))
    letters = [f"{chr(k)} a{chr(k)}b, {chr(k).upper()}{chr(k)}.x {chr(k)}\u0301" for k in range(0x21, 0x260)] + ["\u0130stanbul STRASSE \u1e9e \u03a3\u03a3 \u023a"]
    for text in odd_texts() + letters:
        assert e.encode([text])[0].tolist() == e.model.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_file_digest_over_odd_rows(spark, docs):
    path = P.path("word_bpe_49k.json")
    e = token_shards.word_encoder(path)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, at = [], 0
    for r in rows:
        ids = e.model.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_shards.token_file_digest(docs, path).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    assert token_shards.token_file_digest(docs.limit(0), path).collect() == []


def test_only_distinct_runs_of_a_batch_become_objects():
    import pyarrow as pa

    e = token_shards.WordEncoder(P.path("word_bpe_49k.json"))
    spaces = [chr(k) for k in range(0x3001) if chr(k).isspace()]
    texts = ["The cat's, the dog!? It's 12.5% o'er." * 3, *[f"a{s}b,{s}{s}c." for s in spaces], "a..b ,c !'s?! x's' 9. é., İ., 中.,", *odd_texts()]
    assert [x.tolist() for x in e.encode(pa.array(texts))] == [e.model.encode(t, add_special_tokens=False).ids for t in texts]
    learned = []
    e.learn = lambda words: learned.extend(words) or token_shards.WordEncoder.learn(e, words)
    got = e.encode(pa.array(["newword other, newword"] * 500 + [""]))
    assert len(learned) == len(set(learned)) <= 3 and len({x.tobytes() for x in got[:-1]}) == 1 and len(got[-1]) == 0
    assert e.encode(pa.array([], pa.string())) == []


def test_slices_by_bytes_keep_all_rows_and_mend_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_shards, "TEXT_AT_ONCE", 10)
    texts = ["x" * n for n in (0, 3, 9, 40, 0, 1, 10, 11)] + [None] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    cut = list(token_shards.by_bytes(iter([batch, batch.slice(0, 0)])))
    assert [t for b in cut for t in b.column(1).to_pylist()] == texts and len(cut) > 5
    assert all(sum(len(t or "") for t in b.column(1).to_pylist()[:-1]) <= 10 for b in cut)
    # neither a broken sequence nor an overlong blank splits or loses a word
    bad = pa.array([b"ab\xc0\xa0cd \xff", None, "é".encode()]).cast(pa.binary())
    column = pa.Array.from_buffers(pa.string(), 3, bad.buffers(), 1)
    assert token_shards.whole_texts(column).to_pylist() == ["ab��cd �", "", "é"]
