import base64
import hashlib
import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_run_equals_brute_force(spark):
    import duckdb
    import public_tokenizers as P
    import tiktoken
    from tickloom.llm import near, pii, sql

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql.OP5}) WHERE kept").fetchall()}
    docs = [d for d in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if d[0] in good]
    grams = {i: near.ngrams(t) for i, t in docs}
    group = {i: i for i, _ in docs}
    for a, _ in docs:
        for b, _ in docs:
            if b < a and (near.alike(grams[a], grams[b])):
                ga, gb = group[a], group[b]
                for k in group:
                    if group[k] in (ga, gb):
                        group[k] = min(ga, gb)
    docs = [d for d in docs if group[d[0]] == d[0]]
    items = [t.lower().split() for (t,) in con.execute(f"SELECT text FROM read_parquet('{SF}/benchmark.parquet')").fetchall()]
    docs = [d for d in docs if not any(" ".join(i) in " ".join(d[1].lower().split()) for i in items)]
    crf = pii.sample_field(spark.createDataFrame(docs, "doc_id long, text string").filter(F.col("doc_id") >= 0))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, t in docs:
        text = pii.redacted(t, pii.all_spans(t, crf)[1])
        ids = bpe.encode_ordinary(text)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_keep_the_columns_of_documents(spark, docs):
    clashing = docs.withColumns({c: F.lit(1) for c in ("_doc", "_own", "_q", "_kept", "_lang", "_source", "_level", "cuts", "node", "tk", "_near_id", "_near_tk", "_bad_id", "_bad_tk", "h", "w")})
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, clashing):
            out = stage(spark, some, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == some.columns, name
                assert [f.dataType for f in out.schema] == [f.dataType for f in some.schema], name
            rows = out.collect()
            if name in ("personal data", "byte-level BPE", "benchmark decontamination"):
                assert len(rows) == some.count(), name
            if name == "n-gram Jaccard join":
                assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "4", "6", "7", "None"]
            assert stage(spark, some.limit(0), SF).collect() == [], name


def test_run_leaves_only_the_tables_that_are_still_read(spark):
    from tickloom.llm.common import MADE

    before = len(MADE)
    corpus_pipeline.run(spark, SF)
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in MADE[before:]]
    assert left == ["stage-0", "stage-1", "stage-2", "stage-3"]
