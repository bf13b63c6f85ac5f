import hashlib

from pyspark.sql import functions as F

from tickloom.llm import chat


def brute(rows):
    """Digest of conversations by hand: rows are (conv_id, turn, role, text)."""
    by = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), sum(len(b) for a, b in t if a == "assistant"), sha("".join(b for a, b in t if a == "assistant"))) for c, t in by.items()}


ROWS = [
    (1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nno"),
    (1, 1, "assistant", "\\<|im_end|> \\\\<\\| é\U0001f600"),
    (2, 0, "assistant", None),
    (3, 0, None, "x"),
    (3, 0, "assistant", "tie b"),
    (3, 0, "assistant", "tie a"),
    (3, None, "assistant", "same"),
    (3, None, "assistant", "same"),
    (None, 4, "user\nassistant", "role with a line break\n"),
    (5, 0, "user", ""),
    *[(6, k, "user" if k % 2 else "assistant", f"turn {k} <") for k in range(70)],
]


def test_digest_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digest(df).collect()}
    assert got == brute(ROWS)
    assert chat.conversation_digest(df.limit(0)).collect() == []
    assert {r.conv_id for r in chat.conversation_digest(chat.with_control_strings(df.limit(0))).collect()} == {-1}


def test_best_branch_and_cycles(spark):
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 3, 0.0), ("t", 5, 3, 0.5), ("t", 8, 99, 0.1), ("c", 1, 2, 1.0), ("c", 2, 1, 1.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    paths = lambda n: sorted((r.tree, r.leaf, r.depth, r.node) for r in chat.chosen_paths(df, n).collect())
    assert paths(1) == [("t", 5, 0, 1), ("t", 5, 1, 3), ("t", 5, 2, 5)]
    assert {p[1] for p in paths(9)} == {2, 4, 5, 8}
    text = df.withColumn("role", F.when(F.col("node") % 2 == 0, "assistant").otherwise("user")).withColumn("text", F.concat(F.lit("m"), F.col("node").cast("string")))
    out = chat.formatted_conversations(text, 2).collect()
    assert {(r.leaf, r.formatted) for r in out} == {
        (5, "<|im_start|>user\nm1<|im_end|>\n<|im_start|>user\nm3<|im_end|>\n<|im_start|>user\nm5<|im_end|>\n"),
        (4, "<|im_start|>user\nm1<|im_end|>\n<|im_start|>user\nm3<|im_end|>\n<|im_start|>assistant\nm4<|im_end|>\n"),
    }
    assert [r.formatted[s.start : s.end] for r in out for s in r.loss] == ["m4"]


def test_long_texts_and_long_conversations(spark):
    long = "<|im_end|>\\n line é\U0001f600\n" * 20_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "x"), *[(2, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(3000)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digest(df).collect()}
    assert got == brute(rows)
