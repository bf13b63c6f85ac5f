"""Near-duplicate join by the Jaccard similarity of word n-grams, with Bayesian pruning.

1. Copies (the same words) collapse to one node. 2. MinHash bands put nodes into buckets; at 0.8 a pair
shares one of 60 bands of 6 values but for 1 in 8e7. 3. Nodes that buckets connect form a group; all pairs of a
group are candidates, compared block by block inside tasks, so that pairs never become rows. 4. MinHash values of
a candidate are compared step by step, and it is dropped as soon as the posterior probability that its similarity
reaches the threshold falls below a tolerance. 5. What is left is verified exactly on its n-grams, and counted as
a link of both nodes. 6. Links join to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import slices, texts_of
from .common import text_key, written
from .graph import components

NGRAM, THRESHOLD = 5, (4, 5)
BANDS, BAND_ROWS = 60, 6
#: MinHash values compared step by step: how many, and how many a step.
COMPARED, STEP, TOLERANCE = 128, 16, 1e-7
#: Words a worker remembers at once; they are forgotten at the end of a task.
REMEMBERED = 150_000


def ngrams(text: str, n: int = NGRAM) -> set[str]:
    """Word n-grams of a text; of a shorter text its words as they are, of an empty one none."""
    words = text.split()
    if len(words) < n:
        return {" ".join(words)} if words else set()
    return {" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}


def alike(a: set[str], b: set[str]) -> bool:
    both = len(a & b)
    return bool(both) and both * THRESHOLD[1] >= (len(a) + len(b) - both) * THRESHOLD[0]


@lru_cache(maxsize=1)
def constants() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(42)
    n = BANDS * BAND_ROWS
    return r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


@lru_cache(maxsize=1)
def remembered() -> dict[str, bytes]:
    return {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def ngram_hashes(words: list[str], n: int = NGRAM) -> np.ndarray:
    """32-bit hashes of a text's distinct n-grams; words are hashed once a worker."""
    import xxhash

    known = remembered()
    if len(known) > REMEMBERED:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_digest(w.encode("utf-8", "surrogatepass"))
    h = np.frombuffer(b"".join(map(known.__getitem__, words)), "<u8")
    n = min(n, len(words))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mixed(out) + h[k : len(h) - n + 1 + k]
    return np.unique((mixed(out) >> np.uint64(32)).astype(np.uint32))


def minhash(hashes: np.ndarray) -> np.ndarray:
    a, b = constants()
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(hashes), 64):
        x = hashes[k : k + 64, None] * a
        x += b
        np.minimum(out, x.min(axis=0), out=out)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(id, tk, copies_key, bands, sig) a row. Null doc_ids are an id of their own; empty texts have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        weights = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 for k in range(BAND_ROWS)], np.uint64)
        for batch in slices(batches):
            keys, bands, sigs = [], [], []
            for t in texts_of(batch.column(2)):
                words = t.split()
                keys.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
                if not words:
                    bands.append([])
                    sigs.append(b"")
                    continue
                m = minhash(ngram_hashes(words))
                bands.append((mixed((m.reshape(BANDS, BAND_ROWS).astype(np.uint64) * weights).sum(axis=1)) >> np.uint64(33)).astype(np.int32))
                sigs.append((m[:COMPARED] >> np.uint32(16)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int32())), pa.array(sigs, pa.binary())], names=["id", "tk", "copies_key", "bands", "sig"])
        remembered().clear()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), text_key(F.col("text")).alias("tk"), F.col("text").alias("t"))
    return rows.mapInArrow(run, "id long, tk long, copies_key binary, bands array<int>, sig binary")


@lru_cache(maxsize=1)
def least_matches() -> list[int]:
    """After each step, the matches below which a pair is dropped.

    With a uniform prior the posterior of the similarity after m of n matches is Beta(m + 1, n - m + 1), and its
    mass above t is the chance that a binomial (n + 1, t) is at most m.
    """
    t, out = THRESHOLD[0] / THRESHOLD[1], []
    for n in range(STEP, COMPARED + 1, STEP):
        mass, m = 0.0, 0
        while True:
            mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if mass >= TOLERANCE:
                break
            m += 1
        out.append(m)
    return out


def node_texts(named: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, t): a text of each named node."""
    wanted = written(named.join(nodes.select("node", "id", "tk"), "node"), "near-named")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), text_key(F.col("text")).alias("tk"), F.col("text").alias("t"))
    # the same join at every size; repeated rows give a node's text more than once
    return written(keyed.join(wanted.hint("merge"), ["id", "tk"]).select("node", "t").dropDuplicates(["node"]), "near-texts")


#: Members of a block, of which a task holds two; and the members from which on a group is cut into blocks.
BLOCK, LARGE = 400, 65
#: Texts whose n-grams are looked up at once.
LOOKED_UP = 64


def survivors(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of MinHash values are not dropped when compared step by step."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), int)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def compared(table: pa.Table, s: int, t: int) -> tuple[np.ndarray, dict[int, int]]:
    """Verified links of each row, and for rows that links connect the least row they reach.

    Compares all rows of block s with all of block t, each pair once.
    """
    block, texts = table.column("block").to_numpy(), table.column("t")
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, COMPARED)
    one, two = np.flatnonzero(block == s), np.flatnonzero(block == t)
    known: dict[str, int] = {}
    grams: dict[int, np.ndarray] = {}
    mark = np.zeros(1024, bool)
    parent: dict[int, int] = {}
    counts = np.zeros(len(block), np.int64)

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def of(k: int) -> np.ndarray:
        """The text's n-grams as numbers that stand for the very strings."""
        if k not in grams:
            grams[k] = np.array([known.setdefault(g, len(known)) for g in ngrams(texts[k].as_py() or "")], np.int32)
        return grams[k]

    for k in one.tolist():
        rest = two[two > k] if s == t else two
        hits = rest[survivors(np.broadcast_to(sig[k], (len(rest), COMPARED)), sig[rest])]
        for at in range(0, len(hits), LOOKED_UP):
            some, own = hits[at : at + LOOKED_UP], of(k)
            theirs = [of(j) for j in some.tolist()]
            if len(mark) < len(known):
                mark = np.zeros(2 * len(known), bool)
            sizes = np.array([len(x) for x in theirs])
            mark[own] = True
            both = np.add.reduceat(mark[np.concatenate(theirs)].astype(np.int64), np.cumsum(sizes) - sizes)
            mark[own] = False
            linked = some[(both > 0) & (both * THRESHOLD[1] >= (len(own) + sizes - both) * THRESHOLD[0])]
            counts[k] += len(linked)
            counts[linked] += 1
            for j in linked.tolist():
                x, y = root(k), root(j)
                parent[max(x, y)] = min(x, y)
    return counts, {k: root(k) for k in list(parent)}


def group_links(groups: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v, n): with a v, two nodes that verified links connect; without, n of the verified links of u.

    `groups` (node, g): nodes of different groups share no bucket. A large group is cut into blocks, and each
    pair of blocks is compared in one task, which prunes, verifies and counts in place. So each pair of a group is
    compared once however many buckets it shares, and a task gives at most two rows a node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int | None, int]] = []
        held: list[pa.RecordBatch] = []
        key = None

        def end() -> None:
            table = pa.Table.from_batches(held)
            node = table.column("node").to_pylist()
            counts, roots = compared(table, key[1], key[2])
            out.extend((node[k], None, n) for k, n in enumerate(counts.tolist()) if n)
            out.extend((node[k], node[r], 0) for k, r in roots.items() if k != r)
            held.clear()

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["u", "v", "n"])

        for batch in slices(batches):
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(starts, starts[1:]):
                if hi == lo:
                    continue
                now = tuple(keys[lo].tolist())
                if held and now != key:
                    end()
                key = now
                held.append(batch.slice(lo, hi - lo))
            yield rows()
        if held:
            end()
            yield rows()

    n = F.count(F.lit(1))
    blocks = written(groups.groupBy("g").agg(F.when(n < LARGE, 1).otherwise(F.ceil(n / BLOCK)).cast("int").alias("blocks")), "near-blocks")
    texts = node_texts(groups.select("node"), nodes, docs)
    placed = groups.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(nodes.select("node", "sig"), "node").join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select("g", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "node", "block", "sig", "t")
    return dealt.repartition("g", "b1", "b2").sortWithinPartitions("g", "b1", "b2").mapInArrow(run, "u long, v long, n long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, class_id, n_links, n_copies) of every row; tk is a hash of its text.

    class_id: the least doc_id of all documents that links connect. n_links: verified links of the
    document's text to other texts, all of them. n_copies: rows with the same words.
    Defined cases: null text is empty; texts without a word are copies of each other; a null doc_id is a
    document of its own id and names its class null if it is alone; repeated rows are copies; an empty
    table gives no row; other columns are not read.
    """
    null = F.lit(-(1 << 63))
    return classes(docs).select(F.nullif("id", null).alias("doc_id"), "tk", F.nullif("class", null).alias("class_id"), "n_links", "n_copies")


def classes(docs: DataFrame) -> DataFrame:
    """(id, tk, c, class, n_links, n_copies): c tells classes apart even where they have equal least ids."""
    base = written(sketches(docs), "near-sketches")
    first = F.min_by(F.struct("id", "tk", "bands", "sig"), F.struct("id", "tk"))
    nodes = base.groupBy("copies_key").agg(first.alias("r"), F.count(F.lit(1)).alias("n_copies"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "copies_key", "r.*", "n_copies"), "near-nodes")

    bands = nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("value").cast("long")).alias("bucket"))
    # the least member is the hub: an edge a member is enough to connect a bucket
    hubs = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1").select("bucket", "hub")
    members = written(bands.join(written(hubs, "near-hubs").hint("merge"), "bucket"), "near-members")
    groups = written(components(members.filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))).withColumnRenamed("component", "g"), "near-groups")
    found = written(group_links(groups, nodes, docs), "near-links")
    joined = written(components(found.filter("v IS NOT NULL").select("u", "v")), "near-components")
    ends = found.filter("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n_links"))
    label = F.coalesce(F.col("component"), F.col("node"))
    labelled = nodes.select("node", "copies_key", "id", "n_copies").join(joined, "node", "left").join(ends, "node", "left").withColumn("c", label)
    least = labelled.groupBy("c").agg(F.min("id").alias("class"))
    final = written(labelled.join(least, "c").select("copies_key", "c", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "near-classes")
    return base.select("id", "tk", "copies_key").join(final, "copies_key").drop("copies_key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class stays, the first by doc_id, then by text hash; columns as they were.

    Defined cases: null and empty texts, and texts without a word, are copies of each other, so one stays; of
    repeated rows one stays, any of those that agree in doc_id and text; a null doc_id comes first; an empty table
    stays empty; columns of any name and type stay as they are.
    """
    first = classes(docs).groupBy("c").agg(F.min(F.struct("id", "tk")).alias("k"))
    kept = written(first.select(F.col("k.id").alias("_near_id"), F.col("k.tk").alias("_near_tk")), "near-kept")
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_near_id"), text_key(F.col("text")).alias("_near_tk"))
    return keyed.join(kept, ["_near_id", "_near_tk"], "left_semi").dropDuplicates(["_near_id", "_near_tk"]).select("_doc.*")
