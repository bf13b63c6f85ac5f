"""Removal of byte strings that an earlier document has, by suffix arrays.

A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id. Steps:

1. Anchors. Every 50-byte window names one of its 16-byte strings, the one with the least hash; equal windows name
   equal strings. Only windows whose anchor occurs in two documents can repeat. Anchors go to buckets as packed
   arrays, one entry for each anchor and slice of documents, so a passage that many share stays small.
2. Contexts. Windows in a row with the same shared anchor form a context of at most 84 bytes. Equal contexts
   of a task are combined to one with its least doc_id before they are shuffled.
3. Shards. Contexts meet in shards by anchor. A shard's suffix array is built by Larsson-Sadakane refinement (numpy,
   whole arrays at a time), Kasai's recurrence gives the common prefixes of neighbours, up to 50 bytes, and every
   group of equal windows gets its least doc_id. Equal windows are in one shard unless an anchor is too common for
   one: the contexts of such a bucket are cut again at second anchors, by another hash, and dealt by these. What even
   then outgrows a shard is split by context, and its shards' sorted windows are merged by binary search.
4. Every occurrence of a context learns which of its windows an earlier document has; the covered bytes of
   a document are removed.

Texts lie in a table that is bucketed by row, so they are not shuffled for the two joins that need them.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import slices
from .common import STORED, scratch, trimmed, written

LENGTH, ANCHOR = 50, 16
#: Bits of a window's key that hold the position; the rest is hash.
PLACE_BITS = 31
#: Bytes of text whose anchors are packed at once, and of contexts in one suffix array.
SLICE_BYTES, SHARD_BYTES = 4_000_000, 8_000_000
#: Bytes of all texts that a bucket of anchors stands for, and buckets of contexts for each of these: so many that
#: only a very common anchor fills more than a shard.
BUCKET_BYTES, CONTEXT_BUCKETS = 64_000_000, 16
NULL_ID = -(1 << 63)


def string_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings of b, by doubling: a string's hash comes from those of its parts."""
    n = len(b) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        part, size, power = b.astype(np.uint64), 1, np.uint64(0x9E3779B97F4A7C15)
        out, done = np.zeros(n, np.uint64), 0
        while True:
            if k & size:
                out = out * power + part[done : done + n]
                done += size
            size *= 2
            if size > k:
                break
            part = part[: -(size // 2)] * power + part[size // 2 :]
            power = power * power
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of each window's anchor, distinct positions, their hashes); leftmost of equal hashes."""
    h = string_hashes(b, ANCHOR)
    width = LENGTH - ANCHOR + 1
    if len(h) < width:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    bits = np.uint64(PLACE_BITS)
    keys = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(keys, width) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    own = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return at, own, h[own]


def five_bytes(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def cut_to_40_bits(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(24)


def anchor_rows(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, slice, rest, row): packed anchors of a slice of rows. Hashes are cut to 40 bits, which can only let
    more windows through. Anchors of two rows of the slice are known to be shared: their occurrences go to a
    bucket of their own, and one entry stands for them elsewhere."""
    names = ["bucket", "slice", "rest", "row"]

    def pack(rids: list[int], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(hashes)
        if not len(h):
            return
        row = np.repeat(np.array(rids, np.int64), [len(x) for x in hashes])
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        last = np.append(first[1:], len(h)) - 1
        known = np.repeat(row[first] != row[last], last - first + 1)
        parts = [(buckets + rids[0] % (4 * buckets), np.flatnonzero(known))] if known.any() else []
        to = (h[first] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[by], np.arange(buckets + 1))
        parts += [(k, first[by[cut[k] : cut[k + 1]]]) for k in range(buckets) if cut[k] < cut[k + 1]]
        values = [(k, rids[0], five_bytes(cut_to_40_bits(h[i])), row[i].astype("<i8").tobytes()) for k, i in parts]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*values), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, hashes, size = [], [], 0
        for batch in slices(batches):
            for rid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rids.append(rid)
                hashes.append(np.unique(anchors(np.frombuffer(raw, np.uint8))[2]))
                size += len(raw)
                if size >= SLICE_BYTES:
                    yield from pack(rids, hashes)
                    rids, hashes, size = [], [], 0
        if rids:
            yield from pack(rids, hashes)
        trimmed()

    return texts.select("rid", F.col("text").cast("binary")).mapInArrow(run, "bucket int, slice long, rest binary, row binary")


def shared_anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """(rid, shared): the cut hashes of a row's anchors that another row has too.

    A bucket answers each slice with one packed row; a slice's answers are then gathered into its rows."""

    def of_bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rests = table.column("rest").to_pylist()
        keep = np.ones(sum(map(len, rests)) // 5, bool)
        if key[0].as_py() < buckets:
            rest = from_five(b"".join(rests))
            order = np.argsort(rest, kind="stable")
            new = np.concatenate(([True], rest[order][1:] != rest[order][:-1]))
            keep[order] = ~(new & np.append(new[1:], True))
        out, at = [], 0
        for part, raw, row in zip(table.column("slice").to_pylist(), rests, table.column("row").to_pylist(), strict=True):
            own = keep[at : at + len(raw) // 5]
            at += len(own)
            if own.any():
                out.append((part, np.frombuffer(raw, np.uint8).reshape(-1, 5)[own].tobytes(), np.frombuffer(row, "<i8")[own].tobytes()))
        part, rest, row = zip(*out) if out else ((), (), ())
        return pa.table({"slice": pa.array(part, pa.int64()), "rest": pa.array(rest, pa.binary()), "row": pa.array(row, pa.binary())})

    def of_slice(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rest = from_five(b"".join(table.column("rest").to_pylist())).astype(np.int64)
        rid = np.frombuffer(b"".join(table.column("row").to_pylist()), "<i8")
        order = np.lexsort((rest, rid))
        rid, rest = rid[order], rest[order]
        start = np.flatnonzero(np.concatenate(([True], rid[1:] != rid[:-1])))
        trimmed()
        return pa.table({"rid": pa.array(rid[start], pa.int64()), "shared": pa.ListArray.from_arrays(pa.array(np.append(start, len(rid)), pa.int32()), pa.array(rest))})

    found = rows.groupBy("bucket").applyInArrow(of_bucket, "slice long, rest binary, row binary")
    return found.groupBy("slice").applyInArrow(of_slice, "rid long, shared array<long>")


#: Distinct contexts that a task remembers before it starts anew.
REMEMBERED = 200_000


def contexts(texts: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """(bucket, context, c1, c2, did, rid, start): runs of windows with one shared anchor, in every row.

    A context's bytes stand in a task's first row of it, and again where a smaller did comes, and are NULL
    elsewhere: equal contexts of a task are combined before they are shuffled. c1 and c2 are 128 bits of its hash.
    """
    names = ["bucket", "context", "c1", "c2", "did", "rid", "start"]
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: dict[bytes, int] = {}
        for batch in slices(batches):
            rows = []
            for rid, did, raw, shared in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                at, _, h = anchors(np.frombuffer(raw, np.uint8))
                begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                end = np.append(begin[1:], len(at))
                keep = np.isin(cut_to_40_bits(h).astype(np.int64), np.array(shared))
                to = (h[keep] % np.uint64(buckets)).astype(np.int64).tolist()
                for k, s, e in zip(to, begin[keep].tolist(), end[keep].tolist(), strict=True):
                    context = raw[s : e + LENGTH - 1]
                    digest = xxhash.xxh3_128_digest(context)
                    least = seen.get(digest)
                    first = least is None or did < least
                    if first:
                        seen[digest] = did
                    rows.append((k, context if first else None, digest, did, rid, s))
            if len(seen) > REMEMBERED:
                seen.clear()
            if rows:
                k, context, digest, did, rid, start = zip(*rows)
                halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                columns = (k, context, np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), did, rid, start)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
        trimmed()

    both = texts.join(shared, "rid").select("rid", "did", F.col("text").cast("binary").alias("text"), "shared")
    return both.mapInArrow(run, "bucket int, context binary, c1 long, c2 long, did long, rid long, start int")


def eights(t: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number, zeros behind the end."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    x, size = padded, 1
    while size < 8:
        x = (x[:-size] << np.uint64(8 * size)) | x[size:]
        size *= 2
    return x[: len(t)]


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first `depth` bytes at least, eight-byte keys), Larsson-Sadakane.

    Suffixes sorted by h bytes fall into groups; only groups of more than one are sorted on, by the rank of
    the suffix h further, which doubles h.
    """
    n, keys = len(t), eights(t)
    order = np.argsort(keys, kind="stable")
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    starts = np.flatnonzero(new)
    group = np.repeat(starts, np.diff(np.append(starts, n)))
    rank[order] = group
    several = np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n)))
    unsorted, h = np.flatnonzero(several), 8
    while h < depth and len(unsorted):
        sub = order[unsorted]
        pair = rank[sub] * (n + 1) + rank[np.minimum(sub + h, n)] + 1
        by = np.argsort(pair, kind="stable")
        sub, pair = sub[by], pair[by]
        order[unsorted] = sub
        starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        sizes = np.diff(np.append(starts, len(sub)))
        rank[sub] = np.repeat(unsorted[starts], sizes)
        unsorted = unsorted[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order, keys


#: Numbers from which on a difference of eight bytes has two, three ... eight bytes.
BYTES = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)


def common_prefixes(order: np.ndarray, keys: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bytes, up to `length`, that each suffix in `order` shares with the one before it.

    Kasai's recurrence: if suffix i shares h bytes with its neighbour j, then i + s shares at least h - s with its own,
    as j + s lies before it too. Here it runs over whole arrays: suffixes at multiples of 8 bytes within their context
    (`offsets`) are compared from their start, those half way between from what these leave, and so on to every
    byte. Where j + s is no window or ties put it behind i + s, nothing is known and comparison starts anew.
    """
    n = len(keys)
    place = np.full(n + 16, -1, np.int32)  # in `order`; -1: no window
    place[order] = np.arange(len(order), dtype=np.int32)
    before = np.zeros(n, np.int32)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int8)
    inner = np.sort(order)
    for step in (8, 4, 2, 1):
        at = inner[offsets[inner] % 8 == 0] if step == 8 else inner[offsets[inner] % (2 * step) == step]
        at = at[place[at] > 0]
        other, known = before[at].astype(np.int64), np.zeros(len(at), np.int64)
        if step < 8:
            left = at - step
            beside = before[left].astype(np.int64) + step
            valid = (place[left] > 0) & (place[beside] >= 0) & (place[beside] < place[at])
            known[valid] = np.maximum(shared[left[valid]].astype(np.int64) - step, 0)
        alive = np.flatnonzero(known < length)
        while len(alive):
            k = np.minimum(known[alive], length - 8)
            different = keys[at[alive] + k] ^ keys[other[alive] + k]
            same = different == 0
            known[alive[~same]] = np.maximum(known[alive[~same]], k[~same] + 7 - np.searchsorted(BYTES, different[~same], side="right"))
            known[alive[same]] = k[same] + 8
            alive = alive[same & (k + 8 < length)]
        shared[at] = np.minimum(known, length)
    return shared[order]


def shard_windows(texts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a shard's contexts: (sorted start positions, group starts in them, least id of each group,
    context of each position)."""
    t = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(x) for x in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    ends = np.cumsum(lengths)
    offsets = np.arange(len(t)) - (ends - lengths)[owner]
    order, keys = suffix_array(t)
    order = order[offsets[order] <= (lengths - LENGTH)[owner[order]]]
    starts = np.flatnonzero(common_prefixes(order, keys, offsets) < LENGTH)
    return order, starts, np.minimum.reduceat(ids[owner[order]], starts), owner


def runs_of(least: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values in text order as runs: (first run of each context, from, to, value); windows count within their context."""
    begin = np.concatenate([[0], np.cumsum(counts)])
    new = np.concatenate(([True], least[1:] != least[:-1]))
    new[begin[:-1]] = True
    at = np.flatnonzero(new)
    context = np.searchsorted(begin, at, side="right") - 1
    to = np.append(at[1:], len(least))
    return np.searchsorted(at, begin), at - begin[context], to - begin[context], least[at]


RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("least", pa.int64())]))
ANSWER = "c1 long, c2 long, runs array<struct<a: int, b: int, least: long>>"


def answer_table(c1: pa.Array, c2: pa.Array, least: np.ndarray, counts: np.ndarray, at: np.ndarray) -> pa.Table:
    """`at`: places of the texts in their contexts, from which windows count."""
    if not len(counts):
        return pa.table({"c1": c1, "c2": c2, "runs": pa.array([], RUNS)})
    first, a, b, v = runs_of(least, counts)
    shift = np.repeat(at, np.diff(first))
    structs = pa.StructArray.from_arrays([pa.array(a + shift, pa.int32()), pa.array(b + shift, pa.int32()), pa.array(v, pa.int64())], names=["a", "b", "least"])
    return pa.table({"c1": c1, "c2": c2, "runs": pa.ListArray.from_arrays(pa.array(first, pa.int32()), structs)})


def in_text_order(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    return values[np.argsort(order, kind="stable")]


def distinct_contexts(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, their least ids, c1, c2, place in the context) without repeats."""
    c1, c2, at, did = (table.column(x).to_numpy() for x in ("c1", "c2", "at", "did"))
    order = np.lexsort((at, c2, c1))
    c1, c2, at = c1[order], c2[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (at[1:] != at[:-1]))))
    return table.column("context").take(pa.array(order[first])).to_pylist(), np.minimum.reduceat(did[order], first), c1[first], c2[first], at[first]


def shard_answers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    texts, ids, c1, c2, at = distinct_contexts(table)
    order, starts, least, _ = shard_windows(texts, ids)
    sizes = np.diff(np.append(starts, len(order)))
    counts = np.array([len(x) - LENGTH + 1 for x in texts])
    out = answer_table(pa.array(c1), pa.array(c2), in_text_order(order, np.repeat(least, sizes)), counts, at)
    trimmed()
    return out


def sorted_windows(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(t[order[:, None] + np.arange(LENGTH)]).view(f"S{LENGTH}").ravel()


def merged_answers(a: tuple[list[bytes], np.ndarray], b: tuple[list[bytes], np.ndarray]) -> np.ndarray:
    """For each window of a's contexts, in text order, the least id among b's equal windows (or the largest number),
    by binary search in b's sorted distinct windows."""
    order_a, _, _, _ = shard_windows(*a)
    order_b, starts_b, least_b, _ = shard_windows(*b)
    wanted = sorted_windows(np.frombuffer(b"".join(a[0]), np.uint8), order_a)
    have = sorted_windows(np.frombuffer(b"".join(b[0]), np.uint8), order_b[starts_b])
    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
    return in_text_order(order_a, np.where(have[at] == wanted, least_b[at], np.iinfo(np.int64).max))


def second_anchors(rows: DataFrame, level: int) -> DataFrame:
    """(bucket, part, context, c1, c2, at, did): contexts cut where the anchor by the level's own hash changes. Equal
    windows name equal second anchors, whose hash is `part`; `at` is the part's place in its context."""
    names = ["bucket", "part", "context", "c1", "c2", "at", "did"]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    salt = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & (1 << 64) - 1)
    width, bits = LENGTH - ANCHOR + 1, np.uint64(PLACE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for bucket, raw, c1, c2, at, did in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                h = string_hashes(np.frombuffer(raw, np.uint8), ANCHOR)
                h = (h ^ (h >> np.uint64(29))) * salt
                keys = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
                own = (sliding_min(keys, width) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
                begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                end = np.append(begin[1:], len(own))
                for s, e, part in zip(begin.tolist(), end.tolist(), (h[own[begin]] >> bits).astype(np.int64).tolist(), strict=True):
                    out.append((bucket, part, raw[s : e + LENGTH - 1], c1, c2, at + s, did))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names=names)

    return rows.select("bucket", "context", "c1", "c2", "at", "did").mapInArrow(run, "bucket int, part long, context binary, c1 long, c2 long, at int, did long")


#: Times that a bucket too large for a shard is cut at further anchors.
LEVELS = 3


def dealt_to_shards(rows: DataFrame, keys: list[str], shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """`rows` with `shards`, how many shards the rows of equal `keys` need, and those of the groups that need several."""
    sizes = written(rows.groupBy(*keys).agg(F.ceil(F.sum(F.octet_length("context")) / shard_bytes).cast("int").alias("shards")), "shards")
    return rows.join(sizes, keys), sizes.filter("shards > 1")


def answers(found: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Which of a context's windows are how early. `found` has a bucket's contexts; see step 3 above."""
    rows = found.filter("context IS NOT NULL").select("bucket", "context", "c1", "c2", F.lit(0).alias("at"), "did")
    out, keys = [], ["bucket"]
    for level in range(LEVELS + 1):
        sized, large = dealt_to_shards(rows, keys, shard_bytes)
        out.append(sized.filter("shards <= 1").groupBy(*keys).applyInArrow(shard_answers, ANSWER))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, out)
        if level < LEVELS:
            again = second_anchors(sized.filter("shards > 1"), level)
            # as many parts of a bucket as it needs shards, with room
            rows = written(again.join(large.groupBy("bucket").agg(F.sum("shards").alias("n")), "bucket").withColumn("part", F.pmod("part", 4 * F.col("n"))).drop("n"), "parts")
            keys = ["bucket", "part"]
    # one string of 16 bytes in too many contexts by all hashes: shards by context, merged pair by pair
    hot = sized.filter("shards > 1").withColumn("shard", F.pmod(F.xxhash64("context"), F.col("shards")).cast("int"))
    out.append(hot.groupBy(*keys, "shard").applyInArrow(shard_answers, ANSWER))
    large = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).filter("shard <> other")
    paired = large.select(*keys, F.least("shard", "other").alias("s"), F.greatest("shard", "other").alias("t"), "shard", "context", "did", "c1", "c2", "at")

    def pair(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = table.column("shard").to_numpy()
        sides = [table.filter(pa.array(shard == k.as_py())) for k in key[-2:]]
        if not all(s.num_rows for s in sides):
            return answer_table(pa.array([], pa.int64()), pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        data = [distinct_contexts(s) for s in sides]
        merged = []
        for k in (0, 1):
            texts, ids, c1, c2, at = data[k]
            counts = np.array([len(x) - LENGTH + 1 for x in texts])
            merged.append(answer_table(pa.array(c1), pa.array(c2), merged_answers((texts, ids), data[1 - k][:2]), counts, at))
        return pa.concat_tables(merged)

    return reduce(DataFrame.unionByName, [*out, paired.groupBy(*keys, "s", "t").applyInArrow(pair, ANSWER)])


def remaining(texts: DataFrame, covered: DataFrame) -> DataFrame:
    """(t1, t2, n_bytes, n_removed, n_spans, kept_sha256) of the given rows."""
    names = ["t1", "t2", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = [[] for _ in names[2:]]
            for raw, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                spans, kept, at, end = 0, [], 0, -1
                for r in sorted((r["a"], r["b"]) for r in ranges or ()):
                    if r[0] > end:
                        kept.append(raw[at : r[0]])
                        spans += 1
                    at = end = max(end, r[1])
                kept = b"".join([*kept, raw[at:]])
                for c, v in zip(columns, (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, pa.string()), strict=True))], names=names)

    both = texts.join(covered, "rid", "left").select("t1", "t2", F.col("text").cast("binary").alias("text"), "ranges")
    return both.mapInArrow(run, "t1 long, t2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Removes what earlier documents have, and reports it for every row.

    Of rows with one text the first by doc_id is looked at; later ones lose everything, as each of their strings
    is in the first. Defined cases: null text is empty; texts under 50 bytes keep all; rows with equal
    doc_ids are not earlier than each other; a null doc_id is earlier than any other; an empty table gives
    no row; other columns are not read.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"tickloom_texts_{uuid.uuid4().hex}", scratch(spark, "texts")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), text.alias("text"), F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("t1"), F.xxhash64(F.sha1(text)).alias("t2"))
    rows.write.bucketBy(partitions, "rid").options(path=path, **STORED).saveAsTable(name)
    texts = spark.table(name)
    buckets = max(partitions, math.ceil((texts.agg(F.sum("size")).first()[0] or 0) / BUCKET_BYTES))
    firsts = written(texts.groupBy("t1", "t2").agg(F.min(F.struct("did", "rid")).alias("f")).select("t1", "t2", F.col("f.did").alias("first"), F.col("f.rid").alias("rid")), "first-texts")
    leading = texts.join(firsts.select("rid"), "rid", "left_semi")
    shared = shared_anchors(anchor_rows(leading, buckets), buckets)
    found = written(contexts(texts, shared, CONTEXT_BUCKETS * buckets), "contexts")
    known = written(answers(found, shard_bytes), "answers")
    hits = F.transform(F.filter("runs", lambda r: r["least"] < F.col("did")), lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + (LENGTH - 1)).alias("b")))
    covered = found.select("c1", "c2", "did", "rid", "start").join(known, ["c1", "c2"]).select("rid", hits.alias("h")).filter(F.size("h") > 0).groupBy("rid").agg(F.flatten(F.collect_list("h")).alias("ranges"))
    left = written(remaining(leading, covered).join(firsts.select("t1", "t2", "first"), ["t1", "t2"]), "remaining")
    spark.sql(f"DROP TABLE {name}")  # the name only: its files are outside of the warehouse, and read below
    texts = spark.read.schema(texts.schema).parquet(path)
    again = (F.col("did") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    return texts.select("did", "t1", "t2").join(left, ["t1", "t2"]).select(
        F.nullif("did", F.lit(NULL_ID)).alias("doc_id"), "n_bytes", F.when(again, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(again, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(again, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
