"""Hard negatives for anchors: rows of another label that score just below a positive.

Scores are inner products of whole numbers, computed as Kronecker-packed products: the components of several candidates
are biased to be non-negative and laid into separated fields of one wide integer; one multiplication by an anchor's
component multiplies all of them, sums of such products stay inside their fields, and the fields are unpacked to exact
scores. Two or three fields fit the 53 bits that a double holds exactly, so an anchor block meets a candidate block in one
matrix product; where vectors are too large for two such fields, the wide integers are Python's, of any width.

Anchors and candidates are packed into blocks, one row of a table each, and every anchor block meets every candidate
block, in groups of one anchor block and a bounded number of candidate blocks. First each anchor's positives are found,
then, against their scores, its negatives. A task keeps the best few an anchor, and these are merged by key.

Defined cases: rows with a null label, vector or component, a component that is not finite, or a null id take no part; of
rows with one id the one with the least label (then the least vector) counts; vectors shorter than the longest are filled
up with zeros; an empty table, or one without anchors, gives no rows; ties of scores go to the smaller id; a positive
below zero has no negatives, as 80 per cent of it lie above it; a score beyond 64 bits counts as the nearest of 64 bits.
Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import trimmed, written

#: Rows of a block, about; candidate blocks of a group; anchors of a block that are multiplied at a time.
BLOCK, GROUP, TOGETHER = 4096, 256, 256
#: Bits that a double holds exactly.
EXACT = 53


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, anchors x candidates, as int64 (cut to its range).

    With bias b, a field holds h + sum a (c + b), where h = 2 b times the largest sum of an anchor's magnitudes: 0 to 2 h."""
    n, m = len(anchors), len(candidates)
    if not n or not m or not candidates.shape[1]:
        return np.zeros((n, m), np.int64)
    bias = max(abs(int(candidates.max())), abs(int(candidates.min())))
    half = 2 * bias * int(np.abs(anchors).sum(axis=1).max())
    bits = max(1, (2 * half).bit_length())
    beyond = (anchors.sum(axis=1) * bias + half)[:, None]  # what a field holds besides the score
    fields = EXACT // bits
    if fields < 2:
        return np.clip(wide_fields(anchors, candidates, bias, half, -(-bits // 8)) - beyond, -(2**63), 2**63 - 1).astype(np.int64)
    width = -(-m // fields)
    biased = np.full((fields * width, candidates.shape[1]), float(bias))
    biased[:m] += candidates.astype(np.float64)
    wide = sum(part * float(1 << f * bits) for f, part in enumerate(biased.reshape(fields, width, -1)))
    products = (anchors.astype(np.float64) @ wide.T + float(sum(half << f * bits for f in range(fields)))).astype(np.int64)
    unpacked = [products >> f * bits & (1 << bits) - 1 for f in range(fields)]
    return np.concatenate(unpacked, axis=1)[:, :m] - beyond.astype(np.int64)


def wide_fields(anchors: np.ndarray, candidates: np.ndarray, bias: int, half: int, size: int) -> np.ndarray:
    """Fields of integers of any width, `size` bytes and a candidate each."""
    m = len(candidates)
    packed = lambda numbers: int.from_bytes(b"".join(x.to_bytes(size, "little") for x in numbers), "little")
    wide = [packed(int(x) + bias for x in column) for column in candidates.T]
    start = packed([half] * m)
    out = np.empty((len(anchors), m), object)
    for i, anchor in enumerate(anchors):
        raw = sum((int(a) * w for a, w in zip(anchor, wide, strict=True)), start).to_bytes(size * m, "little")
        out[i] = [int.from_bytes(raw[k : k + size], "little") for k in range(0, size * m, size)]
    return out


def whole(flat: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros: int64, or Python's integers if some are large."""
    small = not flat.size or np.abs(flat).max() < 2**24
    out = np.zeros((lengths.size, width), np.int64 if small else object)
    row = np.repeat(np.arange(lengths.size), lengths)
    out[row, np.arange(flat.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat.astype(np.int64) if small else [int(x) for x in flat]
    return out


class Block:
    """Rows of a block: ids, labels, vectors, and for anchors with positives their ids and scores, highest first."""

    def __init__(self, rows: pa.ListScalar):
        fields = {f.name: c for f, c in zip(rows.values.type, rows.values.flatten(), strict=True)}
        self.ids, self.labels = fields["vec_id"].to_numpy(), fields["label"].to_numpy()
        self.lengths, self.flat = np.diff(fields["q"].offsets.to_numpy()), fields["q"].flatten().to_numpy()
        if "positives" in fields:
            self.offsets = fields["positives"].offsets.to_numpy()
            self.positives, self.scores = (fields["positives"].flatten().field(k).to_numpy() for k in ("id", "score"))
            self.offsets = self.offsets - self.offsets[0]

    @property
    def most(self) -> int:
        """Groups an anchor has: its positives, or itself."""
        return int(np.diff(self.offsets).max(initial=1)) if hasattr(self, "offsets") else 1

    def vectors(self, width: int) -> np.ndarray:
        return whole(self.flat, self.lengths, width)


def firsts(group: np.ndarray, score: np.ndarray, key: np.ndarray, most: int) -> np.ndarray:
    """The places of the first `most` of each group by falling score, then rising key, in this order."""
    order = np.lexsort((key, -score, group))
    sorted_group = group[order]
    new = np.diff(sorted_group, prepend=sorted_group[:1] - 1) != 0
    start = np.flatnonzero(new)[np.cumsum(new) - 1] if order.size else order
    return order[np.arange(order.size) - start < most]


Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # group, score, id


def positives_of(a: Block, x: np.ndarray, c: Block, y: np.ndarray, rows: np.ndarray, most: int = 5) -> Found:
    """Of each anchor in `rows`: the first candidates of its own label, itself aside. Groups are the anchors' places."""
    parts: list[Found] = []
    for label in np.intersect1d(a.labels[rows], c.labels):
        mine, others = rows[a.labels[rows] == label], np.flatnonzero(c.labels == label)
        scores = packed_products(x[mine], y[others])
        floor = np.partition(scores, max(others.size - most - 1, 0), axis=1)[:, max(others.size - most - 1, 0)]
        i, j = np.nonzero((scores >= floor[:, None]) & (a.ids[mine][:, None] != c.ids[others]))
        keep = firsts(i, scores[i, j], c.ids[others[j]], most)
        parts.append((mine[i[keep]], scores[i[keep], j[keep]], c.ids[others[j[keep]]]))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else nothing()


def nothing() -> Found:
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)


def negatives_of(a: Block, x: np.ndarray, c: Block, y: np.ndarray, rows: np.ndarray, most: int = 5, percent: int = 80) -> Found:
    """Of each anchor in `rows` and each of its positives: the first candidates of other labels in the positive's band.
    Groups are the anchors' places times the most positives of any, plus the positive's place."""
    offsets, above = a.offsets, a.scores
    many = np.diff(offsets)
    rows = rows[many[rows] > 0]
    if not rows.size:
        return nothing()
    least = lambda p: percent * (p // 100) + -(-percent * (p % 100) // 100)  # noqa: E731  per cent of p, rounded up
    scores = packed_products(x[rows], y)
    top, low = above[offsets[rows]], least(above[offsets[rows + 1] - 1])
    i, j = np.nonzero((scores <= top[:, None]) & (scores >= low[:, None]) & (a.labels[rows][:, None] != c.labels))
    s, key = scores[i, j], c.ids[j]
    parts: list[Found] = []
    for k in range(int(many[rows].max())):
        has = many[rows] > k
        p = above[np.where(has, offsets[rows] + k, 0)]
        inside = np.flatnonzero(has[i] & (s <= p[i]) & (s >= least(p)[i]))
        keep = inside[firsts(i[inside], s[inside], key[inside], most)]
        parts.append((rows[i[keep]] * a.most + k, s[keep], key[keep]))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def taking_part(embeddings: DataFrame, scale: int, label: Column) -> DataFrame:
    """(vec_id, label, q): rows that take part, their components as whole numbers; one row an id."""
    scaled = F.transform("embedding", lambda v: v.cast("double") * scale)
    finite = lambda v: v.isNotNull() & (F.abs(v) < float("inf"))
    floor = lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)  # noqa: E731  larger ones are whole
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("x", finite)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled.alias("x")).filter(fit)
    return rows.select("vec_id", "label", F.transform("x", floor).alias("q")).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.*")


def in_blocks(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """(`name`, `name`_rows): rows dealt into so many blocks by a hash of their ids, which are unique."""
    key = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias(name)
    return rows.groupBy(key).agg(F.collect_list(F.struct(*rows.columns)).alias(f"{name}_rows"))


#: What tasks find: the positive is null where positives are looked for.
FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def met(anchors: DataFrame, n_anchors: int, candidates: DataFrame, n_candidates: int, find: Callable[..., Found], most: int) -> DataFrame:
    """The best `most` rows a task that `find` gives for each anchor (and positive), every anchor block against every
    candidate block. A group is one anchor block and GROUP candidate blocks at most."""
    groups = -(-n_candidates // GROUP)
    left = candidates.withColumns({"part": F.pmod(F.xxhash64("cb"), F.lit(groups)), "ab": F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))})
    right = anchors.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[Block, Found]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for a, (group, score, key) in kept.values():
                anchor, place = group // a.most, group % a.most
                if hasattr(a, "offsets"):
                    at = a.offsets[anchor] + place
                    own = [pa.array(a.positives[at]), pa.array(a.scores[at])]
                else:
                    own = [pa.nulls(anchor.size, pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([pa.array(a.ids[anchor]), *own, pa.array(key), pa.array(score)], names=["anchor_id", "positive_id", "positive_score", "id", "score"])
            kept.clear()

        for batch in batches:
            for ab, a_rows, c_rows in zip(*batch.columns, strict=True):
                if ab.as_py() not in kept:
                    if len(kept) >= 8:
                        yield from out()
                    kept[ab.as_py()] = (Block(a_rows), nothing())
                a, found = kept[ab.as_py()]
                c, parts = Block(c_rows), [found]
                width = int(max(a.lengths.max(initial=0), c.lengths.max(initial=0)))
                x, y = a.vectors(width), c.vectors(width)
                for low in range(0, a.ids.size, TOGETHER):
                    parts.append(find(a, x, c, y, np.arange(low, min(low + TOGETHER, a.ids.size))))
                group, score, key = (np.concatenate(p) for p in zip(*parts, strict=True))
                keep = firsts(group, score, key, most)
                kept[ab.as_py()] = (a, (group[keep], score[keep], key[keep]))
        yield from out()
        trimmed()

    return left.join(right, ["ab", "part"]).select("ab", "ab_rows", "cb_rows").mapInArrow(run, FOUND)


def ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def hard_negatives(embeddings: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor` holds.

    Positives are an anchor's first other rows of its label; negatives of a positive are the first rows of other labels
    with `percent` to 100 per cent of the positive's score. `label` replaces the column of that name."""
    rows = written(taking_part(embeddings, scale, F.col("label") if label is None else label), "vectors")
    chosen = rows.filter(anchor)
    n, m = rows.count(), chosen.count()
    n_blocks, m_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    candidates = written(in_blocks(rows, n_blocks, "cb"), "candidates")
    first = written(in_blocks(chosen, m_blocks, "ab"), "anchors")
    near = ranked(met(first, m_blocks, candidates, n_blocks, partial(positives_of, most=positives), positives), ["anchor_id"], positives)
    sorted_near = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))), lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score")))
    with_positives = chosen.join(near.groupBy(F.col("anchor_id").alias("vec_id")).agg(sorted_near.alias("positives")), "vec_id")
    second = written(in_blocks(with_positives, m_blocks, "ab"), "anchors")
    found = met(second, m_blocks, candidates, n_blocks, partial(negatives_of, most=negatives, percent=percent), negatives)
    best = ranked(found, ["anchor_id", "positive_id"], negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
