"""Spelling variants: words one edit apart, found in a trie of frequency vectors, and the form that each belongs to.

A word's frequency vector holds its length and how often each group of letters occurs in it. One inserted letter raises
one group by one (a surplus), a deleted one lowers one (a deficit), a replaced one does both, or neither within a group.
The trie arranges words by successive counts; a depth-first search for a word's partners follows, at each level, the equal
count, one more if the surplus is unspent, and one less if the deficit is; the words of the leaves that it reaches are
verified letter by letter.

The trie is cut into subtries of bounded size, one group of rows each: a node with more words than that is cut one level
deeper, and words that share a whole vector beyond that number are dealt into blocks, which every search
that arrives visits. A word joins its own subtrie and is searched for in every subtrie that its budget can reach.

Defined cases: a null text has no words; a null id counts as an empty one in the rule that drops a letter; repeated rows
count again; words are runs of A-Z, a-z and U+00C0 to U+00FF of any length, each code point one byte here; ties of counts
go to the smaller word in code-point order; an empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trimmed, written

#: Groups of letters, a level of the trie each, common letters first; letters of no group are the last level.
GROUPS = ("e", "a", "i", "n", "t", "o", "r", "s", "l", "d", "u", "h", "c", "m", "g", "bp", "fv", "wy", "jkqxz", "éèêëô", "äöüß", "óíáñ")
#: Words of a subtrie at most. A task holds one subtrie at a time.
SUBTRIE = 20_000
#: A node of so few words is a leaf, however deep it lies.
LEAF = 4
#: Words that a counting task holds before it passes them on, searches and bytes compared that go together.
HELD, SEARCHES, COMPARED = 1 << 18, 4096, 1 << 24

RUN = re.compile(rb"[A-Za-z\xc0-\xff]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def runs_of(key: str, text: str, least: int, dropped_of: int | None, held: Counter) -> None:
    """Adds a text's words of `least` letters or more to `held`."""
    pattern = re.compile(rb"[A-Za-z\xc0-\xff]{%d,}" % least)
    words = pattern.findall(text.encode("latin-1", "replace").translate(LOWER))
    held.update(words)
    if dropped_of:
        start = zlib.crc32(f"{key}:".encode())
        hashes = np.array([zlib.crc32(utf8(w), start) for w in words], np.int64)
        for i in np.flatnonzero(hashes % dropped_of == 0).tolist():
            word = words[i]
            at = int(hashes[i]) % len(word)
            held[word] -= 1
            if len(word) > least:
                held[word[:at] + word[at + 1 :]] += 1


def counted_words(docs: DataFrame, least: int = 6, dropped_of: int | None = None) -> DataFrame:
    """(word, n): all words of at least `least` letters, in lower case A-Z, and their occurrences.

    `dropped_of` plants slips: where it divides the CRC-32 of "<doc_id>:<word>", one letter of the word is left out.
    Tasks count their own rows before anything is shuffled; what they hold is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            pairs = [(w.decode("latin-1"), n) for w, n in held.items() if n]
            held.clear()
            for low in range(0, len(pairs), 50_000):
                part = pairs[low : low + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                runs_of(key.as_py(), text.as_py(), least, dropped_of, held)
                if len(held) > HELD:
                    yield from out()
        yield from out()
        trimmed()

    rows = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequency_vector(word: Column, groups: tuple[str, ...]) -> Column:
    """Length, count of each group, count of all other letters."""
    own = [F.length(word) - F.length(F.translate(word, g, "")) for g in groups]
    return F.array(F.length(word), *own, F.length(F.translate(word, "".join(groups), "")))


def heavy_nodes(words: DataFrame, levels: int, most: int) -> dict[tuple[int, ...], int]:
    """Nodes of the trie with more than `most` words, and how many: at most words / most of them on a level."""
    found: dict[tuple[int, ...], int] = {}
    for depth in range(levels + 1):
        node = F.slice("v", 1, depth) if depth else F.array().cast("array<int>")
        level = words.groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).collect()
        if not level:
            break
        found |= {tuple(r.node): r.n for r in level}
    return found


def reached(vector: tuple[int, ...], heavy: dict[tuple[int, ...], int]) -> Iterator[tuple[int, ...]]:
    """The cut nodes that a word of this vector can have partners in, its own first: a depth-first walk over the heavy
    nodes. The first level, the length, tells what may be spent below it."""
    levels = len(vector)
    stack = [((), None, True)]
    while stack:
        node, budget, own = stack.pop()
        depth = len(node)
        if node not in heavy or depth == levels:
            if depth < levels or budget[0] == budget[1]:
                yield node
            continue
        x = vector[depth]
        if budget is None:  # both spent or both left for equal lengths, one spent for others
            steps = [(x - 1, (2, 1), False), (x + 1, (1, 2), False), (x, (1, 1), own)]
        else:
            up, down = budget
            steps = [(x, budget, own)]
            if up == 1:
                steps.insert(0, (x + 1, (0, down), False))
            if down == 1:
                steps.insert(0, (x - 1, (up, 0), False))
        for count, left, same in steps:
            if count >= 0:
                stack.append(((*node, count), left, same))


def dealt(words: DataFrame, heavy: dict[tuple[int, ...], int], most: int) -> DataFrame:
    """(shard, own, word, n, v): each word in the subtrie that holds it (`own`), and in those it is searched for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, vectors = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            shards, owns, at = [], [], []
            for i, (name, vector) in enumerate(zip(names, vectors, strict=True)):
                for k, node in enumerate(reached(tuple(vector), heavy)):
                    blocks = -(-heavy[node] // most) if node in heavy else 1
                    home = zlib.crc32(utf8(name.encode("latin-1"))) % blocks
                    for b in range(blocks):
                        shards.append(",".join(map(str, node)) + (f"/{b}" if blocks > 1 else ""))
                        owns.append(k == 0 and b == home)
                        at.append(i)
            for low in range(0, len(at), 20_000):
                took = batch.take(pa.array(at[low : low + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(shards[low : low + 20_000]), pa.array(owns[low : low + 20_000]), *took.columns], names=["shard", "own", "word", "n", "v"])

    return words.select("word", "n", "v").mapInArrow(run, "shard string, own boolean, word string, n long, v array<int>")


@dataclass
class Words:
    """Words in one buffer of bytes, a letter each."""

    letters: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(words: list[bytes]) -> Words:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return Words(np.frombuffer(b"".join(words) + b"\0", np.uint8), np.cumsum(lengths) - lengths, lengths)

    def rows(self, which: np.ndarray, length: int, skip: int = 0) -> np.ndarray:
        """Letters `skip` to `length` + `skip` of words, a row each."""
        return self.letters[self.starts[which][:, None] + np.arange(skip, length + skip)]


def one_edit(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[j] differ by exactly one inserted, deleted or replaced letter."""
    out = np.zeros(i.size, bool)
    la, lb = a.lengths[i], b.lengths[j]
    kind = np.where(np.abs(lb - la) <= 1, 3 * la + lb - la + 1, -1)
    for k in np.unique(kind[kind >= 0]).tolist():
        length, longer = k // 3, k % 3 - 1
        group = np.flatnonzero(kind == k)
        step = max(1, COMPARED // max(1, length))
        for low in range(0, group.size, step):
            at = group[low : low + step]
            if longer == 0:
                out[at] = np.count_nonzero(a.rows(i[at], length) != b.rows(j[at], length), axis=1) == 1
                continue
            short, s, long, t = (a, i, b, j) if longer > 0 else (b, j, a, i)
            n = min(length, length + longer)
            if n == 0:
                out[at] = True
                continue
            mine = short.rows(s[at], n)
            front, back = mine != long.rows(t[at], n), mine != long.rows(t[at], n, 1)
            equal = np.where(front.any(axis=1), front.argmax(axis=1), n)  # letters that agree from the front
            last = np.where(back.any(axis=1), n - back[:, ::-1].argmax(axis=1), 0)  # behind which all agree, shifted by one
            out[at] = last <= equal
    return out


class Trie:
    """Frequency vectors of words, level by level. Words lie in the order of their vectors, so a node is a range of them."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.lexsort(vectors.T[::-1])
        v = vectors[self.order]
        self.base = int(v.max(initial=0)) + 3
        self.keys: list[np.ndarray] = []
        self.starts: list[np.ndarray] = [np.zeros(1, np.int64)]
        node = np.zeros(len(v), np.int64)
        for level in range(v.shape[1]):
            key = node * self.base + v[:, level] + 1
            first = np.flatnonzero(np.diff(key, prepend=-1))
            self.keys.append(key[first])
            self.starts.append(first)
            node = np.cumsum(np.diff(key, prepend=-1) != 0) - 1
        self.n = len(v)

    def size(self, level: int, node: np.ndarray) -> np.ndarray:
        starts = self.starts[level]
        return np.append(starts, self.n)[node + 1] - starts[node]

    def search(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(search, first, size): ranges of `order` that a search arrives at. All searches go down together, level by level."""
        every = np.arange(len(vectors))
        # lengths first: equal ones may spend both or none, others must spend the one that they differ by
        starts = []
        for d, up, down in ((0, 1, 1), (1, 1, 0), (-1, 0, 1)):
            found = self._step(0, every, np.zeros(every.size, np.int64), vectors[:, 0] + d, np.full(every.size, up), np.full(every.size, down))
            starts.append((*found, np.full(found[0].size, d == 0)))
        who, node, up, down, even = (np.concatenate(x) for x in zip(*starts, strict=True))
        for level in range(1, vectors.shape[1]):
            small = self.size(level, node) <= LEAF
            if small.any():
                yield who[small], self.starts[level][node[small]], self.size(level, node[small])
                who, node, up, down, even = (x[~small] for x in (who, node, up, down, even))
            if not who.size:
                return
            x = vectors[who, level]
            parts = []
            for d, can in ((0, np.ones(who.size, bool)), (1, up == 1), (-1, down == 1)):
                at = np.flatnonzero(can)
                found, child, u, w = self._step(level, at, node[at], x[at] + d, up[at] - (d == 1), down[at] - (d == -1))
                parts.append((who[found], child, u, w, even[found]))
            who, node, up, down, even = (np.concatenate(x) for x in zip(*parts, strict=True))
        done = np.where(even, up == down, up + down == 0)
        last = vectors.shape[1]
        yield who[done], self.starts[last][node[done]], self.size(last, node[done])

    def _step(self, level: int, who: np.ndarray, node: np.ndarray, count: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, ...]:
        """Those of the states whose node has a child of this count, and the child."""
        keys = self.keys[level]
        fits = (count >= 0) & (count < self.base - 1)
        key = node * self.base + count + 1
        at = np.searchsorted(keys, key)
        hit = fits & (keys[np.minimum(at, keys.size - 1)] == key)
        return who[hit], at[hit], up[hit], down[hit]


@dataclass
class Subtrie:
    """The words of one subtrie, ready for searches."""

    names: list[str]
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.words = Words.of([w.encode("latin-1") for w in self.names])
        rank = np.empty(len(self.names), np.int64)
        rank[sorted(range(len(self.names)), key=lambda i: (-self.counts[i], self.names[i]))] = np.arange(len(self.names))
        self.rank, self.by_rank = rank, np.argsort(rank)

    def near(self, trie: Trie, names: list[str], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each searched word: its near words here, and the place of the best of them (-1: none)."""
        searched = Words.of([w.encode("latin-1") for w in names])
        n_near, best = np.zeros(len(names), np.int64), np.full(len(names), len(self.names))
        for who, first, size in trie.search(vectors):
            ends = np.cumsum(size)
            total = int(ends[-1]) if ends.size else 0
            for low in range(0, total, COMPARED // 16):  # ranges to pairs, a bounded number at a time
                high = min(low + COMPARED // 16, total)
                a, b = np.searchsorted(ends, (low, high - 1), side="right")
                part = slice(a, b + 1)
                left = np.maximum(ends[part] - size[part], low)
                many = np.minimum(ends[part], high) - left
                i = np.repeat(who[part], many)
                j = self.at[np.repeat(first[part] + left - (ends[part] - size[part]), many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                hit = one_edit(searched, i, self.words, j)
                np.add.at(n_near, i[hit], 1)
                np.minimum.at(best, i[hit], self.rank[j[hit]])
        return n_near, np.where(best < len(self.names), self.by_rank[np.minimum(best, len(self.names) - 1)], -1)


def found_near(rows: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) a subtrie: what `dealt` rows find there. Rows come sorted by subtrie, its own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, names, counts, vectors, trie, sub = None, [], [], [], None, None

        def answers(word: list[str], n: list[int], v: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
            for low in range(0, len(word), SEARCHES):
                part, ns = word[low : low + SEARCHES], n[low : low + SEARCHES]
                n_near, best = sub.near(trie, part, v[low : low + SEARCHES])
                keep = [i for i in range(len(part)) if own or n_near[i]]
                form = [sub.names[best[i]] if best[i] >= 0 else None for i in keep]
                form_n = [int(sub.counts[best[i]]) if best[i] >= 0 else None for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[i] for i in keep], pa.string()), pa.array([ns[i] for i in keep], pa.int64()), pa.array(n_near[keep], pa.int64()), pa.array(form, pa.string()), pa.array(form_n, pa.int64())],
                    names=["word", "n", "n_near", "form", "form_n"],
                )

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal trie, sub
            if trie is None and names:
                v = np.concatenate(vectors)
                trie, sub = Trie(v), Subtrie(names, np.array(counts, np.int64))
                sub.at = trie.order
                yield from answers(names, counts, v, True)

        for batch in batches:
            keys, owns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cut = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or owns[i] != owns[i - 1]] + [len(keys)]
            for low, high in zip(cut, cut[1:], strict=False):
                if keys[low] != shard:
                    yield from ready()
                    shard, names, counts, vectors, trie, sub = keys[low], [], [], [], None, None
                rows = batch.slice(low, high - low)
                word, n = rows.column(2).to_pylist(), rows.column(3).to_pylist()
                v = rows.column(4).flatten().to_numpy().astype(np.int64).reshape(len(word), -1)
                if owns[low]:
                    names, counts = names + word, counts + n
                    vectors.append(v)
                else:
                    yield from ready()
                    if trie is not None:
                        yield from answers(word, n, v, False)
        yield from ready()
        trimmed()

    sorted_rows = rows.repartition("shard").sortWithinPartitions("shard", F.col("own").desc())
    return sorted_rows.mapInArrow(run, "word string, n long, n_near long, form string, form_n long")


def near_words(words: DataFrame, groups: tuple[str, ...] = GROUPS, most: int = SUBTRIE) -> DataFrame:
    """(word, n, n_near, form, form_n) of distinct (word, n): how many words are one edit away, and the commonest of them."""
    table = written(words.select("word", "n", frequency_vector(F.col("word"), groups).alias("v")), "words")
    heavy = heavy_nodes(table, len(groups) + 2, most)
    best = F.min_by(F.struct("form", "form_n"), F.when(F.col("form").isNotNull(), F.struct(-F.col("form_n"), F.col("form"))))
    return found_near(dealt(table, heavy, most)).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", "b.form", "b.form_n")


def with_roots(forms: DataFrame, ratio: int) -> DataFrame:
    """Adds `root`: the last word that forms lead to. A form is `ratio` times as common, so chains are short: pointers are doubled
    as often as the largest count allows."""
    largest, least = forms.agg(F.max("n"), F.min("n")).first()
    hops = int(math.log((largest or 1) / (least or 1), ratio) + 1e-9)
    to = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(hops)) if hops > 1 else 0):
        to = written(to.join(to.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return forms.join(to, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least: int = 6, count: int = 5, ratio: int = 5, dropped_of: int | None = None, groups: tuple[str, ...] = GROUPS, most: int = SUBTRIE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): words of `docs` of at least `least` letters and `count` occurrences; `form`: the
    commonest word one edit away, if it is `ratio` times as common; `root`: where forms lead in the end."""
    words = counted_words(docs, least, dropped_of).filter(F.col("n") >= count)
    near = near_words(words, groups, most)
    common = F.col("form_n") >= ratio * F.col("n")
    forms = written(near.withColumns({"form": F.when(common, F.col("form")), "form_n": F.when(common, F.col("form_n"))}), "forms")
    return with_roots(forms, ratio).select("word", "form", "root", "n", "n_near", "form_n")
