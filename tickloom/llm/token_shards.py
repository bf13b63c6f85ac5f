"""Token ids in Re-Pair compressed shards.

Documents are dealt to shards by ranges of doc_id. Each shard is a run of blocks; a block holds whole
documents and is one binary row of a table that Spark's own writer commits (a lost executor leaves no
half-written shard, and any file system that Spark can write will do). Inside a block the ids that occur are its
alphabet. All pairs of symbols that occur often enough are replaced by nonterminals, round after round, until
none does. The block keeps the rules, their expansion lengths, and for each document its place in the
symbol sequence, so one document is decoded alone.

Block layout, little-endian: 7 int64 (documents, symbols, ids of the alphabet, rules, rounds, bytes per symbol,
ids), documents' first symbol (int64 each, and the end), rules of each round (int64), alphabet (uint32), rule
sides (2 x symbol type each), expansion lengths (uint32 each), symbols. Keys of the documents are in the row beside it.
"""

from __future__ import annotations

import json
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_characters, texts_of
from .common import scratch

#: A block is closed at the first document end after so many ids.
BLOCK_IDS = 1_000_000
#: How often a pair must occur, and how many replacements a rule needs for its 8 bytes. Rarer pairs stay: on 2.8 MB of
#: text 12 gives 1.197 bytes an id, 24 gives 1.234, 8 gives 1.202 (more rules, shorter sequence), and 6 with fewer pairs
#: a round 1.194 at twice the time, so what is forgone is under one percent.
LEAST, PAYS = 12, 5
#: Runs and pieces that a worker remembers before it starts anew; only speed depends on them.
REMEMBERED_RUNS, REMEMBERED_PIECES = 1_000_000, 800_000
#: Bytes of text whose distinct runs are looked up together.
TEXT_AT_ONCE = 4 << 20
#: Slots of the table that finds chosen pairs; a pair whose slot is taken waits for the next round.
SLOT_BITS = 20


def slot(keys: np.ndarray) -> np.ndarray:
    """Multiplicative hash of pair keys to SLOT_BITS bits."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(2654435769)) >> np.uint32(32 - SLOT_BITS)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def places_of(keys: np.ndarray, chosen: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where `keys` holds one of the sorted `chosen`, which). Of pairs in one slot of the table the most frequent is
    found there, the others by binary search among themselves."""
    by_count = np.argsort(counts, kind="stable")
    slots = np.full(1 << SLOT_BITS, -1, np.int32)
    slots[slot(chosen[by_count])] = by_count
    rank = slots[slot(keys)]
    at = np.flatnonzero(rank >= 0)
    rank = rank[at]
    others = np.flatnonzero(slots[slot(chosen)] != np.arange(len(chosen)))
    wrong = np.flatnonzero(chosen[rank] != keys[at])
    if len(wrong):
        rank[wrong] = -1
        if len(others):
            wanted = keys[at[wrong]]
            found = np.minimum(np.searchsorted(chosen[others], wanted), len(others) - 1)
            same = chosen[others[found]] == wanted
            rank[wrong[same]] = others[found[same]]
        at, rank = at[rank >= 0], rank[rank >= 0]
    return at, rank


def compress(ids: np.ndarray, first_symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(alphabet, symbols, documents' first symbols, rules of each round) of concatenated documents.

    No pair crosses a document. Of overlapping occurrences the left one is replaced, and the right one is gone with
    its symbol; so after the first round only pairs with a new symbol can be frequent, and only these are counted.
    """
    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    symbols = (np.cumsum(seen) - 1)[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    last = np.zeros(len(symbols), bool)
    last[first_symbols[1:] - 1] = len(symbols) > 0
    rules, following = [], len(alphabet)
    places = np.flatnonzero(~last[:-1])
    while len(places) >= LEAST:
        wide, bits = (np.uint32, 16) if symbols.itemsize == 2 else (np.uint64, 32)
        keys = (symbols[places].astype(wide) << wide(bits)) | symbols[places + 1]
        ordered = np.sort(keys)
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(starts, append=len(ordered))
        frequent = counts >= LEAST
        if not frequent.any():
            break
        chosen = ordered[starts[frequent]]
        at, rank = places_of(keys, chosen, counts[frequent])
        at = places[at]
        run = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
        taken = (np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0
        at, rank = at[taken], rank[taken]
        pays = np.bincount(rank, minlength=len(chosen)) >= PAYS
        if not pays.any():
            break
        good = pays[rank]
        at, rank, chosen = at[good], (np.cumsum(pays) - 1)[rank[good]], chosen[pays]
        rules.append(np.stack([chosen >> wide(bits), chosen & wide((1 << bits) - 1)], axis=1).astype(np.uint32))
        if symbols.itemsize == 2 and following + len(chosen) > 1 << 16:
            symbols = symbols.astype(np.uint32)
        symbols[at] = following + rank
        following += len(chosen)
        last[at] = last[at + 1]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, last = symbols[stays], last[stays]
        at -= np.arange(len(at))  # one symbol went behind each of those before
        near = np.zeros(len(symbols), bool)
        near[at] = True
        near[np.maximum(at - 1, 0)] = True
        places = np.flatnonzero((near & ~last)[:-1])
    # a document's first symbol follows the last one before it; empty documents start where the next does
    sizes = np.diff(first_symbols)
    ends = np.concatenate(([0], np.flatnonzero(last) + 1))
    return alphabet, symbols, ends[np.concatenate(([0], np.cumsum(sizes > 0)))], rules


def joined_lengths(n: int, rules: list[np.ndarray]) -> np.ndarray:
    """Expansion lengths of n terminals and all rules; a rule's sides come from earlier rounds."""
    lengths = np.ones(n + sum(map(len, rules)), np.int64)
    for sides in rules:
        lengths[n : n + len(sides)] = lengths[sides].sum(axis=1)
        n += len(sides)
    return lengths


def pack(ids: np.ndarray, first_symbols: np.ndarray) -> bytes:
    alphabet, symbols, starts, rules = compress(ids, first_symbols)
    lengths, kind, rounds = joined_lengths(len(alphabet), rules)[len(alphabet) :], symbols.dtype, [len(r) for r in rules]
    head = np.array([len(starts) - 1, len(symbols), len(alphabet), sum(rounds), len(rounds), symbols.itemsize, len(ids)], "<i8")
    return b"".join(x.tobytes() for x in (head, starts.astype("<i8"), np.array(rounds, "<i8"), alphabet, *[r.astype(kind) for r in rules], lengths.astype("<u4"), symbols))


class Block:
    """Random access to a packed block."""

    def __init__(self, packed: bytes) -> None:
        docs, n, n_alphabet, n_rules, n_rounds, size, self.n_ids = map(int, np.frombuffer(packed, "<i8", 7))
        at = 56

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(packed, kind, n, at)
            at += out.nbytes
            return out

        self.starts, rounds = read("<i8", docs + 1), read("<i8", n_rounds)
        alphabet, self.rules = read("<u4", n_alphabet), read(f"<u{size}", 2 * n_rules).reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(n_alphabet, np.int64), read("<u4", n_rules)])
        self.symbols = read(f"<u{size}", n)
        self.place = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.empty(self.place[-1], np.uint32)
        self.flat[:n_alphabet] = alphabet
        k = 0
        for m in rounds.tolist():
            self.flat[self.place[n_alphabet + k] : self.place[n_alphabet + k + m]] = self.expand(self.rules[k : k + m].ravel())
            k += m

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        lengths = self.lengths[symbols]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.place[symbols] - (ends - lengths), lengths) + np.arange(total)]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[k] : self.starts[k + 1]])

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document starts in them (and the end)."""
        sums = np.concatenate([[0], np.cumsum(self.lengths[self.symbols])])
        return self.expand(self.symbols), sums[self.starts]


class WordEncoder:
    """Ids of whole texts by a tokenizer file whose pieces never cross white space.

    Every distinct run between white space is encoded once per Python worker and remembered as the bytes
    of its ids; so is every distinct piece (in lower case, without the commas around it) of such runs. The
    library does all of it: normalization, and merges by its model. Only the cut into pieces of runs
    of ordinary letters is made here, by the file's own pattern; other runs are cut by the library.
    Arrow cuts a batch into runs and numbers the distinct ones, so only these become Python objects, and
    the ids of all runs are gathered by number.
    """

    #: Up to here the library's letters and the pattern's here are certainly the same.
    ORDINARY = "\u024f"

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = regex.compile(r"\P{White_Space}+").findall
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"]:
            raise ValueError("the tokenizer's pieces must be a pattern's matches, as bytes")
        pattern = steps[0]["pattern"]["Regex"]
        self.cut = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        # a run of letters is one piece if the pattern takes letters, and before them only what starts with an apostrophe
        before, letters, after = f"|{pattern}|".partition(r"|[\p{L}]+|")
        self.whole = bool(letters) and all(x.startswith("'") for x in before.split("|")[1:])
        # and these marks behind them are the next piece, if digits are all that the pattern takes before signs
        self.marks = ".,;:!?" if after == r"[\p{N}]|[^\s\p{L}\p{N}]+|" else ""
        self.chars = "".join(byte_characters())
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def runs(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct runs, number of the run at each place, places where texts start, and the end)."""
        # splitting at white space also breaks at these four, which are no white space in Unicode
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            lists = pa.array([self.words(t) for t in texts.to_pylist()], pa.list_(texts.type))
        else:
            lists = pc.utf8_split_whitespace(texts)
        found = lists.values.dictionary_encode()
        return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), lists.offsets.to_numpy()

    def piece(self, piece: str) -> bytes:
        # printable ASCII stands for itself in the byte table
        mapped = piece if piece.isascii() and piece.isprintable() else charmap_decode(piece.encode("utf-8"), "strict", self.chars)[0]
        return self.ids(mapped)

    def ids(self, mapped: str) -> bytes:
        return array("I", [t.id for t in self.model.model.tokenize(mapped)]).tobytes()

    def learn(self, words: Iterable[str]) -> None:
        known, pieces, whole, marks, ordinary = self.known, self.pieces, self.whole, self.marks, self.ORDINARY
        for word in words:
            low = word.lower()
            # letters up to ORDINARY are composed as they are, and the small ones among them are the library's
            if not (word.isascii() or max(word) <= ordinary and max(low) <= ordinary):
                cut = self.model.pre_tokenizer.pre_tokenize_str(self.model.normalizer.normalize_str(word))
                known[word] = b"".join(self.ids(p) for p, _ in cut)
                continue
            stem = low.rstrip(marks)
            if whole and stem.isalpha():
                cut = (stem, low[len(stem) :]) if len(stem) < len(low) else (low,)
            else:
                cut = self.cut(low)
            for p in cut:
                if p not in pieces:
                    pieces[p] = self.piece(p)
            known[word] = pieces[cut[0]] if len(cut) == 1 else b"".join([pieces[p] for p in cut])

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > REMEMBERED_RUNS:
            self.known.clear()
        if len(self.pieces) > REMEMBERED_PIECES:
            self.pieces.clear()
        words, at, bounds = self.runs(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        parts = list(map(self.known.get, words))
        new = [k for k, part in enumerate(parts) if part is None]
        self.learn([words[k] for k in new])
        for k in new:
            parts[k] = self.known[words[k]]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts, n = np.cumsum(lengths) - lengths, lengths[at]
        before = np.concatenate(([0], np.cumsum(n)))
        ids = np.frombuffer(b"".join(parts), "<u4")[np.repeat(starts[at] - before[:-1], n) + np.arange(before[-1])]
        ends = before[bounds].tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of some TEXT_AT_ONCE bytes in the second column, a row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64)
        number = (np.cumsum(sizes) - sizes) // TEXT_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def whole_texts(column: pa.Array) -> pa.Array:
    """A text column as `texts_of` reads it, in Arrow: null is empty, bytes that are no UTF-8 become U+FFFD."""
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array(texts_of(column), column.type)
    return column.fill_null("")


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Writes (shard, block, keys, n_ids, packed) to `out`, keys ascending over shards and blocks.

    Null text has the end id only; rows with equal keys lie next to each other, ordered by text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, block = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys, parts, n = [], [], 0

        def closed() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([n], pa.int64()), pa.array([pack(np.concatenate(parts), starts)], pa.binary())],
                names=["shard", "block", "keys", "n_ids", "packed"],
            )

        end = np.array([end_id], np.uint32)
        for batch in by_bytes(batches):
            for k, ids in zip(batch.column(0).to_pylist(), encoder.encode(whole_texts(batch.column(1))), strict=True):
                keys.append(k)
                parts.append(np.concatenate([ids, end]))
                n += len(ids) + 1
                if n >= BLOCK_IDS:
                    yield closed()
                    keys, parts, n, block = [], [], 0, block + 1
        if keys:
            yield closed()

    dealt = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    dealt.mapInArrow(run, "shard long, block long, keys array<long>, n_ids long, packed binary").write.parquet(out)


def read_shards(df: DataFrame) -> DataFrame:
    """(doc_id, shard, block, start_in_block, n_tokens, ids_crc32) of every document in the blocks of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, keys, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids, starts = Block(packed).documents()
                view, n = memoryview(ids.astype("<u4").tobytes()), len(keys)
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([shard] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "shard", "block", "start_in_block", "n_tokens", "ids_crc32"],
                )

    return df.select("shard", "block", "keys", "packed").mapInArrow(run, "doc_id long, shard long, block long, start_in_block long, n_tokens long, ids_crc32 long")


def read_documents(shards: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents whose keys `wanted` names: only their blocks are read, and of these only they
    are expanded. Documents that share a key come all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, at, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                block = Block(packed)
                for k in at:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[k]], pa.int64()), pa.array([block.document(k)], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    places = shards.select("shard", "block", F.posexplode("keys").alias("at", "k"))
    chosen = places.join(wanted.select(F.col(key).cast("long").alias("k")).distinct(), "k").groupBy("shard", "block").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return shards.join(chosen, ["shard", "block"]).select("keys", "at", "packed").mapInArrow(run, "doc_id long, ids array<long>")


def block_starts(shards: DataFrame) -> DataFrame:
    """Ids before each block: sums over the few shards, then over the blocks of one shard."""
    per_shard = shards.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = per_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("shard").orderBy("block")
    return shards.select("shard", "block", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("inner")).join(before, "shard").select("shard", "block", (F.col("base") + F.col("inner")).alias("before"))


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Writes all documents' shards, reads them back: (doc_id, start, n_tokens, ids_crc32).

    Defined cases: null or empty text is the end id alone; null keys come first; repeated rows each have
    their place; an empty table writes no block and gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    out = out or scratch(spark, "token-shards")
    write_shards(docs, out, tokenizer, end_id)
    shards = spark.read.schema("shard long, block long, keys array<long>, n_ids long, packed binary").parquet(out)
    return read_shards(shards).join(block_starts(shards), ["shard", "block"]).select("doc_id", (F.col("before") + F.col("start_in_block")).alias("start"), "n_tokens", "ids_crc32")
