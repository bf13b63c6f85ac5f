"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point, so any script has vectors without a
table. A trigram binds the letters around its middle one: the products of their vectors, rotated by two, one and no
places, so that order counts. A text's vector bundles (adds) its trigrams; a language's prototype bundles all texts of
that language; a document gets the language whose prototype has the largest cosine with it.

Defined cases: a null text, and one without a letter (Unicode's L), is `und` with score 0, and so is every text where
nothing was learned. Case folds letter by letter; combining marks belong to words; all else ends a word, and a word's
ends are bound like a letter. Whole texts count, in pieces of bounded size. Equal cosines: the smallest language in
code-point order. A document without an id is not held out, and nothing is learned from it. Repeated rows count as
often as they occur. Columns of other names are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Components of a vector (a multiple of 64). The cosine of unrelated vectors is about one over the root of it.
WIDTH = 2048
#: Languages that prototypes are kept for, which go to every task: more than there are codes of languages. More is an error.
LANGUAGES = 8192
#: Code points of a piece of text, texts of a slice, and cells of a slice's table of counts.
PIECE, SLICE, CELLS = 1 << 20, 256, 1 << 23
#: Trigrams whose vectors are held at a time.
HELD = 1024
UNKNOWN = "und"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number (the splitmix64 finisher)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def letter_vectors(code_points: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A random vector of +1 and -1 for each code point; 0 is the end of a word."""
    words = mixed(mixed(code_points.astype(np.uint64))[:, None] + np.arange(width // 64, dtype=np.uint64))
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def trigram_vectors(trigrams: np.ndarray, alphabet: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams, given as numbers in base `alphabet.size`."""
    k = alphabet.size
    first, middle, last = trigrams // (k * k), trigrams // k % k, trigrams % k
    return (np.roll(vectors[first], 2, axis=1) * np.roll(vectors[middle], 1, axis=1) * vectors[last]).astype(np.float32)


def alphabet_of(code_points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded letters that occur (0, the end of a word, first), the place of each code point among them, and
    which of them are letters in the strict sense."""
    seen = np.flatnonzero(np.bincount(code_points))
    folded = np.zeros(seen.size, np.int64)
    for i, c in enumerate(seen.tolist()):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            folded[i] = ord(low) if len(low) == 1 else c
    alphabet = np.unique(np.append(folded, 0))
    place = np.zeros(int(seen[-1]) + 1 if seen.size else 1, np.int64)
    place[seen] = np.searchsorted(alphabet, folded)
    return alphabet, place, np.array([unicodedata.category(chr(c))[0] == "L" for c in alphabet.tolist()])


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in pieces of at most `size` code points, each with the code point before it and after it."""
    for low in range(0, len(text), size):
        yield (text[low - 1] if low else " ") + text[low : low + size] + (text[low + size] if low + size < len(text) else " ")


@dataclass
class Counted:
    """Trigram counts of a slice of pieces: a row each piece, a column each trigram."""

    counts: np.ndarray
    trigrams: np.ndarray
    alphabet: np.ndarray
    lettered: np.ndarray


def counted(parts: list[str]) -> Iterator[tuple[int, int, Counted]]:
    """(first, last, counts) of runs of pieces, in slices whose tables of counts are bounded."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    code_points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    alphabet, place, strict = alphabet_of(code_points)
    letters = place[code_points]
    ends = np.cumsum(lengths)
    middle = letters > 0
    middle[ends - 1] = middle[ends - lengths] = False  # the neighbours of a piece are not its own
    at = np.flatnonzero(middle)
    owner = np.repeat(np.arange(len(parts)), lengths)[at]
    k = alphabet.size
    code = (letters[at - 1] * k + letters[at]) * k + letters[at + 1]
    if k**3 <= CELLS:
        seen = np.flatnonzero(np.bincount(code, minlength=1))
        column = np.searchsorted(seen, code) if code.size < k**3 // 8 else np.cumsum(np.bincount(seen, minlength=k**3))[code] - 1
    else:
        seen, column = np.unique(code, return_inverse=True)
    lettered = np.zeros(len(parts), bool)
    lettered[owner[strict[letters[at]]]] = True
    step = max(1, CELLS // max(1, seen.size))
    for low in range(0, len(parts), step):
        high = min(low + step, len(parts))
        a, b = np.searchsorted(owner, (low, high))
        cells = np.bincount((owner[a:b] - low) * seen.size + column[a:b], minlength=(high - low) * seen.size)
        yield low, high, Counted(cells.reshape(high - low, seen.size), seen, alphabet, lettered[low:high])


def bundled(table: np.ndarray, found: Counted, width: int) -> np.ndarray:
    """Rows of counts to bundles: `table` times the trigrams' vectors. Whole numbers, so exact in any order."""
    out = np.zeros((table.shape[0], width))
    vectors = letter_vectors(found.alphabet, width)
    share = np.count_nonzero(table, axis=0)
    order = np.argsort(-share, kind="stable")
    for low in range(0, order.size, HELD):
        columns = order[low : low + HELD]
        bound = trigram_vectors(found.trigrams[columns], found.alphabet, vectors)
        part = table[:, columns].astype(np.float32)
        if share[columns].sum() * 12 > part.size:
            out += part @ bound
        else:  # rare trigrams: only those that a row has
            row, column = np.nonzero(part)
            cut = np.searchsorted(row, np.arange(part.shape[0] + 1))
            for r in np.flatnonzero(np.diff(cut)):
                own = column[cut[r] : cut[r + 1]]
                out[r] += part[r, own] @ bound[own]
    return out


def sliced(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of texts in slices of bounded size, with the place of the text that each comes from."""
    owners: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for part in pieces(text):
            if parts and (size + len(part) > PIECE or len(parts) >= SLICE):
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


def text_vectors(texts: list[str], width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(place, vector, has a letter) of each text that is not empty, in order."""
    now, vector, letter = -1, np.zeros(width), False
    for owners, parts in sliced(texts):
        for low, high, found in counted(parts):
            for i, row, has in zip(owners[low:high], bundled(found.counts, found, width), found.lettered, strict=True):
                if i != now:
                    if now >= 0:
                        yield now, vector, letter
                    now, vector, letter = i, np.zeros(width), False
                vector, letter = vector + row, letter or bool(has)
    if now >= 0:
        yield now, vector, letter


def packed(bundles: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(bundles), pa.string()), pa.array([v.astype("<i8").tobytes() for v in bundles.values()], pa.binary())], names=["lang", "bundle"])


def language_bundles(labelled: DataFrame, width: int = WIDTH) -> DataFrame:
    """(lang, bundle): one prototype a language, out of (text, lang). Each task bundles its rows, then tasks' bundles are
    added up in two steps, so no task reads more than a share of them; a language with most of the rows is one row a task."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for owners, parts in sliced(texts):
                names = sorted({langs[i] for i in owners})
                for low, high, found in counted(parts):
                    who = np.array([names.index(langs[i]) for i in owners[low:high]])
                    table = np.zeros((len(names), found.trigrams.size), np.int64)
                    np.add.at(table, who, found.counts)
                    for name, row in zip(names, bundled(table, found, width), strict=True):
                        sums[name] = sums.get(name, 0) + row.astype(np.int64)
            if len(sums) > LANGUAGES:
                yield packed(sums)
                sums = {}
        if sums:
            yield packed(sums)
        trimmed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, bundle in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + np.frombuffer(bundle, "<i8")
        if sums:
            yield packed(sums)

    schema = "lang string, bundle binary"
    parts = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(learn, schema)
    return parts.repartition(64).mapInArrow(add, schema).repartition("lang").mapInArrow(add, schema)


@dataclass(frozen=True)
class Profiles:
    """Languages in code-point order, and their prototypes, each of length one."""

    languages: list[str]
    prototypes: np.ndarray

    @property
    def width(self) -> int:
        return self.prototypes.shape[1]


def learned(labelled: DataFrame, width: int = WIDTH) -> Profiles:
    """Profiles of the languages of (text, lang); of all its rows. A language whose texts have no letters is not learned."""
    rows = language_bundles(labelled, width).limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found = {r.lang: np.frombuffer(r.bundle, "<i8").astype(np.float64) for r in rows}
    names = sorted(name for name, v in found.items() if v.any())
    vectors = np.stack([found[n] / np.linalg.norm(found[n]) for n in names]) if names else np.zeros((0, width))
    return Profiles(names, vectors)


def predicted(docs: DataFrame, profiles: Profiles, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every row, with `lang_pred` and `score`: the largest cosine, cut to 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if profiles.languages:
                for i, vector, letter in text_vectors(texts, profiles.width):
                    if letter:
                        near = profiles.prototypes @ (vector / (np.linalg.norm(vector) or 1.0))
                        near = np.round(near, 6)
                        best[i], score[i] = profiles.languages[int(near.argmax())], min(max(float(near.max()), 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(best, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])
        trimmed()

    frame = docs.select(*keep, F.col(text).alias("_text"))
    return frame.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in frame.dtypes[:-1])}, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2, width: int = WIDTH) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): languages of all documents, learned from those that are not held out.

    A document is held out if the CRC-32 of its id's text, modulo `folds`, is `held_out`. Learning reads the table
    once for (text, lang), prediction once for the text."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    profiles = learned(docs.filter(fold != held_out), width)
    marked = docs.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text")
    return predicted(marked, profiles, ["doc_id", "held_out"])
