"""Byte-level BPE over Arrow batches.

A rank file (token bytes and ranks) becomes a `tokenizers` BPE model: bytes are mapped to printable
characters, every split of a token into two tokens becomes a merge, ordered by the token's rank. Text
is cut by the pattern; each distinct piece is encoded once per Python worker and remembered, so a
corpus costs one dictionary look-up a piece. Decoding maps ids to bytes and joins the bytes before they
are read as UTF-8, so characters that are split over several ids come back whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

#: Pieces a worker remembers before it starts anew; only speed depends on it.
REMEMBERED = 300_000
#: Rows that are Python objects at the same time.
ROWS_AT_ONCE = 200
INTS = ArrayType(IntegerType())


def byte_characters() -> list[str]:
    """A printable character for every byte: itself where it is visible Latin-1, else from U+0100 on."""
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder of one rank file; `pattern` cuts texts into pieces that merge separately."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        ranks = read_ranks(path)
        self.chars = byte_characters()
        mapped = lambda b: "".join(map(self.chars.__getitem__, b))
        merges = [
            (mapped(t[:k]), mapped(t[k:])) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        ]
        self.model = Tokenizer(BPE({mapped(t): i for t, i in ranks.items()}, merges, ignore_merges=True))
        self.to_bytes = {i: t for t, i in ranks.items()}
        # \s of the rank files' library is Unicode's White_Space, which is not Python's
        self.pieces = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.ids: dict[str, tuple[int, ...]] = {}
        self.digits: dict[str, str] = {}

    def learn(self, pieces: list[str]) -> None:
        new = list(set(pieces).difference(self.ids))
        if not new:
            return
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.digits.clear()
            new = list(set(pieces))
        for piece in new:
            # one piece at a time: a batch call wakes the library's own threads, which costs more than the merges
            got = [t.id for t in self.model.model.tokenize("".join(map(self.chars.__getitem__, piece.encode("utf-8"))))]
            self.ids[piece] = tuple(got)
            self.digits[piece] = ",".join(map(str, got))

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        self.learn(pieces)
        return list(chain.from_iterable(map(self.ids.__getitem__, pieces)))

    def encode_digits(self, text: str) -> tuple[list[int], str]:
        """The ids, and the same in decimal, joined by commas."""
        pieces = self.pieces(text)
        self.learn(pieces)
        return list(chain.from_iterable(map(self.ids.__getitem__, pieces))), ",".join(map(self.digits.__getitem__, pieces))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.to_bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        """Bytes that are no whole character (ids cut off in its middle) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def offsets(self, ids) -> list[tuple[int, int]]:
        """Code points [start, end) that each id touches; ids that share a split character share its place."""
        out, at, inside = [], 0, False
        for i in ids:
            b = self.to_bytes[i]
            starts = sum((x & 0xC0) != 0x80 for x in b)
            out.append((at - (not b or (b[0] & 0xC0) == 0x80), at + starts))
            at += starts
        return out


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null is empty, bytes that are no UTF-8 become U+FFFD."""
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [(b or b"").decode("utf-8", errors="replace") for b in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, starts, ends) per row, offsets in code points; null text encodes as no ids."""
    schema = docs.select(key).schema.add("ids", INTS).add("starts", INTS).add("ends", INTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches):
            ids = [c.encode(t) for t in texts_of(batch.column(1))]
            spans = [c.offsets(x) for x in ids]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, ints), pa.array([[a for a, _ in s] for s in spans], ints), pa.array([[b for _, b in s] for s in spans], ints)],
                names=[key, "ids", "starts", "ends"],
            )

    return docs.select(key, text).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) per row; null ids decode to the empty text."""
    schema = encoded.select(key).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text: (key, n_tokens, ids_sha256, decoded_sha256).

    Defined cases: null text is empty (no ids, digests of nothing); repeated keys give a row each;
    other columns are not read; an empty table gives an empty result.
    """
    schema = docs.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches):
            counts, digests, decoded = [], [], []
            for t in texts_of(batch.column(1)):
                ids, digits = c.encode_digits(t)
                counts.append(len(ids))
                digests.append(hashlib.sha256(digits.encode("ascii")).hexdigest())
                decoded.append(hashlib.sha256(c.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, schema)
