"""Packing by power-of-two decomposition.

Each document's tokens are cut into pieces whose lengths are powers of two: as many
of the longest as fit, then one for each binary digit of the rest, longest first.
A piece is a sequence; sequences of equal length form a bucket, so training batches
need no padding and no sequence crosses documents. Work is per row: nothing is
shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back_memory, row_slices, small_batches

SEQUENCE = 4096
END_ID = 2
#: Bytes of text tokenised at once, distinct chunks remembered by a task, and the longest chunk remembered.
CHUNK_BYTES = 1 << 20
MEMORY_CHUNKS = 400_000
MEMORY_BYTES = 48
SEPARATOR = "\x01"
#: What can follow a word as a run of its own; an apostrophe can begin a contraction.
TAIL = string.punctuation.replace("'", "")
#: The byte-level alphabet: visible Latin-1 characters stand for their own byte, the other bytes for characters from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


class ChunkTokenizer:
    """Token ids of texts, the same as encoding each whole text.

    The tokenizer drops white space and never merges across it, so the ids of a text
    are those of its white-space-free chunks, one after another. Ids of chunks seen
    before are remembered; new chunks are encoded together, parted by a chunk of one
    control character whose id is known.
    """

    def __init__(self, path: str, most: int = MEMORY_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.separator = self._encode(SEPARATOR)[0]
        self.forget()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.long = False
        self.code: dict[bytes, int] = {}
        #: Ids of words and of what follows them, as four bytes each: lists of numbers would take five times the memory.
        self.parts: dict[bytes, bytes] = {}
        self.flat: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def _word(self, word: str, key: bytes) -> bytes:
        """Ids of a run of lower-case letters, straight from the merges."""
        mapped = word if word.isascii() else key.decode("latin-1").translate(BYTE_LETTERS)
        ids = self.parts[key] = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
        return ids

    def _tail(self, tail: bytes) -> bytes:
        if tail not in self.parts:
            self.parts[tail] = array("I", self._encode(tail.decode())).tobytes()
        return self.parts[tail]

    def _learn(self, chunks: list[bytes]) -> None:
        plain, odd, ids, sizes, known, n = [], [], [], [], self.parts.get, len(self.code)
        for c in chunks:
            text = c.decode()
            word = text.rstrip(TAIL)
            key = c[: len(c) - (len(text) - len(word))] if len(word) < len(text) else c  # the tail is ASCII
            own = known(key)
            if own is None and word.isalpha() and len(c) <= MEMORY_BYTES and (c.isascii() or (word == word.lower() and unicodedata.is_normalized("NFC", word))):
                own = self._word(word, key)
            if own is None or not word or "<|" in text:
                (plain if len(c) <= MEMORY_BYTES and b"\x01" not in c else odd).append(c)
                continue
            if len(word) < len(text):
                own = own + self._tail(c[len(key) :])
            self.code[c] = n
            n += 1
            ids.append(own)
            sizes.append(len(own) // 4)
        self.flat.append(np.frombuffer(b"".join(ids), np.uint32))
        self.sizes.append(np.array(sizes, np.int64))
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            found = np.array(self._encode(f" {SEPARATOR} ".join([*(c.decode() for c in some), ""])), np.uint32)
            ends = np.flatnonzero(found == self.separator)
            if len(ends) != len(some):  # a chunk gives the separator's id itself
                odd += some
                continue
            self.code.update(zip(some, range(len(self.code), len(self.code) + len(some))))
            self.flat.append(found[found != self.separator])
            self.sizes.append(np.diff(ends, prepend=-1) - 1)
        self.long = any(len(c) > MEMORY_BYTES for c in odd)
        for c in odd:
            found = np.array(self._encode(c.decode()), np.uint32)
            self.code[c] = len(self.code)
            self.flat.append(found)
            self.sizes.append(np.array([len(found)]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each."""
        if len(self.code) > self.most:
            self.forget()
        chunks: list[bytes] = []
        counts = []
        for t in texts:
            raw = t.encode()
            own = (raw if b"<|" in raw else raw.lower()).split()  # the tokenizer lower-cases; special tokens are told by case
            chunks += own
            counts.append(len(own))
        codes = np.fromiter(map(self.code.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(codes < 0).tolist()
        new = list(dict.fromkeys(chunks[i] for i in missing))
        if new:
            self._learn(new)
            codes[missing] = [self.code[chunks[i]] for i in missing]
        self.flat, self.sizes = [np.concatenate([*self.flat, np.empty(0, np.uint32)])], [np.concatenate([*self.sizes, np.empty(0, np.int64)])]
        sizes = self.sizes[0][codes]
        starts = (np.cumsum(self.sizes[0]) - self.sizes[0])[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[0][np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
        at = np.concatenate([[0], ends])[np.cumsum(counts)] if counts else np.empty(0, np.int64)
        if self.long:
            self.forget()
        return ids, np.diff(at, prepend=0)


def power_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; longest is a power of two."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    bit = longest >> 1
    while bit:
        if n - at >= bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def _groups(keys: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_BYTES:
            yield keys[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield keys[start:], texts[start:]


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, longest: int, with_ids: bool, remembered: int = MEMORY_CHUNKS) -> Iterator[pa.RecordBatch]:
    tok = ChunkTokenizer(path, remembered)
    for batch in row_slices(batches):
        for keys, texts in _groups(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids, counts = tok.encode([t or "" for t in texts])
            doc, start, length, crc, total, own = [], [], [], [], [], []
            at = 0
            for key, n in zip(keys, counts.tolist()):
                mine = np.append(ids[at : at + n], np.uint32(END_ID)).astype("<u4")
                at += n
                for s, m in power_pieces(n + 1, longest):
                    piece = mine[s : s + m]
                    doc.append(key), start.append(s), length.append(m), total.append(n + 1)
                    crc.append(zlib.crc32(piece.tobytes()))
                    if with_ids:
                        own.append(piece.astype("i4"))
            columns = [pa.array(doc, batch.column(0).type), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["key", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                flat = np.concatenate([*own, np.empty(0, "i4")])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype("i4")
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    # The tokenizer and what it remembers go first, else the worker waits for its next task with both.
    del tok
    give_back_memory()


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", longest: int = SEQUENCE, with_ids: bool = False, remembered: int = MEMORY_CHUNKS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked for.

    A null or empty text is the end id alone. Repeated rows are packed each for itself.
    A text of any length is cut whole. An empty table gives an empty result; other
    columns are ignored. sequence_id grows with the bucket: all sequences of one
    length lie together in its order. ``remembered``: distinct chunks that a task keeps in mind; it changes no result.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    pieces = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        lambda batches: piece_batches(batches, tokenizer_path, longest, with_ids, remembered), schema
    )
    bucket = F.log2("length").cast("long")
    return pieces.select(
        F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens",
        (F.shiftleft(bucket, 57) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
