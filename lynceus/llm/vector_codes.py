"""Vector compression by product codes, whose codebooks are learned by Lloyd's rounds on heaps.

Vectors are cut into parts; each part position has a codebook. A part is kept in the heap of its nearest entry, keyed by
its slack: the distance to the second nearest entry less the distance to its own, plus the entry's drift so far. When
entries move, only the entry's drift grows (by its own way and the longest way of any other); the parts whose key the
drift has reached are popped and compared with all entries again, exactly, all others surely keep their entry.

The heaps live in blocks of rows, which are rows of a written table: each round rewrites the blocks and sends the changes
of sums and counts alone. A heap is held as an ascending run, which is a heap: popping cuts its head, pushing merges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, small_enough

SCALE = 4096
BLOCK_ROWS = 4096
#: Components beyond count as the nearest of these.
LARGEST = 1 << 62
LONG = (1 << 63) - 1
#: Sums of more labels than these are joined by a shuffle, each label in SALTS places.
BROADCAST_LABELS = 1_000_000
SALTS = 16
#: What rounding can add to a distance, in proportion.
MARGIN = 1e-9


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(4096 x) as int64."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def squared_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries; in Python's integers where 64 bits may not hold them."""
    most = max((int(np.abs(a).max(initial=0)) for a in (x, book)))
    if 4 * most * most * max(x.shape[1], 1) >= LARGEST:
        x, book = x.astype(object), book.astype(object)
    out = np.zeros((len(x), len(book)), x.dtype)
    for c in range(x.shape[1]):
        step = x[:, c, None] - book[None, :, c]
        out += step * step
    return out


def nearest(x: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row (of equal ones the lowest) and its key: the slack, rounded down, plus that entry's drift."""
    d = squared_distances(x, book)
    own = np.argmin(d, axis=1) if len(x) else np.empty(0, np.int64)
    if len(book) == 1:
        return own, np.full(len(x), np.inf, np.float32)
    low = np.sqrt(np.sort(d, axis=1)[:, :2].astype(np.float64))
    key = low[:, 1] * (1 - MARGIN) - low[:, 0] * (1 + MARGIN) + drift[own]
    return own, np.nextafter(key.astype(np.float32), np.float32(-np.inf))


class Block:
    """Rows of one block: their values, and for each part position the heaps of its entries, one after another."""

    def __init__(self, data: np.ndarray, parts: int, entries: int, row: np.ndarray | None = None, key: np.ndarray | None = None, size: np.ndarray | None = None):
        self.data, self.parts, self.width = data, parts, data.shape[1] // parts
        self.row = np.zeros((parts, len(data)), np.uint16) if row is None else row.reshape(parts, len(data))
        self.key = np.zeros((parts, len(data)), np.float32) if key is None else key.reshape(parts, len(data))
        self.size = np.zeros((parts, entries), np.int32) if size is None else size.reshape(parts, entries)

    def part(self, p: int, rows: np.ndarray | slice) -> np.ndarray:
        return whole_numbers(self.data[rows, p * self.width : (p + 1) * self.width])

    def fill(self, books: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Puts all rows into heaps. Returns the sums and counts of each entry's parts."""
        change = np.zeros((self.parts, len(books[0]), self.width + 1), object)
        for p in range(self.parts):
            self._push(p, np.arange(len(self.data), dtype=np.uint16), np.full(len(self.data), -1), books, drift, change, [np.empty(0, np.uint16)] * len(books[0]), [np.empty(0, np.float32)] * len(books[0]))
        return change

    def update(self, books: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Pops what the drift has reached, compares it with all entries and pushes it. Returns the changes of sums and counts."""
        change = np.zeros((self.parts, len(books[0]), self.width + 1), object)
        for p in range(self.parts):
            ends = np.cumsum(self.size[p])
            popped, old, rows, keys = [], [], [], []
            for e, (a, b) in enumerate(zip((ends - self.size[p]).tolist(), ends.tolist())):
                cut = a + int(np.searchsorted(self.key[p, a:b], drift[p, e], "right"))
                popped.append(self.row[p, a:cut])
                old.append(np.full(cut - a, e))
                rows.append(self.row[p, cut:b])
                keys.append(self.key[p, cut:b])
            out = np.concatenate(popped)
            if len(out):
                self._push(p, out, np.concatenate(old), books, drift, change, rows, keys)
        return change

    def _push(self, p: int, out: np.ndarray, old: np.ndarray, books: np.ndarray, drift: np.ndarray, change: np.ndarray, rows: list, keys: list) -> None:
        x = self.part(p, out)
        own, key = nearest(x, books[p], drift[p])
        for e in range(len(books[p])):
            mine = np.flatnonzero(own == e)
            mine = mine[np.argsort(key[mine], kind="stable")]
            at = np.searchsorted(keys[e], key[mine])
            rows[e], keys[e] = np.insert(rows[e], at, out[mine]), np.insert(keys[e], at, key[mine])
            for sign, moved in ((1, x[(own == e) & (old != e)]), (-1, x[(old == e) & (own != e)])):
                if len(moved):
                    change[p, e, :-1] += sign * moved.astype(object).sum(0)
                    change[p, e, -1] += sign * len(moved)
        self.row[p], self.key[p], self.size[p] = np.concatenate(rows), np.concatenate(keys), [len(r) for r in rows]

    def codes(self) -> np.ndarray:
        """The entry of each row's parts."""
        out = np.zeros((len(self.data), self.parts), np.int64)
        for p in range(self.parts):
            out[self.row[p], p] = np.repeat(np.arange(self.size.shape[1]), self.size[p])
        return out

    def errors(self, books: np.ndarray, codes: np.ndarray) -> list[int]:
        total = np.zeros(len(self.data), object)
        for p in range(self.parts):
            step = self.part(p, slice(None)).astype(object) - books[p][codes[:, p]].astype(object)
            total += (step * step).sum(1) if self.width else 0
        return [min(int(e), LONG) for e in total]


def _row(block: Block, key: pa.Array, label: pa.Array, change: np.ndarray) -> pa.RecordBatch:
    flat = change.reshape(-1)
    moved = np.flatnonzero(flat != 0)
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([
        whole(key), whole(label), pa.array([np.ascontiguousarray(block.data).tobytes()], pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in (block.row, block.key, block.size)),
        whole(pa.array(moved, pa.int32())), whole(pa.array([str(v) for v in flat[moved]], pa.string())),
    ], ["key", "label", "data", "row", "heap", "size", "slot", "amount"])


def _first_blocks(batches: Iterator[pa.RecordBatch], parts: int, books: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    drift = np.zeros(books.shape[:2])
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            some = batch.slice(a, BLOCK_ROWS)
            values = some.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(some.num_rows, -1)
            data = np.zeros((len(values), parts * books.shape[2]), kind)
            data[:, : values.shape[1]] = values
            block = Block(data, parts, books.shape[1])
            change = block.fill(books, drift)
            yield _row(block, some.column(0), some.column(1), change)


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, books: np.ndarray, kind: str) -> Iterator[tuple[Block, pa.Array, pa.Array]]:
    for batch in batches:
        for i in range(batch.num_rows):
            key, label = (batch.column(c)[i].values for c in (0, 1))
            data = np.frombuffer(batch.column(2)[i].as_py(), kind).reshape(len(key), -1)
            row, heap, size = (np.frombuffer(batch.column(c)[i].as_py(), t).copy() for c, t in ((3, np.uint16), (4, np.float32), (5, np.int32)))
            yield Block(data, parts, books.shape[1], row, heap, size), key, label


def _next_blocks(batches: Iterator[pa.RecordBatch], parts: int, books: np.ndarray, drift: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    for block, key, label in _blocks(batches, parts, books, kind):
        change = block.update(books, drift)
        yield _row(block, key, label, change)


def _codes(batches: Iterator[pa.RecordBatch], parts: int, books: np.ndarray, drift: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    for block, key, label in _blocks(batches, parts, books, kind):
        block.update(books, drift)
        codes = block.codes()
        text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
        yield pa.RecordBatch.from_arrays([key, label, pa.array(text, pa.string()), pa.array(block.errors(books, codes), pa.int64())], ["key", "label", "code", "error"])


def _moved(old: np.ndarray, new: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """The drift after entries moved: for each its own way and the longest of the others', rounded up."""
    out = drift.copy()
    for p in range(len(old)):
        way = np.array([float(sum((int(b) - int(a)) ** 2 for a, b in zip(x, y))) ** 0.5 for x, y in zip(old[p], new[p])]) * (1 + MARGIN)
        for e in range(len(way)):
            out[p, e] += way[e] + np.delete(way, e).max(initial=0.0)
    return out * (1 + MARGIN)


class VectorCodes:
    """Codebooks learned from a table of vectors, and the vectors' codes.

    ``books``: int64 array of parts x entries x width. ``codes``: key, label, code (two hex digits a part), error (squared
    distances summed over the parts), a row for each kept one. ``report()`` adds each label's error.

    Left out are vectors that are null, hold null or non-finite components, or differ in length from that of the smallest
    kept key. A length that is no multiple of ``parts`` is filled with zeros. Components are floor(4096 x), those beyond
    2^62 count as 2^62; errors beyond a long count as the largest one. The first entries are the parts of the smallest
    keys (nulls last, equal ones by their values), fewer if there are fewer rows. An empty table gives empty results.
    Repeated rows count each for itself; null labels are one label; other columns are ignored.
    """

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6):
        if not 1 <= entries <= 256:
            raise ValueError("a code holds two hex digits a part: 1 to 256 entries")
        self.spark, self.key = vectors.sparkSession, key
        small_batches(self.spark)
        finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        kept = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(F.col(vector).isNotNull() & finite)
        first = self._smallest(kept, entries)
        length = len(first[0]) if first else 0
        kept = kept.where(F.size("vector") == length)
        if any(len(v) != length for v in first):
            first = self._smallest(kept, entries)
        double = "double" in kept.schema["vector"].dataType.simpleString()
        kind = "f8" if double else "f4"
        width = -(-length // parts)
        start = np.zeros((len(first), parts * width), np.float64)
        start[:, :length] = np.array(first, np.float64).reshape(len(first), length)
        self.books = whole_numbers(start).reshape(len(first), parts, width).transpose(1, 0, 2)
        names = {c: kept.schema[c].dataType.simpleString() for c in ("key", "label")}
        if not first:
            self.codes = kept.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
            return
        kept = kept.withColumn("vector", F.col("vector").cast("array<double>" if double else "array<float>"))
        state = f"key array<{names['key']}>, label array<{names['label']}>, data binary, row binary, heap binary, size binary, slot array<int>, amount array<string>"
        sums = np.zeros((parts, len(first), width + 1), object)
        drift = np.zeros(self.books.shape[:2])
        blocks = None
        for r in range(rounds):
            args = (parts, self.books, drift, kind)
            step = kept.mapInArrow(lambda b, args=args: _first_blocks(b, args[0], args[1], args[3]), state) if blocks is None else blocks.mapInArrow(lambda b, args=args: _next_blocks(b, *args), state)
            last, blocks = blocks, materialize(step, "heaps")
            discard(last)
            changes = blocks.select(F.explode(F.arrays_zip("slot", "amount")).alias("c")).groupBy("c.slot").agg(F.sum(F.col("c.amount").cast("decimal(38,0)")).alias("amount"))
            for slot, amount in changes.collect():  # at most parts x entries x (width + 1) rows
                sums.reshape(-1)[slot] += int(amount)
            books = self.books.copy()
            for p in range(parts):
                for e in range(len(first)):
                    if sums[p, e, -1]:
                        books[p, e] = [int(s) // int(sums[p, e, -1]) for s in sums[p, e, :-1]]
            drift, still, self.books = _moved(self.books, books, drift), (books == self.books).all(), books
            if still:
                break  # later rounds would change nothing
        args = (parts, self.books, drift, kind)
        if blocks is None:
            blocks = materialize(kept.mapInArrow(lambda b: _first_blocks(b, parts, self.books, kind), state), "heaps")
        codes = blocks.mapInArrow(lambda b: _codes(b, *args), f"key {names['key']}, label {names['label']}, code string, error long")
        self.codes = materialize(codes, "codes")
        discard(blocks)

    @staticmethod
    def _smallest(kept: DataFrame, n: int) -> list[list[float]]:
        return [r["vector"] for r in kept.orderBy(F.col("key").asc_nulls_last(), "vector").limit(n).select("vector").collect()]

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()

    def report(self) -> DataFrame:
        """key, code, error, label_error (summed over equal labels), codebooks_sha256."""
        longest = F.lit(LONG).cast("decimal(38,0)")
        total = self.codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), longest).cast("long").alias("label_error"))
        total = materialize(total.withColumnRenamed("label", "of"), "labels")
        if small_enough(total, BROADCAST_LABELS):
            joined = self.codes.join(F.broadcast(total), F.col("label").eqNullSafe(F.col("of")))
        else:
            salted = self.codes.withColumn("salt", F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)).cast("int"))
            spread = total.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = salted.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("place")))
        return joined.select(F.col("key").alias(self.key), "code", "error", "label_error", F.lit(self.digest()).alias("codebooks_sha256"))
