"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The vector of three letters is the
product of their vectors, permuted by two, one and no places; a text's vector is the
sum of the vectors of its letter triples. The profile of a language bundles the
vectors of its training texts, each at unit length, summed by Spark; a text gets the
language whose profile has the largest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_slices, small_batches

DIMENSIONS = 1024
#: Letters beyond a-z share the other symbols by code point; 0 is the gap between words.
SYMBOLS = 64
#: About so many texts of each language train its profile, drawn row by row; all of a language that has fewer.
TRAIN_TEXTS = 20_000
#: Vectors of letter triples that a task keeps.
KEPT_VECTORS = 24_000
PIECE = 1 << 20


class TripleVectors:
    """Vectors of letter triples, bound from permuted letter vectors and kept once made."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.letters = (rng.integers(0, 2, (SYMBOLS, dimensions)) * 2 - 1).astype(np.int8)
        self.first, self.second = np.roll(self.letters, 2, 1), np.roll(self.letters, 1, 1)
        self.dimensions = dimensions
        self.clear()

    def clear(self) -> None:
        self.at = np.full(SYMBOLS**3, -1, np.int32)
        self.table = np.empty((1024, self.dimensions), np.int8)
        self.used = 0

    def rows(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self.at[codes] < 0]
        if len(new):
            if self.used + len(new) > KEPT_VECTORS and self.used:
                self.clear()
                new = codes
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            a, b, c = new // SYMBOLS**2, new // SYMBOLS % SYMBOLS, new % SYMBOLS
            self.table[self.used : self.used + len(new)] = self.first[a] * self.second[b] * self.letters[c]
            self.at[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return self.table[self.at[codes]]

    def bundle(self, text: str) -> np.ndarray | None:
        """The text's vector, or None if it has no letter. Long texts are counted piece by piece."""
        counts, letters = np.zeros(SYMBOLS**3, np.int64) if len(text) > PIECE else None, False
        tail = np.zeros(1, np.int64)
        for i in range(0, len(text), PIECE):
            s = symbols(text[i : i + PIECE])
            letters = letters or bool(s.any())
            s = np.concatenate([tail, s] if i + PIECE < len(text) else [tail, s, np.zeros(1, np.int64)])
            s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one gap between words
            tail = s[-2:]
            codes = s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:]
            if counts is not None:
                counts += np.bincount(codes, minlength=SYMBOLS**3)
        if not letters:
            return None
        if counts is None:
            distinct, n = np.unique(codes, return_counts=True)
        else:
            distinct = np.flatnonzero(counts)
            n = counts[distinct]
        out = np.zeros(self.dimensions, np.float32)
        for i in range(0, len(distinct), 4096):
            out += n[i : i + 4096].astype(np.float32) @ self.rows(distinct[i : i + 4096]).astype(np.float32)
        return out


def _symbol_table() -> np.ndarray:
    points = np.arange(0x3000)
    table = 27 + points % (SYMBOLS - 27)
    table[[not chr(p).isalpha() for p in points]] = 0
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """A symbol for each character, of the lower-cased text; 0 for all but letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    low = TABLE[np.minimum(points, len(TABLE) - 1)]
    high = points >= len(TABLE)
    if high.any():
        low[high] = [27 + p % (SYMBOLS - 27) if chr(p).isalpha() else 0 for p in points[high].tolist()]
    return low


def _partial_profiles(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    vectors, sums = TripleVectors(dimensions), {}
    for batch in row_slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            v = vectors.bundle(text)
            if v is not None:
                sums[lang] = sums.get(lang, 0) + v / max(float(np.linalg.norm(v)), 1e-9)
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.astype(float)], pa.list_(pa.float64()))], ["lang", "v"])


def train_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", train_texts: int = TRAIN_TEXTS, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The profile of each language, at unit length. Rows with null text or language teach nothing; of each
    language about ``train_texts`` rows do, or all if it has fewer.

    A profile is a few kilobytes; partial sums are combined by Spark for each dimension.
    """
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    # A row is drawn by its text and place, so copies of a text are drawn each for itself.
    large = labelled.groupBy("lang").count().where(F.col("count") > train_texts)
    draw = F.pmod(F.xxhash64("text", "row"), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(large), "lang", "left")  # at most a row for every train_texts
    drawn = rows.where(F.col("count").isNull() | (draw * F.col("count") < train_texts)).select("lang", "text")
    partial = drawn.mapInArrow(lambda b: _partial_profiles(b, dimensions), "lang string, v array<double>")
    summed = partial.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    profiles: dict[str, np.ndarray] = {}
    for r in summed:
        profiles.setdefault(r["lang"], np.zeros(dimensions, np.float32))[r["i"]] = r["x"]
    return {k: v / max(float(np.linalg.norm(v)), 1e-9) for k, v in sorted(profiles.items())}


def _predicted(batches: Iterator[pa.RecordBatch], profiles: dict[str, np.ndarray], dimensions: int) -> Iterator[pa.RecordBatch]:
    names, matrix = list(profiles), np.array([*profiles.values()], np.float32).reshape(len(profiles), dimensions)
    vectors = TripleVectors(dimensions)
    for batch in row_slices(batches):
        langs, scores = [], []
        for text in batch.column("_text").to_pylist():
            v = vectors.bundle(text) if text and names else None
            if v is None:
                langs.append("und"), scores.append(0.0)
                continue
            cosines = matrix @ v / max(float(np.linalg.norm(v)), 1e-9)
            best = int(cosines.argmax())
            langs.append(names[best]), scores.append(float(min(1.0, max(0.0, cosines[best]))))
        kept = [batch.column(c) for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*(c for c in batch.schema.names if c != "_text"), "lang_pred", "score"])


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", keep: list[Column] | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """``keep`` columns (default: all) with lang_pred and score (the cosine, 0 to 1) added.

    Null, empty and letterless texts are ``und`` with score 0, as are all texts if no
    language was learned. Ties go to the language first in order. Repeated rows and
    empty tables need no care. A column of docs named lang_pred or score is replaced.
    """
    small_batches(docs.sparkSession)
    own = docs.select(*(keep or [docs[c] for c in docs.columns if c not in ("lang_pred", "score")]), F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "_text")
    return own.mapInArrow(lambda b: _predicted(b, profiles, dimensions), f"{schema}, lang_pred string, score double")
