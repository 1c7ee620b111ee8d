"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums, over the sequences of four letters that both hold in
order, the product of their decayed counts: letters inserted between the four weaken
an occurrence instead of hiding it, so ``id-iot`` and ``i d i o t`` stay like
``idiot``. Landmarks are words of the training texts. Kernel values with them, whitened
by the landmarks' own kernel matrix, are the machine's inputs; as the kernel is linear in
the counted sequences, the trained machine collapses into one weight per sequence, and
scoring a text of any length is a sum of table look-ups.

Labels belong to documents, so sentences are labelled in rounds: at first every sentence
has its document's label, then, of toxic documents, only the highest ones count. A
document scores as its highest sentence, calibrated by a logistic curve.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_slices, small_batches, text_values

#: Sequences of ORDER letters; offsets of the letters with at most INSERTED others among them, and one between each two.
ORDER = 4
INSERTED = 2
DECAY = 0.6
PATTERNS = [(0, *c) for last in range(ORDER - 1, ORDER + INSERTED) for c in combinations(range(1, last + 1), ORDER - 1) if c[-1] == last] + [(0, 2, 4, 6)]
REACH = max(p[-1] for p in PATTERNS)
BITS = 5
LANDMARKS = 128
#: Training documents of each label, chosen by a hash of the text, and the longest that trains.
TRAIN_DOCS = 1000
TRAIN_CHARS = 10_000
#: Sentences are looked at in overlapping pieces of two halves.
HALF_PIECE = 24
CHUNK_CHARS = 1 << 20
ROUNDS = 3
BROADCAST_ROWS = 1_000_000


def _symbol_table() -> np.ndarray:
    """The symbol of each code point: a-z, and fullwidth a-z like them, have their own; other letters share."""
    points = np.arange(0x33000)  # no letter lies above
    table = 27 + points % 5
    table[0x3000:] = 1 + points[0x3000:] % 31  # scripts of many letters need all symbols
    table[[not chr(p).isalpha() for p in points]] = 0
    for first in (ord("a"), 0xFF41):
        table[first : first + 26] = np.arange(1, 27)
    return table.astype(np.int32)


TABLE = _symbol_table()


def _repeats(symbols: np.ndarray) -> np.ndarray:
    """Whether each symbol lies in a word equal to the word before."""
    letter = symbols != 0
    before = np.concatenate([[False], letter[:-1]])
    begin, end = np.flatnonzero(letter & ~before), np.flatnonzero(np.append(letter[:-1] & ~letter[1:], letter[-1:]))
    if not len(begin):
        return np.zeros(len(symbols), bool)
    place = np.arange(len(symbols)) - begin[np.maximum(np.searchsorted(begin, np.arange(len(symbols)), side="right") - 1, 0)]
    powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.cumsum(np.where(letter, symbols.astype(np.uint64) * powers[np.clip(place, 0, 63)], np.uint64(0)))
    own = sums[end] - np.concatenate([[np.uint64(0)], sums])[begin]
    same = np.append(False, own[1:] == own[:-1])
    out = np.zeros(len(symbols) + 1, np.int8)
    out[begin[same]] += 1
    out[end[same] + 1] -= 1
    return np.cumsum(out[:-1]) > 0


class Characters:
    """The characters of some texts, laid end to end: symbols, the half pieces of sentences, and each one's text."""

    def __init__(self, texts: list[str]):
        pad = np.zeros(REACH, np.uint32)
        points, owner_sizes = [], []
        for t in texts:
            own = np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32)
            points += [own, pad]
            owner_sizes.append(len(own) + REACH)
        flat = np.concatenate([*points, np.empty(0, np.uint32)])
        self.symbols = np.concatenate([TABLE[np.minimum(flat, len(TABLE) - 1)], np.zeros(REACH, np.int32)])
        self.symbols[_repeats(self.symbols)] = 0  # a word right after itself adds nothing
        text_starts = np.cumsum([0, *owner_sizes])[:-1].astype(np.int64)
        # A sentence starts after a full stop and white space or a new line; it is cut into halves of pieces.
        stop = np.isin(flat, [33, 46, 63])
        starts = np.zeros(len(flat), bool)
        starts[text_starts] = True
        starts[1:] |= flat[:-1] == 10
        starts[2:] |= stop[:-2] & (flat[1:-1] == 32)
        begin = np.flatnonzero(starts)
        within = np.arange(len(flat)) - np.repeat(begin, np.diff([*begin, len(flat)]))
        self.starts = np.flatnonzero(within % HALF_PIECE == 0)
        self.lengths = np.diff([*self.starts, len(flat)])
        self.text_of = np.searchsorted(text_starts, self.starts, side="right") - 1
        # Whether a half goes on in the next one.
        self.joined = np.append(np.diff(self.text_of) == 0, False)[: len(self.starts)]
        self.size = len(flat)

    def pieces(self, halves: np.ndarray) -> np.ndarray:
        """Sums of each half and, in the same text, the next one, over the root of their length."""
        following = np.zeros_like(halves)
        following[:-1] = halves[1:]
        following[~self.joined] = 0
        length = self.lengths + np.where(self.joined, np.append(self.lengths[1:], 0), 0)
        scale = np.sqrt(length + 10.0).astype(np.float32)
        return (halves + following) / (scale[:, None] if halves.ndim == 2 else scale)

    def codes(self) -> Iterator[tuple[np.ndarray, float]]:
        """For each pattern the code of the sequence at each character, with the pattern's decay; codes with a gap symbol have no weight."""
        shifted = [self.symbols[k : k + self.size] << 0 for k in range(REACH + 1)]
        for p in PATTERNS:
            code = shifted[0]
            for k in p[1:]:
                code = (code << BITS) | shifted[k]
            yield code, DECAY ** (p[-1] - ORDER + 1)


def _no_gap() -> np.ndarray:
    code = np.arange(1 << (ORDER * BITS))
    ok = np.ones(len(code), bool)
    for i in range(ORDER):
        ok &= (code >> (i * BITS)) & ((1 << BITS) - 1) != 0
    return ok


def kernel_map(strings: list[str]) -> list[dict[int, float]]:
    """The decayed counts of each string's sequences."""
    ok, out = _no_gap(), []
    for s in strings:
        c, counts = Characters([s]), Counter()
        for code, decay in c.codes():
            for k in code[ok[code]].tolist():
                counts[k] += decay
        out.append(dict(counts))
    return out


@dataclass
class ToxicityModel:
    weights: np.ndarray  # of each sequence
    bias: float
    curve: tuple[float, float, float]  # logistic: on the highest piece, on the log of the number of pieces, constant

    def piece_scores(self, c: Characters) -> np.ndarray:
        at = np.zeros(c.size, np.float32)
        for code, decay in c.codes():
            at += self.weights[code] * np.float32(decay)
        return c.pieces(np.add.reduceat(at, c.starts)) + self.bias if c.size else np.empty(0)

    def document_features(self, c: Characters, n: int) -> np.ndarray:
        scores = self.piece_scores(c)
        firsts = np.searchsorted(c.text_of, np.arange(n))
        top = np.maximum.reduceat(scores, firsts)
        return np.column_stack([top, np.log(np.diff([*firsts, len(scores)])), np.ones(n)])

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A text of over CHUNK_CHARS characters is taken in parts, cut at white space: its highest piece and the sum of its pieces count."""
        features, some, size = [], [], 0
        owner = []
        for i, text in enumerate(texts):
            for part in _parts(text):
                owner.append(i)
                some.append(part)
                size += len(part)
                if size >= CHUNK_CHARS:
                    features.append(self.document_features(Characters(some), len(some)))
                    some, size = [], 0
        if some:
            features.append(self.document_features(Characters(some), len(some)))
        if not features:
            return np.empty(0)
        x, first = np.concatenate(features), np.searchsorted(owner, np.arange(len(texts)))
        x = np.column_stack([np.maximum.reduceat(x[:, 0], first), np.logaddexp.reduceat(x[:, 1], first), np.ones(len(texts))])
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve), -30, 30)))


def _parts(text: str) -> Iterator[str]:
    """The text in parts of at most CHUNK_CHARS characters, cut at the last blank where there is one; an empty text is one part."""
    a = 0
    while len(text) - a > CHUNK_CHARS:
        b = text.rfind(" ", a + 1, a + CHUNK_CHARS) + 1 or a + CHUNK_CHARS
        yield text[a:b]
        a = b
    yield text[a:]


def _landmarks(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Parts of words that tell the labels apart, and, for a third, words of the other texts."""
    counts, others = (Counter(), Counter()), set()
    for t, y in zip(texts, toxic):
        words = {w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split() if len(w) >= ORDER}
        counts[int(y)].update({w[i : i + k] for w in words for k in (4, 5, 6) for i in range(len(w) - k + 1)})
        others |= set() if y else words
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)

    def told(part: str) -> float:
        p1, p0 = counts[1][part] / n1, counts[0][part] / n0
        return (p1 - p0) / (p0 / n0 + p1 / n1 + 1 / n0**2) ** 0.5

    telling: list[str] = []
    for part in sorted((u for u, c in counts[1].items() if c > 2), key=lambda u: (-told(u), u)):
        if told(part) <= 0 or len(telling) == LANDMARKS * 2 // 3:
            break
        if not any(part in u for u in telling):
            telling.append(part)
    rest = sorted(others)
    return telling + [rest[i] for i in np.random.default_rng(3).permutation(len(rest))[: LANDMARKS - len(telling)]]


def _kernel(c: Characters, row_of: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel values of each piece with each landmark."""
    sentence = np.repeat(np.arange(len(c.starts)), c.lengths)
    out = np.zeros((len(c.starts), table.shape[1]), np.float32)
    for code, decay in c.codes():
        rows = row_of[code]
        hit = np.flatnonzero(rows >= 0)
        for i in range(0, len(hit), 50_000):
            some = hit[i : i + 50_000]
            own, first = np.unique(sentence[some], return_index=True)
            out[own] += np.add.reduceat(table[rows[some]], first, axis=0) * np.float32(decay)
    return c.pieces(out)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient steps. y is +1 or -1."""
    x1 = np.column_stack([x, np.ones(len(x), x.dtype)])
    weight = (weight / weight.sum()).astype(np.float32)
    v = np.ones(x1.shape[1], np.float32)
    for _ in range(20):
        v = x1.T @ (weight * (x1 @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    step, w, z = 1 / (2 * top + ridge), np.zeros(x1.shape[1], np.float32), np.zeros(x1.shape[1], np.float32)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ z))
        new = z - step * (-2 * (x1.T @ (weight * y * slack)) + ridge * z)
        z, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1]), x.T @ (y - p) - 1e-2 * w)
    return w


def fit(texts: list[str], labels: list[int]) -> ToxicityModel:
    """Trains on whole texts with labels 0 and 1; with one label only, the score is that label's share."""
    toxic = np.array(labels, bool)
    nothing = np.zeros(1 << (ORDER * BITS), np.float32)
    if toxic.all() or not toxic.any():
        return ToxicityModel(nothing, 0.0, (0.0, 0.0, 3.0 if len(toxic) and toxic.all() else -3.0))
    landmarks = _landmarks(texts, toxic)
    maps = kernel_map(landmarks)
    features = sorted({u for m in maps for u in m})
    row_of = np.full(len(nothing), -1, np.int32)
    row_of[features] = np.arange(len(features))
    table = np.zeros((len(features), len(maps)), np.float32)
    for j, m in enumerate(maps):
        norm = max(sum(v * v for v in m.values()), 1e-9) ** 0.5
        for u, v in m.items():
            table[row_of[u], j] = v / norm
    between = table.T.astype(float) @ table
    values, vectors = np.linalg.eigh(between + 1e-3 * np.eye(len(maps)))
    whiten = (vectors / np.sqrt(values)) @ vectors.T
    chunks = [Characters([t]) for t in texts]
    whiten = whiten.astype(np.float32)
    x = np.concatenate([_kernel(c, row_of, table) @ whiten for c in chunks])
    doc = np.repeat(np.arange(len(texts)), [len(c.starts) for c in chunks])
    y = np.where(toxic[doc], 1.0, -1.0).astype(np.float32)
    keep = np.ones(len(y), bool)
    first = np.searchsorted(doc, np.arange(len(texts)))
    for _ in range(ROUNDS):
        yk = y[keep]
        weight = np.where(yk > 0, 1 / max((yk > 0).sum(), 1), 1 / max((yk < 0).sum(), 1)).astype(np.float32)
        w, b = _svm(x[keep], yk, weight)
        f = x @ w + b
        top = np.maximum.reduceat(f, first)[doc]
        keep = (y < 0) | (f >= top) | (f > 0.5)  # of toxic documents the highest sentence and those like it
    weights = nothing.copy()
    weights[features] = table @ (whiten @ w)
    weights[~_no_gap()] = 0
    model = ToxicityModel(weights, b, (1.0, 0.0, 0.0))
    seen = np.concatenate([model.document_features(c, 1) for c in chunks])
    model.curve = tuple(map(float, _logistic(seen, toxic.astype(float))))
    return model


def train(docs: DataFrame, text: str = "text", label: str = "toxic", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> ToxicityModel:
    """A model from rows with non-null text and label, at most about ``train_docs`` of each label and ``train_chars`` characters long."""
    rows = docs.select(F.col(text).cast("string").alias("t"), F.col(label).cast("int").alias("y")).where((F.length("t") <= train_chars) & F.col("y").isin(0, 1))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("t"), F.lit(1 << 30))
    bounds = {y: int((1 << 30) * min(1.0, train_docs / c)) for y, c in sorted(n.items())}
    bound = F.lit(0)
    for y, b in bounds.items():
        bound = F.when(F.col("y") == y, b).otherwise(bound)
    # The largest bound asks for no label, so it is tested before the labels are joined and few texts are shuffled.
    rows = rows.where(draw < max(bounds.values(), default=0))
    # Both labels are drawn in one pass; the limit only guards against a text that many rows repeat.
    found = sorted((r["t"], r["y"]) for r in rows.where(draw < bound).limit(4 * train_docs).collect())
    return fit([t for t, _ in found], [y for _, y in found])


def _scored(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch in row_slices(batches):
        score = model.probabilities([t or "" for t in text_values(batch.column("_text"))])
        names = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, "score", "predicted"])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with score, 0 to 1, and predicted (1 from 0.5) added.

    Null counts as empty; empty and letterless texts get the score of a text without
    any sequence. Whole texts are scored, long ones too. Repeated rows score alike. An
    empty table gives an empty result. A column of docs named score or predicted is
    replaced.
    """
    small_batches(docs.sparkSession)
    own = docs.select(*(keep or [docs[c] for c in docs.columns if c not in ("score", "predicted")]), F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "_text")
    return own.mapInArrow(lambda b: _scored(b, model), f"{schema}, score double, predicted int")
