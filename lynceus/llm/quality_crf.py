"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are measured on the line and on its two
neighbours; two more weights for each pair of labels tie a line to the one before.
Forward-backward sums give each line's probability of being good, and a document's
quality is the mean of these, weighted by the length of the lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_slices, small_batches, text_values

#: Training documents of each label, chosen by a hash of the text, and the longest that trains.
TRAIN_DOCS = 1200
TRAIN_CHARS = 20_000
CHUNK_CHARS = 1 << 20
STEPS = 150
#: Fits, and the log odds at which a line takes the other label for the next one.
ROUNDS, SURE = 2, 5.0

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _SYMBOL, _HIGH, _LINE = range(8)


def _classes() -> np.ndarray:
    kinds = np.full(256, _SYMBOL, np.uint8)
    kinds[128:] = _HIGH
    kinds[list(b"abcdefghijklmnopqrstuvwxyz")] = _LOWER
    kinds[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _UPPER
    kinds[list(b"0123456789")] = _DIGIT
    kinds[list(b" \t\r\x0b\x0c")] = _SPACE
    kinds[list(b".,;:'-")] = _STOP
    kinds[10] = _LINE
    return kinds


CLASSES = _classes()
POWER = np.uint64(0x9E3779B97F4A7C15)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, the lines' lengths in bytes, and the number of lines of each text (1 at least)."""
    raw = b"\n".join([*(t.encode("utf-8", "replace") for t in texts), b""])
    b = np.frombuffer(raw, np.uint8)
    kind = CLASSES[b]
    ends = np.flatnonzero(kind == _LINE)
    starts = np.concatenate([[0], ends[:-1] + 1])
    per_text = np.array([t.count("\n") + 1 for t in texts])
    size = (ends - starts).astype(np.float64)

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.cumsum(mask, dtype=np.int64)  # the line end itself counts for none
        return (c[ends] - np.concatenate([[0], c[ends[:-1]]])).astype(np.float64)

    blank = (kind == _SPACE) | (kind == _LINE)
    begins = ~blank
    begins[1:] &= blank[:-1]
    at = np.flatnonzero(begins)
    stop = ~blank
    stop[:-1] &= blank[1:]
    last = np.flatnonzero(stop)
    line_of = np.searchsorted(ends, at)
    words = np.bincount(line_of, minlength=len(ends)).astype(np.float64)
    # Hash of each word: a sum over its bytes times powers of an odd number, moved to the word's start.
    powers = np.cumprod(np.full(min(len(b), 64), POWER, np.uint64))
    place = np.arange(len(b)) - np.repeat(np.concatenate([[0], at]), np.diff([0, *at, len(b)]))
    terms = np.where(blank, np.uint64(0), (b.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, 63)]) if len(b) else np.empty(0, np.uint64)
    sums = np.cumsum(terms)
    word_hash = sums[last] - (sums[at] - terms[at])
    same = np.zeros(len(at), bool)
    same[1:] = (word_hash[1:] == word_hash[:-1]) & (line_of[1:] == line_of[:-1])
    repeated = np.bincount(line_of[same], minlength=len(ends))
    symbol_end = np.bincount(line_of[kind[last] == _SYMBOL], minlength=len(ends))
    capital = np.bincount(line_of[kind[at] == _UPPER], minlength=len(ends))
    lone = np.bincount(line_of[(at == last) & (kind[at] == _SYMBOL)], minlength=len(ends))
    line_hash = np.concatenate([[np.uint64(0)], sums])[ends] - np.concatenate([[np.uint64(0)], sums])[starts]
    echo = np.zeros(len(ends), bool)
    echo[1:] = (line_hash[1:] == line_hash[:-1]) & (size[1:] == size[:-1]) & (size[1:] > 0)
    s, w = np.maximum(size, 1), np.maximum(words, 1)
    columns = [
        np.log1p(size) / 8, np.log1p(words) / 6, total(kind == _LOWER) / s, total(kind == _UPPER) / s, total(kind == _DIGIT) / s,
        total(kind == _SYMBOL) / s, total(kind == _STOP) / s, total(kind == _HIGH) / s, size / w / 12, repeated / w, symbol_end / w,
        capital / w, lone / w, echo, size == 0, (total(kind == _SYMBOL) > 0),
    ]
    return np.column_stack(columns).astype(np.float32), size, per_text


def with_neighbours(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after (0 at a text's ends), and a constant."""
    first = np.cumsum(per_text) - per_text
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first] = 0
    after[first + per_text - 1] = 0
    edges = np.zeros((len(x), 2), np.float32)
    edges[first, 0] = edges[first + per_text - 1, 1] = 1
    return np.column_stack([x, before, after, edges, np.ones(len(x), np.float32)])


def _logaddexp2(m: np.ndarray) -> np.ndarray:
    return np.logaddexp(m[..., 0], m[..., 1])


def forward_backward(good: np.ndarray, per_text: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the sum over neighbouring lines of P(label, label).

    ``good``: each line's score for good against bad. Texts advance line by line together.
    """
    order = np.argsort(-per_text, kind="stable")
    first = (np.cumsum(per_text) - per_text)[order]
    n = per_text[order]
    longest = int(n[0]) if len(n) else 0
    width = np.searchsorted(-n, -np.arange(longest), side="left")  # texts with more than t lines
    emit = np.zeros((len(good), 2))
    emit[:, 1] = good
    alpha, beta, pairs = emit.copy(), np.zeros_like(emit), np.zeros((2, 2))
    for t in range(1, longest):
        at = first[: width[t]] + t
        alpha[at] += _logaddexp2(np.swapaxes(alpha[at - 1][:, :, None] + tie, 1, 2))
    for t in range(longest - 1, 0, -1):
        at = first[: width[t]] + t
        beta[at - 1] = _logaddexp2(tie + (emit[at] + beta[at])[:, None, :])
    total = _logaddexp2(alpha + beta)
    marginal = 1 / (1 + np.exp(np.clip(alpha[:, 0] + beta[:, 0] - alpha[:, 1] - beta[:, 1], -700, 700)))
    inner = np.ones(len(good), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    if len(at):
        joint = alpha[at - 1][:, :, None] + tie + (emit[at] + beta[at])[:, None, :] - total[at][:, None, None]
        pairs = np.exp(np.minimum(joint, 0)).sum(0)
    return marginal, pairs


@dataclass
class QualityModel:
    weights: np.ndarray
    tie: np.ndarray

    def qualities(self, texts: list[str]) -> np.ndarray:
        out, some, size = [], [], 0
        for text in texts:
            if len(text) > CHUNK_CHARS:
                if some:
                    out.append(self._marginals(*line_features(some)))
                    some, size = [], 0
                out.append(self._marginals(*_long_features(text)))
                continue
            some.append(text)
            size += len(text)
            if size >= CHUNK_CHARS:
                out.append(self._marginals(*line_features(some)))
                some, size = [], 0
        if some:
            out.append(self._marginals(*line_features(some)))
        return np.concatenate([*out, np.empty(0)])

    def _marginals(self, x: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        marginal, _ = forward_backward(with_neighbours(x, per_text) @ self.weights, per_text, self.tie)
        first = np.cumsum(per_text) - per_text
        return np.clip(np.add.reduceat(marginal * (size + 1), first) / np.add.reduceat(size + 1, first), 0, 1)


def _long_features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features of one text, some lines at a time; each time the line before goes along, since a line may repeat it."""
    lines, xs, sizes, a = text.split("\n"), [], [], 0
    while a < len(lines):
        b, total = a, 0
        while b < len(lines) and (b == a or total + len(lines[b]) < CHUNK_CHARS):
            total += len(lines[b])
            b += 1
        x, size, _ = line_features(["\n".join(lines[max(a - 1, 0) : b])])
        xs.append(x[min(a, 1) :])
        sizes.append(size[min(a, 1) :])
        a = b
    return np.concatenate(xs), np.concatenate(sizes), np.array([len(lines)])


def fit(texts: list[str], labels: list[int], ridge: float = 1e-3) -> QualityModel:
    """Maximum likelihood by Adam steps, each document with the same weight.

    At first every line has its document's label. Then lines that look surely otherwise by themselves take the other
    label, but for the line of each document that fits its label best, and the field is fitted again: so labels change
    within documents and the ties learn from it.
    """
    if not texts:
        return QualityModel(np.zeros(16 * 3 + 3), np.zeros((2, 2)))
    x, _, per_text = line_features(texts)
    x = with_neighbours(x, per_text).astype(np.float64)
    document = np.repeat(np.array(labels, float), per_text)
    first = np.cumsum(per_text) - per_text
    y, model = document, None
    for _ in range(ROUNDS):
        model = _fitted(x, y, per_text, ridge, model)
        own = np.where(document > 0, 1, -1) * (x @ model.weights)  # how far each line speaks for its document's label
        best = np.maximum.reduceat(own, first)
        flipped = (own < -SURE) & (own < np.repeat(best, per_text))
        y = np.where(flipped, 1 - document, document)
    return model


def _fitted(x: np.ndarray, y: np.ndarray, per_text: np.ndarray, ridge: float, start: QualityModel | None) -> QualityModel:
    each = np.repeat(1 / per_text, per_text) / len(per_text)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(per_text) - per_text] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), each[at])
    scale = float(each[at].sum()) / max(len(at), 1)
    theta = np.zeros(x.shape[1] + 4) if start is None else np.concatenate([start.weights, start.tie.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, tie = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs = forward_backward(x @ w, per_text, tie)
        gradient = np.concatenate([x.T @ (each * (y - p)), (seen - pairs * scale).ravel()]) - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return QualityModel(theta[:-4], theta[-4:].reshape(2, 2))


def train(docs: DataFrame, text: str = "text", label: str = "quality", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> QualityModel:
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


def _scored(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    for batch in row_slices(batches):
        score = model.qualities([t or "" for t in text_values(batch.column("_text"))])
        names = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, "score", "predicted"])


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with score, 0 to 1, and predicted (1 from 0.5) added.

    Null counts as empty, and an empty text is one empty line. Whole texts are scored,
    long ones too. Repeated rows score alike. An empty table gives an empty result. A
    column of docs named score or predicted is replaced.
    """
    small_batches(docs.sparkSession)
    own = docs.select(*(keep or [docs[c] for c in docs.columns if c not in ("score", "predicted")]), F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "_text")
    return own.mapInArrow(lambda b: _scored(b, model), f"{schema}, score double, predicted int")
