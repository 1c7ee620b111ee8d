import hashlib
import math
import random

import numpy as np
import pytest

from lynceus.llm import vector_codes


def brute(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds in Python's integers, every part against every entry."""
    kept = [(k, [math.floor(4096 * x) for x in v], lb) for k, v, lb in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    d = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x, p: min(range(len(books[p])), key=lambda e: (d(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(cut(v, p), p) for _, v, _ in kept]
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), o in zip(kept, own) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out, by_label = {}, {}
    for k, v, lb in kept:
        codes = [near(cut(v, p), p) for p in range(parts)]
        error = sum(d(cut(v, p), books[p][c]) for p, c in enumerate(codes))
        out[k] = ("".join(f"{c:02x}" for c in codes), error, lb)
        by_label[lb] = by_label.get(lb, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    longest = (1 << 63) - 1
    return {k: (c, min(e, longest), min(by_label[lb], longest), sha) for k, (c, e, lb) in out.items()}


def rows_of(seed, n, dim, scale=1.0, grid=None):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(dim)] for _ in range(7)]
    out = []
    for k in rng.sample(range(10 * n), n):
        v = [x + rng.gauss(0, scale / 4) for x in rng.choice(centres)]
        out.append((k, [round(x * grid) / grid for x in v] if grid else v, rng.choice([None, 1, 2])))
    return out


@pytest.mark.parametrize("salted", [False, True])
@pytest.mark.parametrize("n,dim,scale,grid", [(700, 16, 1.0, None), (300, 8, 1.0, 2), (5, 16, 1.0, None), (200, 16, 1e9, None)])
def test_equals_every_part_against_every_entry(spark, monkeypatch, n, dim, scale, grid, salted):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0 if salted else 1000)
    rows = rows_of(n, n, dim, scale, grid)
    odd = [(-1, None, 1), (-2, [math.nan] * dim, 1), (-3, [None] * dim, 2), (-4, [math.inf] * dim, 2), (10**9, [1.0] * 3, 2)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.VectorCodes(table).report().collect()}
    assert got == brute(rows)


def test_only_violated_parts_are_compared_again(monkeypatch):
    rows = rows_of(3, 2000, 16)
    data = np.array([v for _, v, _ in rows])
    books = vector_codes.whole_numbers(data[:16]).reshape(16, 8, 2).transpose(1, 0, 2)
    block = vector_codes.Block(data, 8, 16)
    block.fill(books, np.zeros((8, 16)))
    seen = []
    plain = vector_codes.nearest
    monkeypatch.setattr(vector_codes, "nearest", lambda x, *rest: seen.append(len(x)) or plain(x, *rest))
    moved = books + 3
    block.update(moved, vector_codes._moved(books, moved, np.zeros((8, 16))))
    assert 0 < sum(seen) < 0.3 * 8 * len(data)
    want = np.stack([np.argmin(vector_codes.squared_distances(block.part(p, slice(None)), moved[p]), 1) for p in range(8)], 1)
    assert (block.codes() == want).all()


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert vector_codes.VectorCodes(spark.createDataFrame([], schema)).report().count() == 0
    assert vector_codes.VectorCodes(spark.createDataFrame([(1, None, "a"), (2, [math.nan], "a")], schema)).report().count() == 0
    rows = vector_codes.VectorCodes(spark.createDataFrame([(1, [], "a"), (1, [], None), (None, [], None)], schema)).report().collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in rows] == [("00" * 8, 0, 0)] * 3
    rows = vector_codes.VectorCodes(spark.createDataFrame([(1, [0.5, 3e38, 1.0], "a"), (2, [0.5, -3e38, 1.0], "a"), (2, [0.5, -3e38, 1.0], "b")], schema), entries=1).report().collect()
    assert len(rows) == 3 and all(r["error"] == (1 << 63) - 1 for r in rows)
