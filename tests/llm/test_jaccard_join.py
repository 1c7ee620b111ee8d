import random

import numpy as np
import pyarrow as pa
import pytest

from lynceus.llm import jaccard_join

WHITE = " \t\n\x0b\x0c\r"


def brute_force(rows, percent=80):
    """(id, set size, smallest linked id) for each row, from all pairs."""
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(" " if c in WHITE else c for c in low).split(" ")
        words = [w for w in words if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    low: dict = {}
    for i, (key, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), key), key)
    return sorted((key, len(sets[i]), low[root(i)]) for i, (key, _) in enumerate(rows))


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 5)))
    shared = [word() for _ in range(30)]
    texts = [None, "", " \n", "one two", "One TWO", "one two", "É a b c d", "é a b c d", "a b c d e f"]
    for _ in range(60):
        base = [word() for _ in range(rng.randint(5, 200))]
        if rng.random() < 0.5:
            base = base + shared
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 20))):
                copy[rng.randrange(len(copy))] = word()
            texts.append("\t".join(copy) if rng.random() < 0.2 else " ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    family = [word() for _ in range(120)]
    for _ in range(150):  # one large family
        copy = list(family)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("small", [False, True])
def test_components_equal_brute_force(spark, monkeypatch, small):
    if small:  # all paths for frequent shingles and large families
        for name, value in (("SHORT_LIST", 3), ("BLOCK_CLASSES", 10), ("PIVOTS", 2), ("FLUSH", 3000)):
            monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(4)
    got = jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_force(rows)


def test_near_dedup_keeps_one_and_takes_odd_tables(spark):
    rows = corpus(6)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, cls int")
    kept = {r["doc_id"] for r in jaccard_join.near_dedup(docs).collect()}
    assert kept == {low for _, _, low in brute_force(rows)}
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r[0] or -1, r[2] or -1) for r in jaccard_join.jaccard_components(odd).collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


@pytest.mark.parametrize("bits", [8, 26])
def test_sets_made_of_frequent_shingles(spark, monkeypatch, bits):
    """Texts put together from a few lines that all share: links that only frequent shingles show; a full table of them changes nothing."""
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 4)
    monkeypatch.setattr(jaccard_join, "ORDER_BITS", bits)
    rng = random.Random(9)
    lines = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(14)]
    texts = []
    for _ in range(50):
        some = sorted(rng.sample(range(14), rng.randint(3, 10)))
        for _ in range(3):
            texts.append(" ".join(lines[i] for i in some if rng.random() < 0.93) + (f" own{rng.randint(0, 50)}" if rng.random() < 0.5 else ""))
    rows = list(enumerate(texts))
    want = brute_force(rows)
    assert 10 < len({c for _, _, c in want}) < 130  # some link, others don't
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == want


def test_prefixes_hold_every_link():
    """Of any two sets at 0.8 the first shingles in any order meet."""
    rng = random.Random(2)
    for _ in range(300):
        x = set(rng.sample(range(400), rng.randint(1, 60)))
        y = set(x)
        for _ in range(rng.randint(0, 12)):
            y.discard(rng.choice(sorted(y))) if rng.random() < 0.5 and len(y) > 1 else y.add(rng.randrange(400))
        if 100 * len(x & y) >= 80 * len(x | y):
            order = list(range(400))
            rng.shuffle(order)
            first = lambda s: sorted(s, key=order.__getitem__)[: len(s) - (-(-80 * len(s) // 100)) + 1]
            assert set(first(x)) & set(first(y))


def test_ties_of_long_lists_stay(spark):
    """Head 1 and class 5 share too few rare shingles of short lists, but a long list ties them: both stay, so 5 and 7 meet in one family."""
    met = spark.createDataFrame([(1, 5, 1, 9), (1, 5, 0, 0), (1, 7, 0, 0), (2, 3, 4, 9), (2, 3, 5, 9), (2, 4, 8, 9), (6, 6, 3, 1)], "a long, b long, c long, need long")
    assert sorted(map(tuple, jaccard_join._enough(met).collect())) == [(1, 5), (1, 7), (2, 3)]
    token = np.array([7] * 6 + [9] * 2, np.uint64)
    cls, n = np.array([1, 2, 3, 4, 5, 6, 1, 5]), [50] * 8
    row = {"tokens": [token.tobytes()], "classes": [cls.astype(np.int64).tobytes()], "sizes": [jaccard_join._packed(np.array(n))], "rares": [jaccard_join._packed(np.array([8] * 8))]}
    out = jaccard_join._meetings(pa.table(row), 80, 4).to_pylist()
    assert {(r["a"], r["b"]) for r in out if r["need"] == 0 and r["a"] != r["b"]} == {(1, k) for k in range(2, 7)}
    assert [(r["a"], r["b"], r["c"]) for r in out if r["need"] > 0] == [(1, 5, 1)]
