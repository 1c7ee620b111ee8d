"""The learned operators' inner sums against direct counts and enumeration."""

import random
from collections import Counter
from itertools import combinations, product

import numpy as np

from lynceus.llm import language_id, quality_crf, toxicity


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    per_text = np.array([1, 4, 2, 7, 1, 3])
    good, tie = rng.normal(0, 2, per_text.sum()), rng.normal(0, 1, (2, 2))
    want, pairs, begin = [], np.zeros((2, 2)), 0
    for n in per_text:
        own, weight, seen, both = good[begin : begin + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in product((0, 1), repeat=int(n)):
            w = np.exp(own @ np.array(labels) + sum(tie[a, b] for a, b in zip(labels, labels[1:])))
            weight += w
            seen += w * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                both[a, b] += w
        want += list(seen / weight)
        pairs += both / weight
        begin += n
    got, got_pairs = quality_crf.forward_backward(good, per_text, tie)
    assert np.allclose(got, want) and np.allclose(got_pairs, pairs)
    none, no_pairs = quality_crf.forward_backward(np.empty(0), np.empty(0, int), tie)
    assert not len(none) and not no_pairs.any()


def test_document_quality_is_the_length_weighted_mean_of_its_lines():
    model = quality_crf.fit(["good words here\nand more of them", "### $$$\n@@ !!"] * 10, [1, 0] * 10)
    texts = ["good words here\n$$$\nand some more of the words", "x", ""]
    x, size, per_text = quality_crf.line_features(texts)
    p, _ = quality_crf.forward_backward(quality_crf.with_neighbours(x, per_text) @ model.weights, per_text, model.tie)
    lines = [line for t in texts for line in t.split("\n")]
    owner = [i for i, t in enumerate(texts) for _ in t.split("\n")]
    for i, got in enumerate(model.qualities(texts)):
        own = [k for k in range(len(lines)) if owner[k] == i]
        assert np.isclose(got, sum(p[k] * (size[k] + 1) for k in own) / sum(size[k] + 1 for k in own), atol=1e-5)


def sequences_by_hand(s):
    """All quadruples of letters within six characters, or each second one of seven, with their decay."""
    counts = Counter()
    for places in combinations(range(len(s)), 4):
        reach = places[-1] - places[0]
        if (reach <= 5 or all(b - a == 2 for a, b in zip(places, places[1:]))) and all(s[i].isalpha() for i in places):
            code = 0
            for i in places:
                code = code * 32 + ord(s[i]) - 96
            counts[code] += 0.6 ** (reach - 3)
    return counts


def test_kernel_counts_every_gapped_sequence():
    rng = random.Random(2)
    strings = ["idiot", "i d i o t", "id-iot", "abc", ""] + ["".join(rng.choices("abcdef -.", k=30)) for _ in range(30)]
    words = [s.replace("-", " ").replace(".", " ").split() for s in strings]
    strings = [s for s, w in zip(strings, words) if not any(a == b for a, b in zip(w, w[1:]))]  # a word after itself is left out
    for s, got in zip(strings, toxicity.kernel_map(strings)):
        want = sequences_by_hand(s)
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_scores_are_the_weighted_counts_of_the_kernel():
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 1, 1 << 20).astype(np.float32)
    weights[~toxicity._no_gap()] = 0
    model = toxicity.ToxicityModel(weights, 0.25, (1.0, 0.0, 0.0))
    for s in ("you idiot", "plain words", "zzz"):  # one piece each
        want = sum(weights[k] * n for k, n in sequences_by_hand(s).items())
        padded = len(s) + toxicity.REACH
        got = model.piece_scores(toxicity.Characters([s]))
        assert len(got) == 1 and np.isclose(got[0], want / np.sqrt(padded + 10.0) + 0.25, rtol=1e-3, atol=1e-3)


def test_bundles_bind_permuted_letters():
    vectors = language_id.TripleVectors(256)
    for text in ("a", "the cat sat", "Dog,  dog... dog!", "x1y"):
        letters = [ord(c) - 96 if c.isalpha() else 0 for c in f" {text.lower()} "]
        letters = [c for i, c in enumerate(letters) if c or not i or letters[i - 1]]  # one gap between words
        want = np.zeros(256)
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            want += np.roll(vectors.letters[a], 2).astype(int) * np.roll(vectors.letters[b], 1) * vectors.letters[c]
        assert (vectors.bundle(text) == want).all()
    assert vectors.bundle("12 ...") is None
