import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lynceus.llm import alignment

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "a", "Hello  world , it's\n\n a   test\t ", "\n lead", "über Größe naïve 日本語 テキスト 🙂 x", "a▁b no tokens", "<s> </s> <unk> <|endoftext|> <0x41>",
    "aaaa" * 300, "x" * 70 + " tail", "nul\x00 byte \x1c sep \x85  nbsp  em ​ zero", "the the the cat", "the cat", "é ́x ﬁ Ω", "word " * 3000, "123,456.78 +1 (555) foo@bar.com", "﻿bom ᠎ mark",
]


def brute(texts):
    """Whole texts through both tokenizers, groups by common ends, no graph and no memory."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {**{chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    letters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if chr(x) not in letters)}
    found, counts = [], Counter()
    for t in texts:
        links, groups, n_a, n_b = [], [], 0, 0
        if t:
            enc_a = a.encode(" " + t, add_special_tokens=False)
            parts_a = [(i, bytes(letters[c] for c in s)) for i, s in zip(enc_a.ids, enc_a.tokens)]
            parts_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
            raw = (" " + t).encode()
            if b"".join(x for _, x in parts_a) == raw == b"".join(x for _, x in parts_b):
                ends_a, ends_b = (np.cumsum([len(x) for _, x in p]).tolist() for p in (parts_a, parts_b))
                at_b = {e: i for i, e in enumerate(ends_b)}
                i0 = j0 = 0
                for i, e in enumerate(ends_a):
                    if e in at_b:
                        j = at_b[e]
                        groups.append(",".join(str(x) for x, _ in parts_a[i0 : i + 1]) + "|" + ",".join(str(x) for x, _ in parts_b[j0 : j + 1]))
                        links.append((parts_a[i][0], parts_b[j][0]))
                        i0, j0 = i + 1, j + 1
                n_a, n_b = len(parts_a), len(parts_b)
        counts.update(links)
        found.append((n_a, n_b, len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    rows = [(n_a, n_b, n, len(ln), sum(counts[x] == best[x[1]] for x in ln), sum(counts[x] for x in ln), g) for n_a, n_b, n, ln, g in found]
    return rows, counts


@pytest.mark.parametrize("memory", [200_000, 0])
def test_equals_whole_texts(spark, monkeypatch, memory):
    monkeypatch.setattr(alignment, "MEMORY_PIECES", memory)
    texts = [*TEXTS, TEXTS[4]]
    docs = spark.createDataFrame([(i if i != 5 else None, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, links string, pair int")
    run = alignment.Alignment(docs, A, B, with_groups=True)
    got = {r["doc_id"]: r for r in run.documents.collect()}
    want, counts = brute(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i if i != 5 else None]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) == w, texts[i]
        assert r["groups_sha256"] == (hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")
    assert {(r["a_id"], r["b_id"]): r["links"] for r in run.pairs.collect()} == dict(counts)


def test_components_are_groups_between_common_ends():
    rng = np.random.default_rng(1)
    for _ in range(200):
        size = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, size + 1, rng.integers(0, 40)), size)) for _ in range(2)]
        common = np.intersect1d(*ends)
        for got, own in zip(alignment.components(*ends), ends):
            assert got.tolist() == np.searchsorted(common, own).tolist()


def test_empty_table(spark):
    run = alignment.Alignment(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert run.documents.count() == 0 and run.pairs.count() == 0
