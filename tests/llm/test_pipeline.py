import pytest

import corpus_pipeline


@pytest.mark.parametrize("lang", [None, "und"])
def test_texts_with_letters_stay_where_no_language_is_known(spark, lang):
    texts = {1: "some words here", 2: None, 3: "", 4: "12 -- 34", 5: "漢字", 6: "12 é"}
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()) == [1, 5, 6]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages on a small corpus with exact and near copies, benchmark passages, nulls, ties and a hot text."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from .test_jaccard_join import brute_force

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"b{k}", prose(14)) for k in range(3)] + [("none", None), ("empty", "")]
    texts = [prose(rng.randint(1, 120)) for _ in range(40)]
    texts += [t.upper() for t in texts[:6]] + [t + " and one more" for t in texts[10:20]] + [f"{prose(30)} {items[k][1]} {prose(20)}" for k in range(3)] + [texts[0]] * 20 + [None, "", "12 34", "!!"]
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(rng.sample(texts, len(texts)))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    last: dict = {}
    for i, t in kept.items():
        last[t.lower()] = max(last.get(t.lower(), -1), i)
    kept = {i: kept[i] for i in last.values()}
    low = {i: c for i, _, c in brute_force(list(kept.items()))}
    kept = {i: t for i, t in kept.items() if low[i] == i}
    windows = {tuple(t.lower().split()[s : s + 10]) for _, t in items[:3] for s in range(5)}
    runs = lambda t: {tuple(t.lower().split()[s : s + 10]) for s in range(len(t.split()))}
    kept = {i: t for i, t in kept.items() if not runs(t) & windows}
    assert 20 < len(kept) < 60
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces: dict = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(kept)
    for i, own in pieces.items():
        own.sort(key=lambda r: r["start"])
        ids = [x for r in own for x in r["ids"]]
        assert ids == [*tokens.encode(kept[i], add_special_tokens=False).ids, 2]
        assert all(r["length"] & (r["length"] - 1) == 0 and r["doc_tokens"] == len(ids) for r in own)
