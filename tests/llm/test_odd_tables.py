"""Nulls, empty texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest

from lynceus.llm import decontamination, exact_dedup, language_id, quality_crf, sharding, toxicity

ROWS = [(1, None, 1), (2, "", 2), (3, "Ab É", 3), (4, "aB É", 4), (4, "aB É", 4), (5, "ab é", 5), (None, "x", 6), (6, "w " * 5000, 7)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, score long")


def test_exact_dedup(docs):
    rows = exact_dedup.duplicate_report(docs).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and by_id[1]["keep_id"] == 2 and by_id[3]["keep_id"] == 4 and by_id[3]["group_size"] == 3
    assert by_id[5]["kept"] and by_id[5]["text_sha256"] == hashlib.sha256("ab é".encode()).hexdigest()
    assert sum(r["kept"] for r in rows if r["doc_id"] == 4) == 1
    assert sorted((r["doc_id"] or 0) for r in exact_dedup.exact_dedup(docs).collect()) == [0, 2, 4, 5, 6]
    assert exact_dedup.duplicate_report(docs.limit(0)).count() == 0
    twins = docs.union(docs.selectExpr("doc_id", "text", "score + 3"))
    assert {r["doc_id"]: r["score"] for r in exact_dedup.exact_dedup(twins).collect()}[4] == 7


def test_a_full_filter_changes_no_result(spark):
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: max(j for j in range(1000) if j % 700 == i % 700) for i in range(1000)}
    for bits in (1 << 8, 1 << 28):
        got = exact_dedup.duplicate_report(docs, max_filter_bits=bits).collect()
        assert {r["doc_id"]: r["keep_id"] for r in got} == want and all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_only_repeated_texts_are_in_the_filter(spark):
    hashes = spark.range(100000).selectExpr("xxhash64(id % 99000) AS h")
    bitmaps, bits = exact_dedup.two_passes(exact_dedup.materialize(hashes, "h"), exact_dedup.MAX_FILTER_BITS)
    maybe = exact_dedup.mark_possibly_repeated(hashes, bitmaps, bits).where("maybe").count()
    assert 2000 <= maybe < 2000 + 0.02 * 98000


def test_shards_are_gapless(docs):
    rows = sharding.shard_by_bytes(docs, 3).collect()
    assert len(rows) == len(ROWS)
    for k in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))
    assert sharding.shard_by_bytes(docs.limit(0), 3).count() == 0


def test_decontamination(spark):
    docs = spark.createDataFrame([(1, "a b c D e f g h i j k", 1), (2, None, 2), (3, "x y", 3), (3, "z x, Y!", 3), (4, "c b a", 4)], "doc_id long, text string, n_hit long")
    bench = spark.createDataFrame([("i1", "b c d e f g h i j k"), ("i2", "X y"), ("i3", None), ("i4", "x y")], "item_id string, text string")
    rows = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination.contamination_report(docs, bench).collect())
    assert rows == [(1, 11, 10, 1, True), (2, 0, 0, 0, False), (3, 2, 2, 2, True), (3, 3, 2, 2, True), (4, 3, 0, 0, False)]
    assert [r["doc_id"] for r in decontamination.decontaminate(docs, bench).orderBy("doc_id").collect()] == [2, 4]
    assert not any(r["contaminated"] for r in decontamination.contamination_report(docs, bench.limit(0)).collect())
    near = decontamination.TrainingIndex(docs, spark.createDataFrame([("p", "c a")], "item_id string, text string")).proximity(slop=1).collect()
    assert len(near) == 2


def test_models_take_odd_tables(docs):
    profiles = language_id.train_profiles(docs.selectExpr("text", "'aa' AS lang"))
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict_language(docs, profiles).collect()}
    assert found[1] == found[2] == "und" and found[6] == "aa"
    for module in (toxicity, quality_crf):
        for model in (module.fit([], []), module.fit(["a good line. " * 5, "bad!! bad!! " * 5] * 4, [0, 1] * 4)):
            rows = module.score(docs, model).collect()
            assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
            assert module.score(docs.limit(0), model).count() == 0
