"""Held-out accuracy of the learned operators on the smaller driver tables, and very long texts."""

import os

import pandas as pd
import pytest

from lynceus.llm import language_id, quality_crf, queries, toxicity

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def held_out(spark, name):
    rows = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    return rows[rows["held_out"]]


@pytest.mark.parametrize(("name", "label", "least"), [("op6_string_kernel_toxicity", "toxic", 0.9), ("op10_crf_quality", "quality", 0.95)])
def test_labels(spark, name, label, least):
    labels = pd.read_parquet(f"{DATA}/labels.parquet").groupby("doc_id", as_index=False)[label].max()
    rows = held_out(spark, name).merge(labels, on="doc_id")
    assert len(rows) > 50 and (rows["predicted"] == rows[label]).mean() >= least
    assert rows["score"].between(0, 1).all()


def test_languages(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")[["doc_id", "lang"]].dropna()
    rows = held_out(spark, "op7_hyperdimensional_language").merge(docs, on="doc_id")
    rows = rows[rows["lang"] != "und"]
    assert (rows["lang_pred"] == rows["lang"]).mean() >= 0.98


def test_very_long_texts(spark):
    good, bad = "The old mill stands by the river and turns all day.\n", "$$$ CLICK @@ HERE ### FREE!!! $$$\n"
    lines = quality_crf.fit([good * 5, bad * 5] * 20, [1, 0] * 20)
    long = good * 60_000
    assert abs(lines.qualities([long])[0] - lines.qualities([good * 500])[0]) < 0.02 and lines.qualities([bad * 60_000, ""])[0] < 0.5
    a, b = quality_crf._long_features(long), quality_crf.line_features([long])
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2].tolist() == b[2].tolist()
    words = toxicity.fit([good] * 20 + [good + "you stupid idiot"] * 20, [0] * 20 + [1] * 20)
    assert words.probabilities([long + "you stupid idiot", "x"])[0] >= words.probabilities([long, "x"])[0]
    assert "".join(toxicity._parts(long)) == long and max(map(len, toxicity._parts("y" * (3 << 20)))) <= 1 << 20
    docs = spark.createDataFrame([(1, long), (2, None), (3, good)], "doc_id long, text string")
    profiles = language_id.train_profiles(spark.createDataFrame([(good, "aa"), ("zzz qqq xxx " * 9, "bb"), (good, "cc")], "text string, lang string"))
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict_language(docs, profiles).collect()}
    assert found == {1: "aa", 2: "und", 3: "aa"}  # of equal profiles the first language
    assert {r["predicted"] for r in quality_crf.score(docs, lines).where("doc_id <> 2").collect()} == {1}
