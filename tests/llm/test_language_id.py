import random

from lynceus.llm import language_id


def test_small_languages_and_hot_texts_are_learned_beside_large_ones(spark):
    rng = random.Random(1)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(8))
    rows = [(text("abcde"), "large") for _ in range(4000)] + [(text("fghij"), "small") for _ in range(3)]
    rows += [(text("klmno"), "hot")] * 1000 + [(None, "none"), ("x", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    profiles = language_id.train_profiles(docs, train_texts=50)
    assert list(profiles) == ["hot", "large", "small"]
    asked = spark.createDataFrame([(text("abcde"), "large"), (text("fghij"), "small"), (rows[4003][0], "hot")], "text string, want string")
    assert all(r["want"] == r["lang_pred"] for r in language_id.predict_language(asked, profiles).collect())
