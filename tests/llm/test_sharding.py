from collections import Counter

from lynceus.llm import sharding


def test_whole_rows_reach_their_shards(spark):
    rows = [(i, f"text {i} " * (i % 7), i * 2) for i in range(300)] + [(5, "same", 1)] * 40 + [(None, "no id", k) for k in range(20)] + [(None, None, 3), (7, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long").repartition(5).withColumn("more", docs_more())
    got = sharding.shard_rows(docs, 4).collect()
    assert Counter((r["doc_id"], r["text"], r["more"]) for r in got) == Counter((i, t, f"m{s}") for i, t, s in rows)
    sizes = Counter()
    for k in range(4):
        own = [r for r in got if r["shard"] == k]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        sizes[k] = sum(len((r["text"] or "").encode()) + 1 for r in own)
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 4
    # The digests of shard_by_bytes are those of the rows that were moved.
    digests = sharding.shard_by_bytes(docs, 4).collect()
    assert Counter((r["id"], r["size"]) for r in digests) == Counter((i, len((t or "").encode()) + 1) for i, t, _ in rows)
    assert sharding.shard_rows(docs.limit(0), 4).count() == 0


def docs_more():
    from pyspark.sql import functions as F

    return F.concat(F.lit("m"), F.col("slot"))


def test_law_of_equal_bytes_with_hot_texts(spark):
    """A third of all rows are one text, another third have no key; shards stay within one percent of equal sizes, and gapless."""
    import random

    rng = random.Random(3)
    rows = [(i, "hot text " * 12) for i in range(2000)] + [(None, "n" * rng.randint(0, 200)) for _ in range(2000)] + [(i, "é" * rng.randint(0, 300)) for i in range(5000, 7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shard_by_bytes(docs, 8).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert len(got) == len(rows) and set(sizes) == set(range(8)) and max(abs(s - mean) for s in sizes.values()) < 0.01 * mean
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
