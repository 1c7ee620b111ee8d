"""Benchmark decontamination on a positional index, in DataFrame functions only.

The corpus is read once into postings (term, document, position) of all terms that
some benchmark item has, written in the shared folder; each document also leaves one
row with its number of words. A test window is searched from its rarest term: the
postings of that term, moved back by its offset, propose starts, and the postings of
the window's other terms must be there at their offsets. Phrase matches ask for the
exact offsets, proximity matches for all terms within a span, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, broadcast_if, materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows that a table may have to be broadcast.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def test_windows(benchmark: DataFrame, text: str, key: str, window: int) -> DataFrame:
    """win (the window's words, joined), terms, size, item_id: ``window`` consecutive words; a shorter item is one window."""
    items = benchmark.select(F.col(key).cast("string").alias("item_id"), words_of(F.col(text).cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    cut = items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("terms"))
    return cut.select(F.array_join("terms", " ").alias("win"), "terms", F.size("terms").alias("size"), "item_id").distinct()


def build_postings(docs: DataFrame, terms: DataFrame, text: str, key: str) -> DataFrame:
    """Postings uid, pos, term, written once. The row with null term has the document's id and, as pos, its number of words.

    uid numbers the rows of ``docs``, so repeated ids stay apart.
    """
    d = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("uid"), words_of(F.col(text).cast("string")).alias("w"))
    each = d.select("uid", "id", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    known = terms.union(terms.sparkSession.createDataFrame([("", None)], "word string, term int"))
    found = each.join(broadcast_if(known, BROADCAST_ROWS), "word")
    return materialize(found.select("uid", F.when(F.col("term").isNull(), F.col("id")).alias("id"), "pos", "term"), "postings")


class TrainingIndex:
    """The positional index of a corpus for the terms of a benchmark, and the searches on it."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
                 item_text: str = "text", item_key: str = "item_id", window: int = WINDOW):
        windows = test_windows(benchmark, item_text, item_key, window)
        self.items = materialize(windows.select("win", "item_id"), "items")
        distinct = windows.select("win", "size", F.posexplode("terms").alias("offset", "word")).distinct()
        words = distinct.select("word").distinct()
        numbered = materialize(words.select("word", F.xxhash64("word").alias("h")), "terms")
        # Terms are numbered by rank of hash; there are as many as the benchmark has words.
        spread = numbered.withColumn("b", F.pmod("h", F.lit(64)))
        terms = spread.select("word", (F.row_number().over(Window.partitionBy("b").orderBy("h", "word")) * 64 + F.col("b")).cast("int").alias("term"))
        self.terms = materialize(terms, "terms")
        self.postings = build_postings(docs, self.terms, text, key)
        self.key = key
        frequency = materialize(self.postings.where("term is not null").groupBy("term").count(), "frequency")
        placed = distinct.join(broadcast_if(self.terms, BROADCAST_ROWS), "word").join(broadcast_if(frequency, BROADCAST_ROWS), "term", "left").select("win", "size", "offset", "term", F.coalesce("count", F.lit(0)).alias("df"))
        self.placed = materialize(placed, "placed")

    def _from_rarest(self) -> DataFrame:
        """uid, win, size, pos and offset of each posting of a window's rarest term."""
        rarest = self.placed.groupBy("win").agg(F.min_by(F.struct("term", "offset", "size"), F.struct("df", "offset")).alias("r"), F.min("df").alias("df"))
        rarest = rarest.where("df > 0").select("win", "r.*")  # a window with an absent term has no occurrence
        return self.postings.where("term is not null").join(broadcast_if(rarest, BROADCAST_ROWS), "term").select("uid", "win", "size", "pos", "offset")

    def phrases(self) -> DataFrame:
        """uid, win, start, size of every exact occurrence of a window."""
        starts = self._from_rarest().select("uid", "win", "size", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
        # The second rarest terms' lists, which are short too, leave few starts for the long lists.
        rank = F.row_number().over(Window.partitionBy("win").orderBy("df", "offset"))
        placed = broadcast_if(materialize(self.placed.withColumn("rank", rank).select("win", "offset", "term", "rank"), "ranked"), BROADCAST_ROWS)
        starts = self._confirmed(materialize(starts, "starts"), placed.where("rank <= 2"), F.least(F.col("size"), F.lit(2)))
        return self._confirmed(materialize(starts, "starts"), placed, F.col("size"))

    def _confirmed(self, starts: DataFrame, placed: DataFrame, terms: Column) -> DataFrame:
        """The starts at which as many of the ``placed`` terms as ``terms`` says lie at their offsets."""
        needed = starts.join(placed, "win").select("uid", "win", "start", "size", (F.col("start") + F.col("offset")).alias("pos"), "term")
        lists = self.postings.where("term is not null").join(broadcast_if(placed.select("term").distinct(), BROADCAST_ROWS), "term", "left_semi")
        lists = lists.join(broadcast_if(starts.select("uid").distinct(), BROADCAST_ROWS), "uid", "left_semi")
        met = needed.join(lists.select("uid", "pos", "term"), ["uid", "pos", "term"])
        return met.groupBy("uid", "win", "start", "size").count().where(F.col("count") == terms).drop("count")

    def proximity(self, slop: int = 5) -> DataFrame:
        """uid, win, pos: postings of a window's rarest term with all its other terms at most size - 1 + slop words away."""
        near = materialize(self._from_rarest().select("uid", "win", "size", F.col("pos").alias("at")), "starts")
        wanted = self.placed.groupBy("win").agg(F.countDistinct("term").alias("n_terms"))
        terms = self.placed.select("win", "term").distinct()
        spots = near.join(broadcast_if(terms, BROADCAST_ROWS), "win").select(
            "uid", "win", "at", "term", F.explode(F.sequence(F.col("at") - F.col("size") + 1 - slop, F.col("at") + F.col("size") - 1 + slop)).alias("pos")
        )
        met = spots.join(self.postings.where("term is not null").select("uid", "pos", "term"), ["uid", "pos", "term"])
        full = met.groupBy("uid", "win", "at").agg(F.countDistinct("term").alias("n")).join(broadcast_if(wanted, BROADCAST_ROWS), "win")
        return full.where("n = n_terms").select("uid", "win", F.col("at").alias("pos"))

    def report(self) -> DataFrame:
        """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated."""
        hits = materialize(self.phrases(), "hits")
        inside = hits.select("uid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
        n_hit = inside.groupBy("uid").agg(F.count("*").alias("n_hit"))
        items = hits.select("uid", "win").distinct().join(broadcast_if(self.items, BROADCAST_ROWS), "win").select("uid", "item_id").distinct()
        listed = items.groupBy("uid").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("items"))
        found = broadcast_if(materialize(n_hit.join(listed, "uid"), "found"), BROADCAST_ROWS)
        rows = self.postings.where("term is null").select("uid", F.col("id").alias(self.key), F.col("pos").cast("long").alias("n_words"))
        zero = F.lit(0).cast("long")
        return rows.join(found, "uid", "left").select(
            self.key, "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
            F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        )


def contamination_report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """One row per row of ``docs``; see TrainingIndex.report.

    Words: runs of a-z (A-Z lower-cased), digits and non-ASCII characters. Null or
    wordless texts have no words and no hits; null or wordless items have no windows;
    equal windows of several items count for each of them. Repeated rows are judged
    each for itself. An empty corpus gives an empty result, an empty benchmark no
    hits. Other columns are ignored.
    """
    return TrainingIndex(docs, benchmark, **names).report()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **names) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a window, with all their columns; rows with a null key are matched by text alone."""
    body = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("\x00")).cast("binary"), 256)
    tagged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.concat_ws(":", F.col(key).cast("string"), body).alias("_tag"), F.col(text).alias("_text"))
    report = TrainingIndex(tagged, benchmark, text="_text", key="_tag", **names).report()
    bad = materialize(report.where("contaminated").select("_tag").distinct(), "contaminated")
    return tagged.join(broadcast_if(bad, BROADCAST_ROWS), "_tag", "left_anti").select("row.*")
