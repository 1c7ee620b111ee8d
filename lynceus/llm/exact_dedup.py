"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 counts how many rows fall on each slot of a filter of 2^40 slots. A row sends
one slot number, counts are combined on the map side, and the slots are ranged over
the tasks, so this filter is nowhere whole. Only the slots that more than one row
reached go on, into the Bloom filter of pass 2: bitmaps, broadcast, two slots each.
Pass 2 tests every row against them. A row that is not in the filter is certainly
unique and passes straight through; only the others, the possibly repeated ones, are
shuffled and compared exactly, by SHA-256.

The bitmaps have 16 bits for each repeated slot and at most ``max_filter_bits`` / 8
bytes, whatever the input. With more repeated texts than that suits, more unique rows
are shuffled and the result stays the same: for d repeated texts in b bits a share of
(1 - exp(-2 d / b))^2. A cluster with more room can give up to 2^32 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: 32 MB of bitmaps at most.
MAX_FILTER_BITS = 1 << 28
BITS_PER_SLOT = 16
#: Pass 1 has two to this many slots.
FIRST_FILTER_BITS = 40
#: A group with at least 1/HOT_SHARE of all rows is joined by broadcast; there can be HOT_SHARE of them at most.
HOT_SHARE = 1000


def _first_slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - FIRST_FILTER_BITS)


def _slots(slot: Column, bits: int) -> list[Column]:
    h = F.xxhash64(slot)
    return [h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1)]


def _bit(bitmap: Column, slot: Column) -> Column:
    """Whether the bitmap of ``slot``'s bucket has its bit; null bitmap: false."""
    position = F.bitmap_bit_position(slot + 1)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte.cast("bigint"), F.pmod(position, F.lit(8)).cast("int")) == 1, F.lit(False))


def repeated_slots(hashes: DataFrame) -> DataFrame:
    """slot: those of pass 1 that two or more rows of ``hashes`` (column h) reached."""
    return hashes.groupBy(_first_slot(F.col("h")).alias("slot")).count().where("count > 1").select("slot")


def bloom_filter(slots: DataFrame, bits: int) -> DataFrame:
    """Bitmaps (bucket, bitmap) of the filter that holds ``slots``; they are combined on the map side."""
    bit = slots.select(F.explode(F.array_distinct(F.array(*_slots(F.col("slot"), bits)))).alias("bit"))
    return bit.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitmap")
    )


def mark_possibly_repeated(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """``rows`` (with column h) plus boolean ``maybe``; no row moves."""
    for i, slot in enumerate(_slots(_first_slot(F.col("h")), bits), 1):
        side = bitmaps.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bitmap").alias(f"_bitmap{i}"))
        rows = rows.withColumn(f"_slot{i}", slot).join(
            F.broadcast(side), F.bitmap_bucket_number(F.col(f"_slot{i}") + 1) == F.col(f"_bucket{i}"), "left"
        )
    maybe = _bit(F.col("_bitmap1"), F.col("_slot1")) & _bit(F.col("_bitmap2"), F.col("_slot2"))
    return rows.withColumn("maybe", maybe).drop(*(f"_{x}{i}" for x in ("slot", "bucket", "bitmap") for i in (1, 2)))


def filter_bits(slots: int, max_filter_bits: int = MAX_FILTER_BITS) -> int:
    return min(max_filter_bits, 1 << max(15, (max(slots, 1) * BITS_PER_SLOT - 1).bit_length()))


def two_passes(hashes: DataFrame, max_filter_bits: int) -> tuple[DataFrame, int]:
    """The bitmaps of pass 2 for the written table ``hashes``, and their number of bits."""
    slots = materialize(repeated_slots(hashes), "slots")
    bits = filter_bits(slots.count(), max_filter_bits)
    return materialize(bloom_filter(slots, bits), "bitmaps"), bits


def _groups(maybe: DataFrame) -> DataFrame:
    """sha -> keep_id, keep_uid, ties, group_size; two levels, each combined on the map side."""
    per_id = maybe.groupBy("sha", "id").agg(F.count("*").alias("c"), F.min("uid").alias("u"))
    return per_id.groupBy("sha").agg(F.max(F.struct("id", "c", "u")).alias("top"), F.sum("c").alias("group_size")).select(
        "sha", F.col("top.id").alias("keep_id"), F.col("top.u").alias("keep_uid"), F.col("top.c").alias("ties"), "group_size"
    )


def _join_groups(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Inner join on sha. The few groups that can be large are broadcast, so no task gets a hot group."""
    hot = F.col("group_size") * HOT_SHARE >= n
    large = F.broadcast(groups.where(hot))
    return rows.join(large, "sha").unionByName(
        rows.join(F.broadcast(groups.where(hot).select("sha")), "sha", "left_anti").join(groups.where(~hot), "sha")
    )


def _digest(docs: DataFrame, text: str, key: str) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    d = docs.select(F.col(key).alias("id"), norm.alias("norm"))
    return d.select("id", F.monotonically_increasing_id().alias("uid"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64("norm").alias("h"))


def duplicate_report(docs: DataFrame, text: str = "text", key: str = "doc_id", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null text counts as empty.
    The row with the largest key stays; a null key is below all others; of rows with
    equal text and equal key exactly one stays. An empty table gives an empty result;
    other columns of ``docs`` are ignored.
    """
    d = materialize(_digest(docs, text, key), "digest")
    n = d.count()
    bitmaps, bits = two_passes(d, max_filter_bits)
    marked = mark_possibly_repeated(d, bitmaps, bits)
    maybe = marked.where("maybe")
    compared = _join_groups(maybe, _groups(maybe), n).select(
        "id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "sha"
    )
    unique = marked.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return unique.unionByName(compared).select(
        F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rules as in duplicate_report.

    Of rows with equal text and key, the one whose other columns come last as JSON stays."""
    d = materialize(_digest(docs, text, key), "digest")
    n = d.count()
    bitmaps, bits = two_passes(d, max_filter_bits)
    marked = mark_possibly_repeated(d, bitmaps, bits).where("maybe")
    groups = materialize(_groups(marked).where("group_size > 1"), "groups")
    norm = ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), norm.alias("norm"))
    row = row.select("row", F.col(f"row.{key}").alias("id"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64("norm").alias("h"))
    row = mark_possibly_repeated(row, bitmaps, bits)
    maybe = row.where("maybe").drop("maybe", "h")
    through = row.where(~F.col("maybe")).select("row")
    in_group = _join_groups(maybe, groups, n).where(F.col("id").eqNullSafe(F.col("keep_id")))
    one = in_group.where("ties = 1").select("row").union(in_group.where("ties > 1").groupBy("sha").agg(F.max_by("row", F.to_json("row")).alias("row")).select("row"))
    alone = maybe.join(groups.select("sha"), "sha", "left_anti").select("row")
    return through.union(one).union(alone).select("row.*")
