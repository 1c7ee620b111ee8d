"""Sharding by histogram sort (law ``bytes``): contiguous key ranges of near-equal size.

Rows have a two-part key, (hash of the text, hash of the id and row), so copies of
a text lie side by side and a hot text can still be cut. The cuts are found by
counting: each round sums the exact bytes of the key prefixes inside the intervals
that still hold a cut, and refines them, until an interval is within the tolerance
or holds one key. Only prefix sums reach the driver, at most
(shards - 1) * 2**PROBE_BITS a round. Then every whole row is exchanged once, to the
bin of its shard that numbers its slots, and is written there by shard.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

PROBE_BITS = 12
#: A cut may be moved by this share of a shard so that it does not part copies of a text.
TOLERANCE = 0.005
#: Rows that one numbering bin should hold at most, unless BIN_LIMIT bins are in use.
BIN_ROWS = 200_000
BIN_LIMIT = 1 << 14


def _body(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _size(text: str) -> Column:
    return (F.octet_length(_body(text)) + 1).cast("long")


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Whole rows, as a struct, with their size and key."""
    uid = F.monotonically_increasing_id()
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    return docs.select(row, _size(text).alias("size"), F.xxhash64(_body(text)).alias("h"), F.xxhash64(F.col(key), uid, F.lit("row")).alias("r"))


def _prefix(bits: int) -> Column:
    """The first ``bits`` bits of the 128-bit key, as hex text of two unsigned parts (bits is a multiple of 4)."""
    h = F.lpad(F.hex("h"), 16, "0")
    return F.substring(F.concat(h, F.lpad(F.hex("r"), 16, "0")), 1, bits // 4)


def find_cuts(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[str]:
    """``shards`` - 1 key prefixes in ascending order; shard i holds the keys at or above cut i - 1 and below cut i.

    A prefix of at most 16 hex digits cuts between texts; a longer one cuts among copies of one text.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    goals = [total * i / shards for i in range(1, shards)]
    slack = total / shards * tolerance
    # For each cut: the open prefix that holds it, the bytes below that prefix, and the best boundary so far.
    state = [{"prefix": "", "below": 0, "best": None} for _ in goals]
    open_cuts, bits = set(range(len(goals))) if total else set(), 0
    while open_cuts and bits < 128:
        bits += PROBE_BITS if bits % 64 + PROBE_BITS <= 64 else 64 - bits % 64
        prefixes = sorted({state[i]["prefix"] for i in open_cuts})
        inside = keyed if prefixes == [""] else keyed.where(_prefix(len(prefixes[0]) * 4).isin(prefixes))
        counted = sorted((r["p"], r["s"]) for r in inside.groupBy(_prefix(bits).alias("p")).agg(F.sum("size").alias("s")).collect())
        for i in list(open_cuts):
            s, goal = state[i], goals[i]
            below = s["below"]
            for p, size in counted:
                if not p.startswith(s["prefix"]):
                    continue
                for at, cut in ((below, p), (below + size, None)):
                    if cut is not None and (s["best"] is None or abs(at - goal) < abs(s["best"][0] - goal)):
                        s["best"] = (at, cut)
                if below <= goal < below + size:
                    found = (p, below)
                below += size
            s["prefix"], s["below"] = found
            # A cut between texts is good enough within the slack; among copies of one text, go on to the end.
            if abs(s["best"][0] - goal) <= slack:
                open_cuts.discard(i)
    # A cut only moves up: equal or crossed cuts leave an empty shard, never a row in two.
    cuts, last = [], ""
    for s in state:
        cut = s["best"][1] if s["best"] else "G"
        last = max(last, cut.ljust(32, "0"))
        cuts.append(last)
    return cuts


def _stored(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``df`` as written in the shared folder, by ``by``; whole rows are stored with zstd, which takes less disk than snappy."""
    folder = os.path.join(shared_dir(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").partitionBy(*by).parquet(folder)
    schema = df.select(*(c for c in df.columns if c not in by), *by).schema
    return df.sparkSession.read.schema(schema).parquet(folder)


def _dealt(docs: DataFrame, shards: int, text: str, key: str) -> DataFrame:
    """row (the whole row), h, r, shard, slot; the rows cross one exchange, to the bins of their shards."""
    keyed = _stored(_keyed(docs, text, key), "keyed")
    keys = keyed.select("size", "h", "r")
    cuts = find_cuts(keys, shards)
    full = _prefix(128)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(full >= cut, 1).otherwise(0)
    n = keys.count()
    bins = min(BIN_LIMIT, max(1, -(-n // BIN_ROWS)) * 64)
    # Bins follow the second part of the key, so that copies of one text spread over them.
    place = {"shard": shard.cast("int"), "bin": F.pmod(F.col("r"), F.lit(bins)).cast("int")}
    counts = keys.withColumns(place).groupBy("shard", "bin").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("h", "r"))
    # starts has at most shards * BIN_LIMIT rows of three numbers.
    return keyed.withColumns(place).withColumn("within", within).join(F.broadcast(starts), ["shard", "bin"]).select(
        "row", "h", "r", "shard", (F.col("start") + F.col("within") - 1).cast("long").alias("slot")
    )


def _written(docs: DataFrame, shards: int, text: str, key: str) -> DataFrame:
    """As _dealt, written in one folder for each shard and read back."""
    return _stored(_dealt(docs, shards, text, key), "shards", "shard")


def shard_rows(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The whole rows of ``docs`` with shard and slot, written in one folder for each shard.

    Shards have near-equal UTF-8 bytes of text. Slots are gapless from 0 in each
    shard. Repeated rows, and rows with a null key, are rows of their own. An empty
    table gives an empty result. A column of docs named shard or slot is replaced.
    """
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return _written(docs, shards, text, key).select(*kept, "shard", "slot")


def shard_by_bytes(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, size, crc, h, r, shard, slot for each row of ``docs``, read from the rows as written in their shards.

    Size: UTF-8 bytes plus 1; null text counts as empty. Else as ``shard_rows``.
    """
    body = f"row.{text}"
    return _written(docs, shards, text, key).select(
        F.col(f"row.{key}").alias("id"), _size(body).alias("size"), F.crc32(_body(body).cast("binary")).alias("crc"), "h", "r", "shard", "slot"
    )
