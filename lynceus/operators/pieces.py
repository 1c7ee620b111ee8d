"""Groups that are too long for one task: cut along an axis into pieces, and rows sent to the pieces within whose reach they lie."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import broadcast_within, written

#: Summaries of pieces that are broadcast.
BROADCAST_PIECES = 1_000_000


def longest(rows: DataFrame, key: str) -> int:
    """Rows of the largest group."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def cut(rows: DataFrame, key: str, at: str, size: int) -> DataFrame:
    """``rows`` as a written table, cut by key and ``at`` into pieces (column ``piece``) of about ``size`` rows; equal places stay together."""
    n = max(1, -(-rows.count() // size))
    return written(rows.repartitionByRange(n, key, at).withColumn("piece", F.spark_partition_id()))


def same(key: str, other: str) -> Column:
    return F.col(key).eqNullSafe(F.col(other))


def told(rows: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, piece and more) with what ``summary``, a written table (of, at_piece and more), says of their piece."""
    return rows.join(broadcast_within(summary, BROADCAST_PIECES), same(key, "of") & (F.col("piece") == F.col("at_piece"))).drop("of", "at_piece")


def routed(rows: DataFrame, asks: Column, answers: Column, key: str, at: str, reach: float | DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows that answer, once for each piece of their group with an asking row within ``reach`` of them at most: their columns and ``goal``.

    ``rows`` is a table of ``cut``. ``reach`` is a number, or a table (of, reach) of the groups'. With ``order``, the
    rows' ``index`` among all answering ones of their group by ``at`` and then these columns comes along. Only the pieces'
    bounds of a group meet in one task.
    """
    name = rows.schema[key].dataType.simpleString()
    place = F.col(at).cast("double")
    ends = rows.groupBy(key, "piece").agg(
        F.min(F.when(asks, place)).alias("a"), F.max(F.when(asks, place)).alias("b"), F.min(F.when(answers, place)).alias("lo"), F.max(F.when(answers, place)).alias("hi"), F.count_if(answers).alias("n")
    )
    ends = ends.withColumn("reach", F.lit(reach)) if not isinstance(reach, DataFrame) else ends.join(broadcast_within(reach, BROADCAST_PIECES), same(key, "of")).drop("of")

    def goals(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")  # pieces ascend along the axis
        a, b, lo, hi, reach = (table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("a", "b", "lo", "hi", "reach"))
        n, piece = (table.column(c).to_numpy() for c in ("n", "piece"))
        asking = np.nonzero(~np.isnan(a))[0]
        since, until = a[asking] - reach[asking], b[asking] + reach[asking]
        first, last = np.searchsorted(until, lo), np.searchsorted(since, hi, "right")
        found = [[{"goal": int(piece[p]), "since": float(s), "until": float(u)} for p, s, u in zip(asking[x:y], since[x:y], until[x:y])] if k else [] for k, x, y in zip(n.tolist(), first, last)]
        kind = pa.list_(pa.struct([("goal", pa.int32()), ("since", pa.float64()), ("until", pa.float64())]))
        return pa.table({"of": table.column(key), "at_piece": table.column("piece"), "before": pa.array(np.cumsum(n) - n), "goals": pa.array(found, kind)})

    summary = written(ends.groupBy(key).applyInArrow(goals, f"of {name}, at_piece int, before long, goals array<struct<goal:int,since:double,until:double>>"))
    out = told(rows.where(answers), summary, key)
    extra = []
    if order is not None:
        extra = ["index"]
        out = out.withColumn("index", F.col("before") + F.row_number().over(Window.partitionBy(key, "piece").orderBy(at, *order)) - 1)
    return out.withColumn("g", F.explode("goals")).where((place >= F.col("g.since")) & (place <= F.col("g.until"))).select(*rows.columns, *extra, F.col("g.goal").alias("goal"))


def numbered(rows: DataFrame, key: str, at: str, size: int) -> DataFrame:
    """Adds _at (0-based position by ``at`` in its group, equal places in any order) and _n (the group's rows).

    Groups of up to ``size`` rows are numbered in one window each; with a longer one all are cut into pieces, numbered
    there, and only the pieces' counts of a group meet.
    """
    if longest(rows, key) <= size:
        own = Window.partitionBy(key)
        return rows.withColumns({"_at": F.row_number().over(own.orderBy(at)) - 1, "_n": F.count("*").over(own)})
    parts = cut(rows, key, at, size)
    before = F.sum("c").over(Window.partitionBy("of").orderBy("at_piece").rowsBetween(Window.unboundedPreceding, -1))  # one row a piece
    ends = parts.groupBy(F.col(key).alias("of"), F.col("piece").alias("at_piece")).agg(F.count("*").alias("c"))
    ends = written(ends.select("of", "at_piece", F.coalesce(before, F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("of")).alias("_n")))
    place = F.col("before") + F.row_number().over(Window.partitionBy(key, "piece").orderBy(at)) - 1
    return told(parts, ends, key).withColumn("_at", place).select(*rows.columns, "_at", "_n")
