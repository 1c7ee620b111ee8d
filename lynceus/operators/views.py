"""The rows behind charts: histograms, colours, sampled frames, viewing frustum, point samples, error and floor curves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import written
from . import pieces
from .noise_floor import Floor
from .projection import Rig

BINS = 40
#: Frames of a stream that one task numbers.
STREAM_FRAMES = 1_000_000


def histogram(values: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """bin, lo, hi, n of equal bins from the least to the largest finite value, the last one closed; empty bins too. Equal values make a bin of width 1 around them."""
    x = values.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    span = x.agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a is not null")
    flat = F.col("a") == F.col("b")
    span = span.select(F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    at = F.least(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("int")
    counts = x.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one-row side
    every = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, "bin", "left")
    edge = lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / bins
    return every.select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def depth_colour(depth: Column, near_m: float = 1.0, far_m: float = 50.0) -> Column:
    """0..255, cut off, from near to far."""
    return F.floor(F.least(F.greatest((depth - near_m) / (far_m - near_m), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


#: Red, green and blue of good, warning and bad.
RAMP = ((46, 160, 67), (212, 167, 44), (207, 34, 46))


def cell_colour(value: Column, good: float, warning: float, bad: float) -> Column:
    """Array of red, green, blue: between three colours, piecewise linear; null stays null."""
    lower = F.least(F.greatest((value - good) / (warning - good), F.lit(0.0)), F.lit(1.0))
    upper = F.least(F.greatest((value - warning) / (bad - warning), F.lit(0.0)), F.lit(1.0))
    mixed = [F.when(value <= warning, a + (b - a) * lower).otherwise(b + (c - b) * upper) for a, b, c in zip(*RAMP)]
    return F.when(value.isNotNull(), F.array(*[F.round(m).cast("int") for m in mixed]))


def spread_frames(frames: DataFrame, count: int, key: str = "rig") -> DataFrame:
    """At most ``count`` frames of each stream, evenly spread by frame_index and rounded, first and last among them."""
    ranked = pieces.numbered(frames, key, "frame_index", STREAM_FRAMES)
    k = F.least(F.lit(count).cast("long"), F.col("_n"))
    spots = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.bround(F.when(k > 1, i * (F.col("_n") - 1) / F.greatest(k - 1, F.lit(1))).otherwise(0.0)).cast("long"))
    return ranked.where(F.array_contains(spots, F.col("_at").cast("long"))).drop("_at", "_n")


def frames_around(frames: DataFrame, reach: int = 5, key: str = "rig") -> DataFrame:
    """Adds around: the indices of up to ``reach`` frames before and after each, itself left out, in order.

    In streams of over STREAM_FRAMES frames each frame is sent to the places that it is near, so no task holds a stream.
    """
    if pieces.longest(frames, key) <= STREAM_FRAMES:
        w = Window.partitionBy(key).orderBy("frame_index")
        ids = lambda lo, hi: F.collect_list("frame_index").over(w.rowsBetween(lo, hi))
        return frames.withColumn("around", F.concat(ids(-reach, -1), ids(1, reach)))
    at = written(pieces.numbered(frames, key, "frame_index", STREAM_FRAMES).drop("_n"))
    steps = F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1) if d]))
    sent = at.select(F.col(key).alias("_of"), F.col("_at").alias("_from"), F.col("frame_index").alias("_i"), steps.alias("_d")).withColumn("_to", F.col("_from") + F.col("_d"))
    near = sent.groupBy("_of", "_to").agg(F.transform(F.sort_array(F.collect_list(F.struct("_from", "_i"))), lambda x: x["_i"]).alias("around"))  # 2 * reach at most
    out = at.join(near, pieces.same(key, "_of") & (F.col("_at") == F.col("_to")), "left")
    return out.select(*frames.columns, F.coalesce("around", F.array()).cast(f"array<{frames.schema['frame_index'].dataType.simpleString()}>").alias("around"))


def headline_frame(frames: DataFrame, key: str = "rig") -> DataFrame:
    """The middle frame of each stream."""
    return pieces.numbered(frames, key, "frame_index", STREAM_FRAMES).where(F.col("_at") == F.floor(F.col("_n") / 2)).drop("_at", "_n")


def sampled_points(points: DataFrame, limit: int, key: str = "point_id", group: str = "frame_id") -> DataFrame:
    """At most ``limit`` points of each group, the same ones each time: those with the smallest hashes of their key.

    A task keeps the best of what it has seen of a group so far, and what tasks kept is merged: no group is sorted
    or gathered whole, only ``limit`` points a task and group are shuffled.
    """
    hashed = points.withColumn("_hash", F.xxhash64(F.col(key)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = None, 0
        for batch in batches:
            some = pa.Table.from_batches([batch])
            kept = some if kept is None else pa.concat_tables([kept, some])
            if kept.num_rows > 2 * held + SAMPLE_ROWS:
                kept = _smallest(kept, group, key, limit)
                held = kept.num_rows
                if held > MOST_ROWS:  # many groups: what is left goes on as it is
                    yield from kept.to_batches()
                    kept, held = None, 0
        if kept is not None:
            yield from _smallest(kept, group, key, limit).combine_chunks().to_batches()

    few = hashed.mapInArrow(best, hashed.schema)
    w = Window.partitionBy(group).orderBy("_hash", key)
    return few.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= limit).drop("_at", "_hash")


#: Rows that a task of ``sampled_points`` reads before it sorts out the best, and that it keeps at most.
SAMPLE_ROWS, MOST_ROWS = 50_000, 500_000


def _smallest(table: pa.Table, group: str, key: str, limit: int) -> pa.Table:
    table = table.sort_by([(group, "ascending"), ("_hash", "ascending"), (key, "ascending")])
    code = table.column(group).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = np.nonzero(np.concatenate([[True], code[1:] != code[:-1]]))[0] if len(code) else np.zeros(0, int)
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    return table.filter(pa.array(place < limit))


def view_depth(projected: DataFrame) -> DataFrame:
    """frame_id, depth_m to draw the frustum to: the upper quartile of its depths within 1..200 m."""
    return projected.groupBy("frame_id").agg(F.least(F.lit(200.0), F.greatest(F.lit(1.0), F.expr("percentile(depth, 0.75)"))).alias("depth_m"))


def frustum(depths: DataFrame, rig: Rig, fallback_m: float = 8.0) -> DataFrame:
    """frame_id, corner (0..4: apex, then top left, top right, bottom right, bottom left), x, y, z in the LiDAR's frame.

    ``depths``: frame_id, depth_m (null: ``fallback_m``).
    """
    t, z = rig.transform, F.coalesce("depth_m", F.lit(fallback_m))
    spots = [(0.0, 0.0, 0.0)] + [((u - rig.cx) / rig.fx, (v - rig.cy) / rig.fy, 1.0) for u, v in ((0, 0), (rig.width, 0), (rig.width, rig.height), (0, rig.height))]
    rows = []
    for i, spot in enumerate(spots):
        away = [spot[k] * z - float(t[4 * k + 3]) for k in range(3)]
        back = [sum((away[k] * float(t[4 * k + j]) for k in range(3)), F.lit(0.0)) for j in range(3)]
        rows.append(F.struct(F.lit(i).alias("corner"), *[b.alias(c) for b, c in zip(back, "xyz")]))
    return depths.select("frame_id", F.explode(F.array(*rows)).alias("c")).select("frame_id", "c.*")


def field_of_view(rig: Rig) -> tuple[float, float]:
    """Horizontal and vertical, in radians."""
    return 2 * math.atan(rig.width / 2 / rig.fx), 2 * math.atan(rig.height / 2 / rig.fy)


def floor_curve(points: DataFrame, floor: Floor, samples: int = 200) -> DataFrame:
    """depth_m and floor_px at ``samples`` even steps between the least and largest depth."""
    span = points.agg(F.min("depth").alias("a"), F.max("depth").alias("b")).where("a is not null")
    steps = span.select(F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i"), "a", "b")
    depth = F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (samples - 1)
    return steps.select(depth.alias("depth_m"), floor.at(depth).alias("floor_px"))


def back_in_lidar(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edge points with their LiDAR x, y, z, for a view from above; edges without a point are an error of the caller and missing here."""
    return edges.join(points.select("frame_id", "point_id", "x", "y", "z"), ["frame_id", "point_id"])


def pixel_lookup(projected: DataFrame, pixels: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Projected points with ``carry`` of the pixel they fall on (u, v cut off); points on no listed pixel have nulls.

    ``pixels``: frame_id, pixel_u, pixel_v and ``carry``, each pixel once.
    """
    spot = projected.withColumns({"pixel_u": F.floor("u").cast("long"), "pixel_v": F.floor("v").cast("long")})
    side = pixels.select("frame_id", F.col("pixel_u").cast("long").alias("pixel_u"), F.col("pixel_v").cast("long").alias("pixel_v"), *carry)
    return spot.join(side, ["frame_id", "pixel_u", "pixel_v"], "left")
