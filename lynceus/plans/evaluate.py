"""M2 of every frame, and of every frame under perturbed transforms, from points and edge pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import frame_metrics, neighbours, radius, sensitivity
from ..operators.noise_floor import Floor
from ..operators.projection import Rig, project

#: Frames of one variant; a frame's number under a variant is variant * FRAMES + frame.
FRAMES = 1 << 40


def edge_alignment(points: DataFrame, frames: DataFrame, pixels: DataFrame, rig: Rig, floor: Floor, min_edge_points: int = frame_metrics.MIN_EDGE_POINTS, directions: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics of each of ``frames``, errors of each edge point).

    ``points``: frame_id, point_id, x, y, z; ``pixels``: frame_id, pixel_u, pixel_v, pixel_deg, strength. Write the
    second to a table before several metrics read it.
    """
    placed = project(points, rig).select("frame_id", "point_id", "u", "v", "depth")
    edges = radius.edge_points(placed)
    errors = frame_metrics.point_errors(neighbours.match_edges(edges, pixels, directions=directions), floor)
    return frame_metrics.frame_metrics(frames, placed, errors, pixels, floor, min_edge_points), errors


def perturbed_alignment(points: DataFrame, frames: DataFrame, pixels: DataFrame, rig: Rig, floor: Floor, grid: list[tuple], min_edge_points: int = frame_metrics.MIN_EDGE_POINTS, directions: Column | None = None) -> DataFrame:
    """frame_id, variant, axis, direction, delta, mean_px (null where M2 fails), floor_px for each transform of ``grid`` and, as axis ``none``, the rig's own.

    All variants are one job: each stage is keyed by variant and frame, and the image's edge pixels are found once.
    """
    spark = points.sparkSession
    table = sensitivity.variants(spark, [("none", 1, 0.0, *map(float, rig.transform)), *grid])
    key = (F.col("variant") * FRAMES + F.col("image_id")).alias("frame_id")
    own = points.select(F.col("frame_id").cast("long").alias("image_id"), "point_id", "x", "y", "z")
    placed = sensitivity.projected_variants(own, table, rig).select(key, "image_id", "point_id", "u", "v", "depth")
    edges = radius.edge_points(placed)
    errors = frame_metrics.point_errors(neighbours.match_edges(edges, pixels, directions=directions, image="image_id"), floor)
    every = frames.select(F.col("frame_id").cast("long").alias("image_id")).join(F.broadcast(table.select("variant")), how="cross")
    drawn = pixels.groupBy("frame_id").agg(F.count("*").alias("c")).select(F.col("frame_id").cast("long").alias("image_id"))
    has = every.join(drawn, "image_id", "left_semi").select(key)  # one row stands for a frame's pixels
    metrics = frame_metrics.frame_metrics(every.select(key), placed, errors, has, floor, min_edge_points)
    out = metrics.select(F.expr(f"frame_id div {FRAMES}").alias("variant"), (F.col("frame_id") % FRAMES).alias("frame_id"), "mean_px", "floor_px")
    return out.join(F.broadcast(table.select("variant", "axis", "direction", "delta")), "variant").select("frame_id", "variant", "axis", "direction", "delta", "mean_px", "floor_px")
