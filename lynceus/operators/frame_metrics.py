"""M2 of each frame from its matched edge points, and what is said of one frame against another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .noise_floor import Floor, classify

MIN_EDGE_POINTS = 100


def point_errors(matches: DataFrame, floor: Floor) -> DataFrame:
    """frame_id, point_id, u, v, depth, matched, error_px, floor_px, normalized_error and the colour class of each edge point (``matches`` as match_edges gives them)."""
    each = floor.at(F.col("depth"))
    out = matches.select("frame_id", "point_id", "u", "v", "depth", "matched", F.col("distance_px").alias("error_px"))
    return out.withColumns({"floor_px": each, "normalized_error": F.col("error_px") / each, "classification": classify(F.col("error_px"), each)})


def frame_metrics(frames: DataFrame, projected: DataFrame, point_error: DataFrame, pixels: DataFrame, floor: Floor, min_edge_points: int = MIN_EDGE_POINTS) -> DataFrame:
    """A row for each of ``frames`` (frame_id), also those with nothing: counts, errors, depth, floor, class, match rate, spread of pixels.

    FAIL, and no errors, where nothing is projected, too few edge points are found or the image has no edges, in that order (``fail_reason``).
    Percentiles are per frame, whose points one scan bounds.
    """
    seen = projected.groupBy("frame_id").agg(F.count("*").alias("num_projected"))
    drawn = pixels.groupBy("frame_id").agg(F.count("*").alias("num_edge_pixels"))
    pick = lambda c, q: F.expr(f"percentile({c}, {q})")
    stats = point_error.groupBy("frame_id").agg(
        F.count("*").alias("num_edge_points"), F.avg("error_px").alias("mean_px"), pick("error_px", 0.5).alias("median_px"), pick("error_px", 0.95).alias("p95_px"), F.max("error_px").alias("max_px"),
        pick("depth", 0.5).alias("representative_depth_m"), F.count_if("matched").alias("num_matched"), F.avg("normalized_error").alias("mean_normalized"),
        pick("normalized_error", 0.5).alias("median_normalized"), pick("normalized_error", 0.95).alias("p95_normalized"),
        F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.sum("error_px").alias("sum_px"),
    )
    zero = F.lit(0).cast("long")
    out = frames.select("frame_id").join(seen, "frame_id", "left").join(stats, "frame_id", "left").join(drawn, "frame_id", "left")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("num_projected", "num_edge_points", "num_edge_pixels", "num_matched")})
    reason = F.when(F.col("num_projected") == 0, "nothing projected").when(F.col("num_edge_points") < min_edge_points, "too few edge points").when(F.col("num_edge_pixels") == 0, "no image edges")
    out = out.withColumn("fail_reason", reason)
    measured = ("mean_px", "median_px", "p95_px", "max_px", "representative_depth_m", "mean_normalized", "median_normalized", "p95_normalized", "u0", "u1", "v0", "v1", "sum_px")
    out = out.withColumns({c: F.when(F.col("fail_reason").isNull(), F.col(c)) for c in measured})
    out = out.withColumn("num_matched", F.when(F.col("fail_reason").isNull(), F.col("num_matched")).otherwise(zero))
    out = out.withColumns({"floor_px": floor.at(F.col("representative_depth_m")), "match_rate": F.when(F.col("fail_reason").isNull(), F.col("num_matched") / F.col("num_edge_points"))})
    return out.withColumn("classification", classify(F.col("mean_px"), F.col("floor_px")))


def without_marked(points: DataFrame, marks: DataFrame, keys: tuple[str, ...] = ("frame_id", "point_id")) -> DataFrame:
    """The points that ``marks`` (an external or motion mask: keys, is_dynamic) does not call dynamic; unmarked ones stay."""
    return points.join(marks.where("is_dynamic").select(*keys), list(keys), "left_anti")


def static_against_all(overall: DataFrame, static: DataFrame, removed: DataFrame) -> DataFrame:
    """frame_id, both means, classes and counts, contamination (1 less the share of edge points that stay; null without any) and removed points.

    ``overall`` and ``static`` are frame_metrics with and without the dynamic points; ``removed``: frame_id, removed.
    """
    part = lambda df, name: df.select("frame_id", F.col("mean_px").alias(f"{name}_mean_px"), F.col("classification").alias(f"{name}_class"), F.col("num_edge_points").alias(f"{name}_edge_points"))
    both = part(overall, "overall").join(part(static, "static"), "frame_id").join(removed.select("frame_id", "removed"), "frame_id", "left")
    share = F.when(F.col("overall_edge_points") > 0, 1 - F.col("static_edge_points") / F.col("overall_edge_points"))
    return both.withColumns({"contamination": share, "removed": F.coalesce("removed", F.lit(0).cast("long"))})
