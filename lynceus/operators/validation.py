"""Checks of inputs: rigs, streams, scans and their overlap, and the gate before the metrics. A row for each check.

Checks have rig, name, status (VALID, WARNING, INVALID) and value. All is grouped sums, so streams of any length do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values.
FEW_POINTS, BAD_SHARES, SAMPLED_FRAMES, SHORT_OVERLAP_S = 100, (0.01, 0.5), 5, 1.0
MIN_COVERAGE, MAX_OCCLUSION, MIN_POINTS = 0.30, 0.20, 500
LEVELS = ("VALID", "WARNING", "INVALID")
#: Coefficients that a lens model takes.
COEFFICIENTS = {"none": 0, "plumb_bob": 5, "fisheye_equidistant": 4}


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _check(name: str, status: Column, value: Column | None = None) -> Column:
    value = F.lit(None) if value is None else value
    return F.struct(F.lit(name).alias("name"), status.alias("status"), value.cast("double").alias("value"))


def _unless(ok: Column, level: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "VALID").otherwise(level)


def _rows(df: DataFrame, key: str, checks: list[Column]) -> DataFrame:
    return df.select(key, F.explode(F.array_compact(F.array(*checks))).alias("c")).select(key, "c.*")


def rig_checks(rigs: DataFrame, key: str = "rig") -> DataFrame:
    """``rigs``: key, fx, fy, cx, cy, width, height, lens, coefficients (map)."""
    inside = lambda c, size: _finite(F.col(c)) & (F.col(c) >= 0) & (F.col(c) <= F.col(size))
    numbers = F.map_values("coefficients")
    usual = F.element_at(F.create_map(*[F.lit(x) for item in COEFFICIENTS.items() for x in item]), F.col("lens"))
    broken = F.exists(numbers, lambda x: ~_finite(x))
    lens = F.when(F.col("lens") == "none", "VALID").when(F.col("coefficients").isNull(), "WARNING").when(broken, "INVALID").when(F.size(numbers) != usual, "WARNING").otherwise("VALID")
    return _rows(rigs, key, [
        _check("camera.fx_positive", _unless(_finite(F.col("fx")) & (F.col("fx") > 0), "INVALID"), F.col("fx")),
        _check("camera.fy_positive", _unless(_finite(F.col("fy")) & (F.col("fy") > 0), "INVALID"), F.col("fy")),
        _check("camera.cx_in_image_bounds", _unless(inside("cx", "width"), "WARNING"), F.col("cx")),
        _check("camera.cy_in_image_bounds", _unless(inside("cy", "height"), "WARNING"), F.col("cy")),
        _check("camera.image_size_valid", _unless((F.col("width") > 0) & (F.col("height") > 0), "INVALID")),
        _check("camera.distortion_params_valid", lens),
    ])


def image_shapes(images: DataFrame, rigs: DataFrame, key: str = "rig") -> DataFrame:
    """A check for each rig whether its images (key, width, height) have the declared size; value: images that have not."""
    sizes = rigs.select(key, F.col("width").alias("w"), F.col("height").alias("h"))
    off = images.join(sizes, key).groupBy(key).agg(F.count_if((F.col("width") != F.col("w")) | (F.col("height") != F.col("h"))).alias("off"))
    return _rows(off, key, [_check("camera.image_shape", _unless(F.col("off") == 0, "INVALID"), F.col("off"))])


def stream_checks(frames: DataFrame, rigs: DataFrame, sensor: str, key: str = "rig") -> DataFrame:
    """``frames``: key, position (load order), t; ``sensor`` is camera or lidar. Order is only judged where all times are finite.

    A rig without frames has one check. Each frame is compared with the one loaded before it; a stream is one rig's times.
    """
    t, before = F.col("t"), F.lag("t").over(Window.partitionBy(key).orderBy("position"))
    seen = frames.select(key, "t", before.alias("before")).groupBy(key).agg(F.count("*").alias("n"), F.count_if(~_finite(t)).alias("odd"), F.count_if(t <= F.col("before")).alias("back"))
    out = rigs.select(key).distinct().join(seen, key, "left")
    none = F.col("n").isNull()
    return _rows(out, key, [
        F.when(none, _check(f"{sensor}.frames_present", F.lit("INVALID"))),
        F.when(~none, _check(f"{sensor}.timestamps_finite", _unless(F.col("odd") == 0, "INVALID"), F.col("odd"))),
        F.when(~none & (F.col("odd") == 0), _check(f"{sensor}.timestamps_monotonic", _unless(F.col("back") == 0, "INVALID"))),
    ])


def sampled_frames(frames: DataFrame, count: int = SAMPLED_FRAMES, key: str = "rig") -> DataFrame:
    """key, frame_id of at most ``count`` frames spread over each stream, first and last among them (positions cut, not rounded)."""
    n = F.count("*").over(Window.partitionBy(key))
    ranked = frames.select(key, "frame_id", (F.row_number().over(Window.partitionBy(key).orderBy("position")) - 1).alias("at"), n.alias("n"))
    k = F.least(F.lit(count), F.col("n"))
    spots = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(F.when(k > 1, i * (F.col("n") - 1) / F.greatest(k - 1, F.lit(1))).otherwise(0)).cast("int"))
    return ranked.where(F.array_contains(spots, F.col("at"))).select(key, "frame_id")


def scan_checks(sampled: DataFrame, points: DataFrame, min_range_m: float = 0.0, max_range_m: float = 200.0, key: str = "rig") -> DataFrame:
    """Checks of the points (key, frame_id, x, y, z) of the ``sampled`` frames; frames without points are empty ones."""
    whole = _finite(F.col("x")) & _finite(F.col("y")) & _finite(F.col("z"))
    far = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    mine = points.join(F.broadcast(sampled.select(key, "frame_id")), [key, "frame_id"], "left_semi")  # SAMPLED_FRAMES rows a rig
    each = mine.groupBy(key, "frame_id").agg(F.count("*").alias("n"), F.count_if(whole).alias("good"), F.count_if(whole & far.between(min_range_m, max_range_m)).alias("near"))
    each = sampled.join(each, [key, "frame_id"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "good", "near")})
    lost = F.when(F.col("n") > 0, 1 - F.col("good") / F.col("n"))
    rig = each.groupBy(key).agg(
        F.count_if(F.col("n") == 0).alias("empty"), F.count_if((F.col("n") > 0) & (F.col("n") < FEW_POINTS)).alias("sparse"), F.count_if(lost >= BAD_SHARES[1]).alias("severe"),
        F.count_if((lost >= BAD_SHARES[0]) & (lost < BAD_SHARES[1])).alias("flagged"), F.count_if((F.col("good") > 0) & (F.col("near") < 0.5 * F.col("good"))).alias("outside"),
    )
    finite = F.when(F.col("severe") > 0, "INVALID").when(F.col("flagged") > 0, "WARNING").otherwise("VALID")
    count = lambda c: F.when(F.col(c) > 0, F.col(c))
    return _rows(rig, key, [
        _check("lidar.point_count_nonzero", _unless(F.col("empty") == 0, "INVALID"), count("empty")),
        F.when(F.col("sparse") > 0, _check("lidar.point_count_sufficient", F.lit("WARNING"), F.col("sparse"))),
        _check("lidar.xyz_finite", finite, F.coalesce(count("severe"), count("flagged"))),
        _check("lidar.range_within_sensor_spec", _unless(F.col("outside") == 0, "WARNING"), count("outside")),
    ])


def overlap_checks(camera: DataFrame, lidar: DataFrame, rigs: DataFrame, key: str = "rig") -> DataFrame:
    """Whether both streams (key, t) have frames and how long they run together."""
    span = lambda df, p: df.groupBy(key).agg(F.count("*").alias(f"{p}n"), F.count_if(~_finite(F.col("t"))).alias(f"{p}odd"), F.min("t").alias(f"{p}lo"), F.max("t").alias(f"{p}hi"))
    both = rigs.select(key).distinct().join(span(camera, "c"), key, "left").join(span(lidar, "l"), key, "left")
    there, finite = F.col("cn").isNotNull() & F.col("ln").isNotNull(), (F.col("codd") == 0) & (F.col("lodd") == 0)
    length = F.greatest(F.lit(0.0), F.least("chi", "lhi") - F.greatest("clo", "llo"))
    status = F.when(~finite | (length <= 0), "INVALID").when(length < SHORT_OVERLAP_S, "WARNING").otherwise("VALID")
    return _rows(both, key, [
        _check("dataset.frame_counts_nonzero", _unless(there, "INVALID")),
        F.when(there, _check("dataset.overlap_duration", status, F.when(finite & (length > 0), length))),
    ])


def combined(checks: DataFrame, key: str = "rig", raise_on_invalid: bool = False) -> DataFrame:
    """key, status (the worst), counts and the names of what is not valid (reasons, sorted)."""
    level = F.when(F.col("status") == "VALID", 0).when(F.col("status") == "WARNING", 1).otherwise(2)
    out = checks.groupBy(key).agg(
        F.max(level).alias("level"), F.count("*").alias("checks"), F.count_if(level == 1).alias("warnings"), F.count_if(level == 2).alias("invalid"),
        F.sort_array(F.collect_list(F.when(level > 0, F.col("name")))).alias("reasons"),
    )
    if raise_on_invalid:
        wrong = F.concat(F.lit("input invalid: "), F.array_join("reasons", ", "))
        out = out.withColumn("level", F.when(F.col("level") == 2, F.raise_error(wrong).cast("int")).otherwise(F.col("level")))
    return out.select(key, F.element_at(F.array(*[F.lit(f"INPUT_{x}") for x in LEVELS]), F.col("level") + 1).alias("status"), "checks", "warnings", "invalid", "reasons")


def sanity_gate(points: DataFrame, occluded: DataFrame, min_range_m: float = 0.0, max_range_m: float = 200.0, min_coverage: float = MIN_COVERAGE, min_points: int = MIN_POINTS) -> DataFrame:
    """frame_id, name, passed, value: four checks of each frame of ``points`` (frame_id, x, y, z).

    ``occluded``: frame_id, n (points in the image) and ratio, as scans.occlusion gives.
    """
    whole = _finite(F.col("x")) & _finite(F.col("y")) & _finite(F.col("z"))
    far = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    frame = points.groupBy("frame_id").agg(F.count("*").alias("all"), F.count_if(~whole).alias("odd"), F.count_if(whole & far.between(min_range_m, max_range_m)).alias("near"))
    both = frame.join(occluded.select("frame_id", "n", "ratio"), "frame_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    item = lambda name, passed, value: F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), value.cast("double").alias("value"))
    items = F.array(
        item("depth_distribution_valid", (F.col("odd") == 0) & (F.col("near") > 0.5 * F.col("all")), F.col("near") / F.col("all")),
        item("fov_coverage_sufficient", F.col("n") / F.col("all") >= min_coverage, F.col("n") / F.col("all")),
        item("sufficient_valid_points", F.col("n") >= min_points, F.col("n")),
        item("occlusion_plausible", F.col("ratio") <= MAX_OCCLUSION, F.col("ratio")),
    )
    return both.select("frame_id", F.explode(items).alias("i")).select("frame_id", "i.*")
