"""LiDAR edge points to image edge pixels: the strongest pixel of like direction in the smallest radius that has one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RADII, MAX_ANGLE = (5.0, 10.0, 15.0), 30.0


def correspondences(points: DataFrame, pixels: DataFrame, radii: tuple[float, ...] = RADII, max_angle: float = MAX_ANGLE, image: str = "frame_id") -> DataFrame:
    """``points`` with matched, pixel_u, pixel_v, distance_px, num_candidates.

    ``points``: u, v, orientation_deg, the column ``image`` that names the image, and whatever makes a point one of a
    kind; ``pixels``: frame_id, pixel_u, pixel_v, pixel_deg, strength. Of equal strength the nearer pixel wins, then
    the upper, then the left one. A point with no direction never matches; an unmatched one is the largest radius
    away. One join on grid cells serves all radii, and it is an outer one, so points are read once.
    """
    size = radii[-1]
    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    around = F.explode(F.array(*[F.struct((cell("u") + i).alias("_gx"), (cell("v") + j).alias("_gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    mine = points.withColumn("_g", around).select(*points.columns, "_g.*")
    side = pixels.select(F.col("frame_id").alias("_image"), *[F.col(c).alias(f"_{c}") for c in ("pixel_u", "pixel_v", "pixel_deg", "strength")], cell("pixel_u").alias("_px"), cell("pixel_v").alias("_py"))
    met = mine.join(side, (F.col(image) == F.col("_image")) & (F.col("_gx") == F.col("_px")) & (F.col("_gy") == F.col("_py")), "left")
    turn = F.pmod(F.col("orientation_deg") - F.col("_pixel_deg"), F.lit(180.0))
    d = F.sqrt((F.col("u") - F.col("_pixel_u")) ** 2 + (F.col("v") - F.col("_pixel_v")) ** 2)
    met = met.withColumn("_d", F.when((d <= size) & (F.least(turn, 180 - turn) <= max_angle), d))
    tier = F.lit(radii[-1])
    for r in reversed(radii[:-1]):
        tier = F.when(F.col("_d") <= r, F.lit(r)).otherwise(tier)
    fits = lambda c: F.when(F.col("_d").isNotNull(), c)
    best = F.struct(tier.alias("tier"), (-F.col("_strength")).alias("s"), F.col("_d").alias("d"), F.col("_pixel_v").alias("pixel_v"), F.col("_pixel_u").alias("pixel_u"))
    counts = [F.count_if(F.col("_d") <= r).alias(f"_n{i}") for i, r in enumerate(radii)]  # a tier's survivors are those within it
    one = met.groupBy(*points.columns).agg(F.min(fits(best)).alias("_m"), *counts)
    n = F.lit(0).cast("long")
    for i, r in reversed(list(enumerate(radii))):
        n = F.when(F.col("_m.tier") == r, F.col(f"_n{i}")).otherwise(n)
    return one.select(
        *points.columns, F.col("_m").isNotNull().alias("matched"), F.col("_m.pixel_u").alias("pixel_u"), F.col("_m.pixel_v").alias("pixel_v"),
        F.coalesce("_m.d", F.lit(size)).alias("distance_px"), n.alias("num_candidates"),
    )
