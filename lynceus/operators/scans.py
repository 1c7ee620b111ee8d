"""Range images and motion: cells of ring and azimuth, depth steps between them, cells that move."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RINGS, AZIMUTHS, JUMP = 32, 900, 0.3


def elevation() -> Column:
    """Angle above the plane of x and y, in radians."""
    return F.atan2(F.col("z"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def with_cells(points: DataFrame, fov_deg: float | None = 60.0, rings: int = RINGS, azimuths: int = AZIMUTHS, ring: str | None = None) -> DataFrame:
    """Adds range_m, ring and az; ring is -1 where the elevation is not finite.

    Rings cut the elevations of the field of view ``fov_deg`` into equal parts, those beyond it belong to the outer ones.
    Without a field of view they cut the span that each frame's finite elevations have (all ring 0 where there is none).
    A column ``ring`` of the sensor's own rings is taken as it is, however many they are; negative and null ones are -1.
    """
    turn = F.pmod(F.atan2("y", "x"), F.lit(2 * math.pi))
    clip = lambda c, n: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 1)).cast("int")
    rise = elevation()
    if ring is not None:
        at = F.greatest(F.coalesce(F.col(ring).cast("int"), F.lit(-1)), F.lit(-1))
    elif fov_deg is not None:
        half = math.radians(fov_deg) / 2
        at = F.when(_finite(rise), clip((rise + half) / (2 * half) * rings, rings)).otherwise(-1)
    else:
        spans = points.where(_finite(rise)).groupBy("frame_id").agg(F.min(rise).alias("_lo"), F.max(rise).alias("_hi"))  # one row a frame
        points = points.join(spans, "frame_id", "left")
        part = F.when(F.col("_hi") > F.col("_lo"), (rise - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
        at = F.when(_finite(rise), clip(part * rings, rings)).otherwise(-1)
    out = points.withColumns({
        "range_m": F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), "ring": at,
        "az": F.when(_finite(turn), clip(turn / (2 * math.pi) * azimuths, azimuths)).otherwise(-1),
    })
    return out.drop("_lo", "_hi")


def range_image(cells: DataFrame, key: str = "point_id") -> DataFrame:
    """The nearest point of each cell; of equal ranges the smallest id. Points without a ring or a finite range are in no cell."""
    seen = cells.where((F.col("ring") >= 0) & _finite(F.col("range_m")))
    return seen.groupBy("frame_id", "ring", "az").agg(F.min(F.struct("range_m", key)).alias("m")).select("frame_id", "ring", "az", "m.*")


def native_edges(cells: DataFrame, jump: float = JUMP, azimuths: int = AZIMUTHS, wrap: bool = True, key: str = "point_id") -> DataFrame:
    """``cells`` with is_edge: whether the point is the nearest one of a cell on the near side of a step (``edge_cells``)."""
    edges = edge_cells(range_image(cells, key), jump, azimuths, wrap).select("frame_id", key, F.lit(True).alias("is_edge"))
    return cells.join(edges, ["frame_id", key], "left").select(*cells.columns, F.coalesce("is_edge", F.lit(False)).alias("is_edge"))


def edge_cells(image: DataFrame, jump: float = JUMP, azimuths: int = AZIMUTHS, wrap: bool = True) -> DataFrame:
    """Cells with a left or right neighbour farther by over ``jump``; the circle closes by copies of its first and last cells."""
    own = image.withColumn("copy", F.lit(False))
    if wrap:
        last = image.where(F.col("az") == azimuths - 1).withColumn("az", F.lit(-1))
        first = image.where("az = 0").withColumn("az", F.lit(azimuths))
        own = own.unionByName(last.withColumn("copy", F.lit(True))).unionByName(first.withColumn("copy", F.lit(True)))
    far = F.max("range_m").over(Window.partitionBy("frame_id", "ring").orderBy("az").rangeBetween(-1, 1))
    return own.withColumn("far", far).where(~F.col("copy") & (F.col("far") - F.col("range_m") > jump)).drop("copy", "far")


def motion_cells(image: DataFrame, std_m: float = 0.3, min_frames: int = 3) -> DataFrame:
    """ring, az, frames, std_m and label: dynamic, static, or unknown with too few frames."""
    spread = image.groupBy("ring", "az").agg(F.count("*").alias("frames"), F.stddev_pop("range_m").alias("std_m"))
    return spread.withColumn("label", F.when(F.col("frames") < min_frames, "unknown").when(F.col("std_m") > std_m, "dynamic").otherwise("static"))


def occlusion(projected: DataFrame, bucket: int = 8, margin: float = 0.5) -> DataFrame:
    """frame_id, n and ratio of points that lie over ``margin`` behind the nearest of their bucket of pixels.

    Points are read once; a bucket's minimum is a window over (frame, bucket), which spills where a bucket is large.
    """
    spot = projected.select("frame_id", "depth", F.floor(F.col("u") / bucket).cast("int").alias("bx"), F.floor(F.col("v") / bucket).cast("int").alias("by"))
    low = F.min("depth").over(Window.partitionBy("frame_id", "bx", "by"))
    return spot.withColumn("low", low).groupBy("frame_id").agg(
        F.count("*").alias("n"), (F.count_if(F.col("depth") > F.col("low") + margin) / F.count("*")).alias("ratio")
    )


def dynamic_points(cells: DataFrame, motion: DataFrame) -> DataFrame:
    """Points with the label of their cell; ``unknown`` where it has none. AQE broadcasts the cells if they are few."""
    return cells.join(motion.select("ring", "az", "label"), ["ring", "az"], "left").withColumn("label", F.coalesce("label", F.lit("unknown")))
