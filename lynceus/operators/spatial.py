"""Error by depth, image region and grid cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order_statistics import exact_percentiles

#: Right-open bins; the last has no end.
DEPTH_BINS = [(0, 10, "0-10m"), (10, 20, "10-20m"), (20, 30, "20-30m"), (30, 50, "30-50m"), (50, None, "50m+")]
GRID_ROWS, GRID_COLUMNS, GRID_POINTS = 6, 8, 3


def depth_bin(depth: Column) -> Column:
    out = F.when(depth < DEPTH_BINS[0][1], DEPTH_BINS[0][2])
    for _, end, label in DEPTH_BINS[1:-1]:
        out = out.when(depth < end, label)
    return out.otherwise(DEPTH_BINS[-1][2])


def third(position: Column, extent: int, names: tuple[str, str, str]) -> Column:
    k = F.least(F.greatest(F.floor(position / (extent / 3)), F.lit(0)), F.lit(2))
    return F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))


def error_stats(points: DataFrame, labels: list[str]) -> DataFrame:
    """label, mean, median, p95, std over matched points, valid and failed counts; a row for each of ``labels``, empty ones too."""
    matched = F.when(F.col("matched"), F.col("error"))
    stats = points.groupBy("label").agg(F.avg(matched).alias("mean_px"), F.stddev_pop(matched).alias("std_px"), F.count_if("matched").alias("valid"), F.count_if(~F.col("matched")).alias("failed"))
    ranks = exact_percentiles(points.select("label", matched.alias("e")), "label", "e", {"median_px": 0.5, "p95_px": 0.95})
    stats = stats.join(ranks, "label", "left")
    every = points.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    zero = F.lit(0).cast("long")
    return F.broadcast(every).join(stats, "label", "left").withColumns({"valid": F.coalesce("valid", zero), "failed": F.coalesce("failed", zero)})


def depth_trend(stats: DataFrame) -> DataFrame:
    """One row with trend: how the means of three or more filled depth bins run; null with fewer."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, b in enumerate(DEPTH_BINS) for x in (b[2], i)]), F.col("label"))
    step = F.col("mean_px") - F.lag("mean_px").over(Window.orderBy("rank"))  # five rows at most
    steps = stats.where("mean_px is not null").select("mean_px", rank.alias("rank")).withColumn("step", step)
    return steps.agg(F.count("*").alias("bins"), F.min("step").alias("lo"), F.max("step").alias("hi")).select(
        "bins", F.when(F.col("bins") < 3, None).when(F.col("lo") >= -1e-9, "increases_with_depth").when(F.col("hi") <= 1e-9, "decreases_with_depth").otherwise("stable").alias("trend")
    )


def error_grid(points: DataFrame, width: int, height: int) -> DataFrame:
    """frame_id, row, col, n, mean_px; the mean is null below GRID_POINTS points."""
    cell = lambda x, n, size: F.least(F.floor(F.col(x) * n / size), F.lit(n - 1)).cast("int")
    grouped = points.groupBy("frame_id", cell("v", GRID_ROWS, height).alias("row"), cell("u", GRID_COLUMNS, width).alias("col"))
    return grouped.agg(F.count("*").alias("n"), F.avg("error").alias("m")).select("frame_id", "row", "col", "n", F.when(F.col("n") >= GRID_POINTS, F.col("m")).alias("mean_px"))
