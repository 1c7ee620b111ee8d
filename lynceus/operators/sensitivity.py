"""Perturbed transforms: how far the image of the points moves, and which axes matter."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .projection import Rig, clipped, project

#: Steps of translation in metres and of rotation in degrees.
METRES = (0.001, 0.005, 0.01, 0.02)
DEGREES = (0.05, 0.1, 0.2, 0.5, 1.0)
SECONDS = (0.005, 0.01, 0.02, 0.05, 0.1)
BENCHMARK_METRES, BENCHMARK_DEGREES = (0.005, 0.01, 0.02), (0.1, 0.2, 0.5)


def candidates(rig: Rig, metres: tuple[float, ...] = METRES, degrees: tuple[float, ...] = DEGREES, velocity: tuple[float, ...] | None = None, omega: tuple[float, ...] | None = None, seconds: tuple[float, ...] = SECONDS) -> list[tuple]:
    """(axis, direction, delta, twelve numbers of the transform): 24 shifts and 30 turns, and with a platform's
    velocity or turning rate ten shifts in time, which move all points of a scan as one body."""
    t, out = rig.transform, []
    for i, axis in enumerate(("tx", "ty", "tz")):
        for delta in metres:
            for sign in (1, -1):
                out.append((axis, sign, delta, *(float(x + (sign * delta if j == 4 * i + 3 else 0)) for j, x in enumerate(t))))
    for i, axis in enumerate(("roll_deg", "pitch_deg", "yaw_deg")):
        for delta in degrees:
            for sign in (1, -1):
                c, s = math.cos(math.radians(delta)), sign * math.sin(math.radians(delta))
                a, b = (i + 1) % 3, (i + 2) % 3  # the plane of the turn
                new = [float(x) for x in t]
                for j in range(3):
                    new[4 * a + j], new[4 * b + j] = c * t[4 * a + j] - s * t[4 * b + j], s * t[4 * a + j] + c * t[4 * b + j]
                out.append((axis, sign, delta, *new))
    if velocity is not None or omega is not None:
        for delta in seconds:
            for sign in (1, -1):
                out.append(("timestamp", sign, delta, *_later(rig, velocity or (0, 0, 0), omega or (0, 0, 0), sign * delta)))
    return out


def _later(rig: Rig, velocity: tuple[float, ...], omega: tuple[float, ...], dt: float) -> list[float]:
    """The rig's transform after the motion of ``dt`` seconds is taken off each point."""
    m = np.array(rig.transform, float).reshape(3, 4)
    rate = np.linalg.norm(omega)
    k = np.array(omega, float) / rate if rate >= 1e-12 else np.zeros(3)
    cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    back = (np.eye(3) + math.sin(rate * dt) * cross + (1 - math.cos(rate * dt)) * cross @ cross).T
    return np.column_stack([m[:, :3] @ back, m[:, 3] - m[:, :3] @ back @ (np.array(velocity, float) * dt)]).ravel().tolist()


def benchmark_candidates(rig: Rig) -> list[tuple]:
    """One-sided steps of each of the six axes, none first, for the test whether errors only grow."""
    grown = candidates(rig, BENCHMARK_METRES, BENCHMARK_DEGREES)
    still = [(axis, 1, 0.0, *map(float, rig.transform)) for axis in dict.fromkeys(c[0] for c in grown)]
    return still + [c for c in grown if c[1] > 0]


def variants(spark: SparkSession, grid: list[tuple]) -> DataFrame:
    """variant (position in ``grid``), axis, direction, delta, m0..m11."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(grid)], "variant long, axis string, direction int, delta double, " + ", ".join(f"m{i} double" for i in range(12)))


def projected_variants(points: DataFrame, table: DataFrame, rig: Rig) -> DataFrame:
    """Points in the image under each variant's transform, with u, v, depth and variant; the table of variants is small and broadcast."""
    row = lambda i: sum((F.col(c) * F.col(f"m{4 * i + k}") for k, c in enumerate("xyz")), F.col(f"m{4 * i + 3}"))
    every = points.join(F.broadcast(table.select("variant", *[f"m{i}" for i in range(12)])), how="cross")
    return clipped(every.withColumns({"xc": row(0), "yc": row(1), "zc": row(2)}), rig, [*points.columns, "variant"])


def shift_samples(spark: SparkSession, points: DataFrame, rig: Rig) -> DataFrame:
    """axis, direction, delta, n and mean_px, the mean way in pixels of the points seen before and after.

    The 54 candidates are broadcast (their number is fixed); points are read once, sums are combined before the shuffle.
    """
    if rig.lens != "none":
        raise ValueError("samples are taken without lens distortion")
    names = [f"m{i}" for i in range(12)]
    grid = spark.createDataFrame(candidates(rig), "axis string, direction int, delta double, " + ", ".join(f"{n} double" for n in names))
    seen = project(points, rig).select("x", "y", "z", F.col("u").alias("u0"), F.col("v").alias("v0"))
    row = lambda i: sum((F.col(c) * F.col(names[4 * i + k]) for k, c in enumerate("xyz")), F.col(names[4 * i + 3]))
    both = seen.join(F.broadcast(grid), how="cross").withColumn("zc", row(2)).where("zc > 0.05")
    both = both.withColumns({"u": rig.fx * (row(0) / F.col("zc")) + rig.cx, "v": rig.fy * (row(1) / F.col("zc")) + rig.cy})
    both = both.where((F.col("u") >= 0) & (F.col("u") < rig.width) & (F.col("v") >= 0) & (F.col("v") < rig.height))
    way = F.sqrt((F.col("u") - F.col("u0")) ** 2 + (F.col("v") - F.col("v0")) ** 2)
    return both.groupBy("axis", "direction", "delta").agg(F.count("*").alias("n"), F.avg(way).alias("mean_px"))


def axis_sensitivity(samples: DataFrame, baseline_px: float, floor_px: float) -> DataFrame:
    """axis, small_px, large_px (effects of the least and largest delta) and HIGH, MEDIUM or LOW against the floor."""
    valid = samples.where("mean_px is not null")
    ends = valid.groupBy("axis").agg(F.min("delta").alias("lo"), F.max("delta").alias("hi"))
    effect = F.abs(F.col("mean_px") - baseline_px)
    each = valid.join(ends, "axis").groupBy("axis").agg(
        F.avg(F.when(F.col("delta") == F.col("lo"), effect)).alias("small_px"), F.avg(F.when(F.col("delta") == F.col("hi"), effect)).alias("large_px")
    )
    over = lambda c: F.lit(floor_px > 0) & (F.col(c) > floor_px)
    return each.withColumn("classification", F.when(over("small_px"), "HIGH").when(over("large_px"), "MEDIUM").otherwise("LOW"))
