"""Points into the image: rigid transform, lens models, clipping; all column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_DEPTH = 0.05


@dataclass(frozen=True)
class Rig:
    """Camera, lens and the transform from LiDAR to camera (row-major 3 x 4)."""

    width: int
    height: int
    fx: float
    fy: float
    cx: float
    cy: float
    transform: tuple[float, ...] = (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)
    lens: str = "none"  # none, plumb_bob or fisheye
    coefficients: dict[str, float] = field(default_factory=dict)


def camera_axis(rig: Rig, i: int) -> Column:
    """The point's coordinate ``i`` in the camera's frame; factors of 0 and 1 are left out."""
    t = rig.transform
    terms = [F.col(c) if t[4 * i + k] == 1 else F.col(c) * float(t[4 * i + k]) for k, c in enumerate("xyz") if t[4 * i + k] != 0]
    return sum(terms, F.lit(float(t[4 * i + 3])))


def transformed(points: DataFrame, rig: Rig) -> DataFrame:
    """Adds xc, yc, zc, the point in the camera's frame."""
    return points.withColumns({"xc": camera_axis(rig, 0), "yc": camera_axis(rig, 1), "zc": camera_axis(rig, 2)})


def _lens(rig: Rig, a: Column, b: Column) -> tuple[Column, Column]:
    k = lambda name: float(rig.coefficients.get(name, 0.0))
    if rig.lens == "none":
        return a, b
    r2 = a * a + b * b
    if rig.lens == "plumb_bob":
        d = 1 + k("k1") * r2 + k("k2") * r2 * r2 + k("k3") * r2 * r2 * r2
        return a * d + 2 * k("p1") * a * b + k("p2") * (r2 + 2 * a * a), b * d + k("p1") * (r2 + 2 * b * b) + 2 * k("p2") * a * b
    if rig.lens == "fisheye":
        r = F.sqrt(r2)
        angle = F.atan(r)
        q = angle * angle
        bent = angle * (1 + k("k1") * q + k("k2") * q * q + k("k3") * q * q * q + k("k4") * q * q * q * q)
        s = F.when(r > 1e-8, bent / r).otherwise(1.0)
        return a * s, b * s
    raise ValueError(f"unknown lens model {rig.lens!r}")


def project(points: DataFrame, rig: Rig) -> DataFrame:
    """The points inside the image, with u, v and depth."""
    return clipped(transformed(points, rig), rig, points.columns)


def clipped(moved: DataFrame, rig: Rig, kept: list[str]) -> DataFrame:
    """``kept`` columns of points in the camera's frame (xc, yc, zc) with u, v and depth, inside the image; depth is tested before any division.

    u and v pass through a one-element ``inline``: a clip on them would otherwise be pushed below the projection as
    a copy of its whole formula for each bound, which outgrows what the JIT compiles.
    """
    ahead = moved.where(F.col("zc") > MIN_DEPTH)
    a, b = _lens(rig, F.col("xc") / F.col("zc"), F.col("yc") / F.col("zc"))
    spot = F.struct((rig.fx * a + rig.cx).alias("u"), (rig.fy * b + rig.cy).alias("v"))
    placed = ahead.select(*kept, F.inline(F.array(spot)), F.col("zc").alias("depth"))
    return placed.where((F.col("u") >= 0) & (F.col("u") < rig.width) & (F.col("v") >= 0) & (F.col("v") < rig.height))
