"""Motion within a scan: when each point was measured, and where it lay at one reference time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_offset(period_s: float = 0.1, clockwise: bool = False, start_rad: float = 0.0, given: Column | None = None) -> Column:
    """Seconds into the sweep: ``given`` by the sensor, held within the period, or else from the azimuth of x and y past ``start_rad``."""
    if given is not None:
        return F.least(F.greatest(given.cast("double"), F.lit(0.0)), F.lit(float(period_s)))
    full = F.lit(2 * math.pi)
    turned = F.pmod(F.pmod(F.atan2("y", "x"), full) - start_rad, full)
    return (F.pmod(full - turned, full) if clockwise else turned) / (2 * math.pi) * period_s


def deskew(points: DataFrame, velocity: tuple[float, float, float], omega: tuple[float, float, float], reference_s: float = 0.0) -> DataFrame:
    """x, y, z moved to the reference time, with correction_m; needs t_offset. Other columns stay.

    The point less the way travelled is turned back by the rotation of the time in between (Rodrigues' formula).
    """
    rate = math.sqrt(sum(w * w for w in omega))
    dt = F.lit(reference_s) - F.col("t_offset")
    q = [F.col(c) - v * dt for c, v in zip("xyz", velocity)]
    if rate >= 1e-12:
        k = [w / rate for w in omega]
        cos, sin = F.cos(rate * dt), F.sin(rate * dt)
        along = k[0] * q[0] + k[1] * q[1] + k[2] * q[2]
        cross = [k[(i + 1) % 3] * q[(i + 2) % 3] - k[(i + 2) % 3] * q[(i + 1) % 3] for i in range(3)]
        q = [q[i] * cos - cross[i] * sin + k[i] * along * (1 - cos) for i in range(3)]
    moved = F.sqrt(sum(((n - F.col(c)) ** 2 for n, c in zip(q, "xyz")), F.lit(0.0)))
    return points.withColumns({"x": q[0], "y": q[1], "z": q[2], "correction_m": moved})


def deskew_summary(deskewed: DataFrame) -> DataFrame:
    return deskewed.groupBy("frame_id").agg(
        F.count("*").alias("n"), F.avg("correction_m").alias("mean_m"), F.max("correction_m").alias("max_m"), F.expr("percentile(correction_m, 0.95)").alias("p95_m")
    )
