"""Nearest neighbours in the image, the direction of an edge through a point, and agreement with the neighbours.

Both work within a frame, on its edge points. Frames of up to 50,000 are one Arrow task's work each. Larger ones are cut
into strips of about as many points; each strip meets the points within a reach of it, and what its neighbours beyond
could change asks again with a reach four times as long, until nothing is left. No task holds a large frame.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import broadcast_within, written
from . import pieces
from .matching import MAX_ANGLE, RADII, correspondences

#: Neighbours of a direction and of the agreement test, its bounds in degrees, ratio and pixels.
DIRECTION_NEIGHBOURS, AGREEMENT_NEIGHBOURS = 6, 5
MAX_TURN_DEG, MAX_RATIO, MIN_DIFFERENCE_PX, MIN_TURNING_PX = 45.0, 3.0, 3.0, 1.5
#: Points of a frame, or of a strip of one, that a task takes; a strip's first reach in mean spacings of points, and its growth.
FRAME_ROWS, FIRST_REACH, GROWTH = 50_000, 4.0, 4.0


def nearest(u: np.ndarray, v: np.ndarray, k: int, width: float = 16.0, chunk: int = 256, ask: np.ndarray | None = None) -> np.ndarray:
    """Positions of each point's k nearest others (-1 where there are none left), of equal distance the first ones; for the points ``ask`` only, if given.

    Points are taken in chunks along u and meet those within ``width`` of the chunk. That is exact for a point whose
    k-th neighbour lies within the width; for the others it is doubled.
    """
    n, order = len(u), np.argsort(u, kind="stable")
    us, out = u[order], np.full((len(u), k), -1)
    k = min(k, n - 1)
    asked = order if ask is None else order[np.isin(order, ask)]
    for a in range(0, len(asked), chunk):
        todo, w = asked[a : a + chunk], width
        while k > 0 and len(todo):
            lo, hi = np.searchsorted(us, u[todo].min() - w), np.searchsorted(us, u[todo].max() + w, "right")
            other = np.sort(order[lo:hi])  # first ones first, for ties
            d = np.hypot(u[other] - u[todo][:, None], v[other] - v[todo][:, None])
            d[other == todo[:, None]] = np.inf
            found = len(other) > k
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            far = np.take_along_axis(d, near, 1)[:, -1] if found or len(other) == n else np.full(len(todo), np.inf)
            done = (far <= w) | (len(other) == n)
            out[todo[done], :k] = other[near[done]]
            todo, w = todo[~done], 2 * w
    return out if ask is None else out[ask]


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]


#: kernel(cloud, positions asked, k, columns): values of the asked points and their neighbours' positions.
Kernel = Callable[[pa.Table, np.ndarray, int], tuple[pa.Array, np.ndarray]]


def _answer(cloud: pa.Table, ask: np.ndarray, k: int, reach: float, kernel: Kernel) -> tuple[pa.Array, np.ndarray]:
    """The kernel's values, and whether points beyond ``reach``, which ``cloud`` lacks, could not change them."""
    value, near = kernel(cloud, ask, k)
    if np.isinf(reach) or not len(ask):
        return value, np.ones(len(ask), bool)
    u, v = _numbers(cloud, "u", "v")
    far = np.hypot(u[near[:, -1]] - u[ask], v[near[:, -1]] - v[ask])
    return value, (near[:, -1] >= 0) & (far <= reach)


def _with_neighbours(points: DataFrame, group: str, key: str, columns: list[str], k: int, added: tuple[str, str], kernel: Kernel) -> DataFrame:
    """``points``, rows of a written table, with a column ``added`` (name, type) that ``kernel`` makes of ``columns`` of a point and its k nearest others."""
    name, kind = added
    if pieces.longest(points, group) <= FRAME_ROWS:
        kept = [c for c in points.columns if c != name]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields if f.name != name)

        def frame(table: pa.Table) -> pa.Table:
            table = table.sort_by(key)
            return pa.table({**{c: table.column(c) for c in kept}, name: kernel(table, np.arange(table.num_rows), k)[0]})

        return points.groupBy(group).applyInArrow(frame, f"{schema}, `{name}` {kind}")
    values = _by_strips(points, group, key, columns, k, added, kernel)
    return points.drop(name).join(values, [group, key])


def _by_strips(points: DataFrame, group: str, key: str, columns: list[str], k: int, added: tuple[str, str], kernel: Kernel) -> DataFrame:
    """group, key and the kernel's value of each point, worked out strip by strip."""
    name, kind = added
    needed = [c for c in columns if c not in ("u", "v")]
    cloud = points.select(group, key, F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"), *needed)
    size = cloud.groupBy(group).agg(F.count("*").alias("n"), (F.max("u") - F.min("u")).alias("wide"), (F.max("v") - F.min("v")).alias("high"))
    spacing = F.greatest(F.sqrt(F.col("wide") * F.col("high") / F.col("n")), F.greatest("wide", "high") / F.col("n"), F.lit(1e-9))
    size = written(size.select(F.col(group).alias("of"), (F.col("wide") >= F.col("high")).alias("flat"), F.greatest("wide", "high").alias("span"), (spacing * FIRST_REACH).alias("reach")))
    axis = cloud.join(broadcast_within(size.select("of", "flat"), pieces.BROADCAST_PIECES), pieces.same(group, "of")).drop("of")
    strips = pieces.cut(axis.withColumn("at", F.when(F.col("flat"), F.col("u")).otherwise(F.col("v"))).drop("flat"), group, "at", FRAME_ROWS)
    types = {f.name: f.dataType.simpleString() for f in strips.schema.fields}
    asked, out, grown = strips.select(group, key, "piece", "at"), [], 1.0
    while True:
        whole = F.when(F.col("reach") * grown >= F.col("span"), F.lit(float("inf"))).otherwise(F.col("reach") * grown)
        reach = written(size.select("of", whole.alias("reach")))
        mark = asked.select(F.col(group).alias("of"), F.col(key).alias("asked"))
        ring = strips.join(mark, pieces.same(group, "of") & (F.col(key) == F.col("asked")), "left").drop("of").withColumn("asked", F.col("asked").isNotNull())
        ring = written(ring)
        goal = pieces.routed(ring, F.col("asked"), F.lit(True), group, "at", reach).withColumn("asked", F.col("asked") & (F.col("piece") == F.col("goal")))
        goal = goal.join(broadcast_within(reach, pieces.BROADCAST_PIECES), pieces.same(group, "of")).drop("of", "piece", "at")

        def strip(table: pa.Table) -> pa.Table:
            table = table.sort_by(key)
            ask = np.nonzero(table.column("asked").to_numpy(zero_copy_only=False).astype(bool))[0]
            value, done = _answer(table, ask, k, float(table.column("reach")[0].as_py()), kernel)
            own = table.take(pa.array(ask))
            return pa.table({group: own.column(group), key: own.column(key), name: value, "done": pa.array(done)})

        found = written(goal.groupBy(group, "goal").applyInArrow(strip, f"`{group}` {types[group]}, `{key}` {types[key]}, `{name}` {kind}, done boolean"))
        out.append(found.where("done").drop("done"))
        asked = found.where("not done")
        if asked.isEmpty():
            return functools.reduce(DataFrame.unionByName, out)
        grown *= GROWTH


def edge_directions(points: DataFrame, k: int = DIRECTION_NEIGHBOURS, group: str = "frame_id", key: str = "point_id") -> DataFrame:
    """Adds orientation_deg (0..180): the main axis of each point and its k nearest others; null for a point alone in its frame."""

    def kernel(table: pa.Table, ask: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
        u, v = _numbers(table, "u", "v")
        others = nearest(u, v, k, ask=ask)
        near = np.column_stack([ask, others])
        there = near >= 0
        n = there.sum(1)
        pu, pv = np.where(there, u[near], 0.0), np.where(there, v[near], 0.0)
        du, dv = np.where(there, pu - (pu.sum(1) / n)[:, None], 0.0), np.where(there, pv - (pv.sum(1) / n)[:, None], 0.0)
        turn = np.mod(np.degrees(np.arctan2(2 * (du * dv).sum(1), (du * du).sum(1) - (dv * dv).sum(1))) / 2, 180.0)
        return pa.array(turn, mask=n < 2), others

    return _with_neighbours(written(points), group, key, ["u", "v"], k, ("orientation_deg", "double"), kernel)


def agreeing(matches: DataFrame, k: int = AGREEMENT_NEIGHBOURS, penalty_px: float = RADII[-1], group: str = "frame_id", key: str = "point_id") -> DataFrame:
    """``matches`` with those undone (reason ``consistency``) whose way to their pixel differs from their matched neighbours' median.

    It differs by direction (over 45 degrees, for ways of 1.5 px or more) or by length (over 3-fold and over 3 px).
    Neighbours that do not move don't count, two are needed, and frames with fewer than three matches stay as they are.
    """

    def kernel(table: pa.Table, ask: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
        u, v, pu, pv = _numbers(table, "u", "v", "pixel_u", "pixel_v")
        du, dv = pu - u, pv - v
        near = nearest(u, v, k, ask=ask)
        if len(u) < 3:
            return pa.array(np.zeros(len(ask), bool)), near
        ways = np.hypot(du, dv)
        own = ways[ask]
        counts = (near >= 0) & (ways[near] > 1e-9)
        mu, mv = (_median(np.where(counts, d[near], np.nan)) for d in (du, dv))
        mid = np.hypot(mu, mv)
        ok = (counts.sum(1) >= 2) & (own > 1e-9) & (mid > 1e-9)
        a, m = np.where(ok, own, 1.0), np.where(ok, mid, 1.0)
        turn = np.degrees(np.arccos(np.clip((du[ask] * np.where(ok, mu, 0.0) + dv[ask] * np.where(ok, mv, 0.0)) / (a * m), -1.0, 1.0)))
        turned = (own >= MIN_TURNING_PX) & (turn > MAX_TURN_DEG)
        stretched = (np.maximum(a / m, m / a) > MAX_RATIO) & (np.abs(a - m) > MIN_DIFFERENCE_PX)
        return pa.array(ok & (turned | stretched)), near

    matches = written(matches)  # counted, and read for both parts
    # Only matched points have a way and are neighbours.
    judged = _with_neighbours(matches.where("matched"), group, key, ["u", "v", "pixel_u", "pixel_v"], k, ("undone", "boolean"), kernel)
    out = judged.unionByName(matches.where("not matched").withColumn("undone", F.lit(False)))
    gone = F.col("undone")
    unless = lambda c: F.when(~gone, F.col(c))
    return out.withColumns({
        "reason": F.when(gone, "consistency").when(~F.col("matched"), "no_candidate"), "matched": F.col("matched") & ~gone, "pixel_u": unless("pixel_u"), "pixel_v": unless("pixel_v"),
        "distance_px": F.when(gone, F.lit(penalty_px)).otherwise(F.col("distance_px")), "num_candidates": F.when(gone, F.lit(0).cast("long")).otherwise(F.col("num_candidates")),
    }).drop("undone")


def _median(values: np.ndarray) -> np.ndarray:
    """Of each row's numbers, NaN where it has none."""
    n = (~np.isnan(values)).sum(1)
    low = np.sort(values, axis=1)  # NaN last
    rows = np.arange(len(values))
    return (low[rows, np.maximum(n - 1, 0) // 2] + low[rows, np.minimum(n // 2, values.shape[1] - 1)]) / 2


def match_edges(points: DataFrame, pixels: DataFrame, radii: tuple[float, ...] = RADII, max_angle: float = MAX_ANGLE, directions: Column | None = None, image: str = "frame_id") -> DataFrame:
    """Directions, correspondences and the agreement test in a row; ``points`` (frame_id, point_id, u, v, ``image`` and more) with what was found for each."""
    turned = edge_directions(points) if directions is None else points.withColumn("orientation_deg", directions)
    return agreeing(correspondences(turned, pixels, radii, max_angle, image), penalty_px=radii[-1])
