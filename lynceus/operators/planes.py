"""The dominant plane of each scan by sampled triples, and how its outline meets the image's edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import broadcast_within, written
from . import images as raster
from . import pieces
from .noise_floor import Floor, classify
from .projection import Rig, project

#: Fixed values.
DISTANCE_M, ROUNDS, MIN_SHARE, MARGIN_PX, MIN_OUTLINE = 0.05, 300, 0.10, 4.0, 30
#: Frames whose numbers of blocks are broadcast.
BROADCAST_FRAMES = 5_000
#: Points of a frame that meet its planes in one task, and of them those whose distances to a plane are reckoned at once, which caches hold.
BLOCK_ROWS, CHUNK = 65_536, 8_192
#: Points that a task numbers.
PIECE_ROWS = 500_000


def random_triples(counts: DataFrame, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """frame_id, round, i0, i1, i2: three different positions below n, the same draws for each frame of equal n (``counts``: frame_id, n)."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n < 3:
                    continue
                source = np.random.RandomState(seed)
                picks = np.array([source.choice(n, size=3, replace=False) for _ in range(rounds)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([frame] * rounds, pa.int64()), pa.array(np.arange(rounds)), *[pa.array(picks[:, k]) for k in range(3)]], ["frame_id", "round", "i0", "i1", "i2"])

    return counts.select(F.col("frame_id").cast("long").alias("frame_id"), F.col("n").cast("long").alias("n")).mapInArrow(draw, "frame_id long, round long, i0 long, i1 long, i2 long")


def numbered(points: DataFrame, key: str = "point_id") -> DataFrame:
    """frame_id, at (0-based position by ``key`` in its frame), x, y, z. Frames of many points are numbered in pieces."""
    rows = points.select("frame_id", key, *[F.col(c).cast("double").alias(c) for c in "xyz"])
    at = F.row_number().over(Window.partitionBy("frame_id").orderBy(key)) - 1
    if pieces.longest(rows, "frame_id") <= PIECE_ROWS:
        return rows.select("frame_id", key, at.cast("long").alias("at"), *"xyz")
    cut = pieces.cut(rows, "frame_id", key, PIECE_ROWS)
    before = F.sum("n").over(Window.partitionBy("frame_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))  # one row a piece
    ends = cut.groupBy("frame_id", "piece").agg(F.count("*").alias("n"))
    ends = written(ends.select(F.col("frame_id").alias("of"), F.col("piece").alias("at_piece"), F.coalesce(before, F.lit(0)).alias("before")))
    own = F.row_number().over(Window.partitionBy("frame_id", "piece").orderBy(key)) - 1
    return pieces.told(cut, ends, "frame_id").select("frame_id", key, (F.col("before") + own).cast("long").alias("at"), *"xyz")


def candidate_planes(placed: DataFrame, triples: DataFrame) -> DataFrame:
    """frame_id, planes: an array of round, nx, ny, nz, offset through each triple, by round; triples on lines are left out.

    ``placed`` is what ``numbered`` gives. Only the corners of triples are looked up, so an array has as many planes as there are rounds.
    """
    spots = triples.select("frame_id", "round", F.posexplode(F.array("i0", "i1", "i2")).alias("corner", "at"))
    met = spots.join(placed, ["frame_id", "at"]).groupBy("frame_id", "round").agg(*[F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in "xyz"])
    a, b = ([F.col(f"{c}{k}") - F.col(f"{c}0") for c in "xyz"] for k in (1, 2))
    cross = [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]
    planes = met.withColumns({f"c{c}": x for c, x in zip("xyz", cross)}).withColumn("size", F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2 + F.col("cz") ** 2)).where("size >= 1e-9")
    planes = planes.select("frame_id", "round", *[(F.col(f"c{c}") / F.col("size")).alias(f"n{c}") for c in "xyz"], "x0", "y0", "z0")
    planes = planes.withColumn("offset", -(F.col("nx") * F.col("x0") + F.col("ny") * F.col("y0") + F.col("nz") * F.col("z0")))
    return planes.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("round", "nx", "ny", "nz", "offset"))).alias("planes"))


def near_counts(placed: DataFrame, planes: DataFrame, distance_m: float) -> DataFrame:
    """frame_id, counts: for each of a frame's planes the points within ``distance_m`` of it.

    A frame's points (``placed``, as ``numbered`` gives them) are taken in blocks of up to 65,536, and each block meets
    its frame's planes once, as one row, not once a point. It counts all planes at once and sends one vector: no row
    for a point and a plane exists.
    """

    def count(points: pa.Table, found: pa.Table) -> pa.Table:
        if not points.num_rows or not found.num_rows:
            return pa.table({"frame_id": pa.array([], pa.int64()), "counts": pa.array([], pa.list_(pa.int64()))})
        x, y, z = (points.column(c).to_numpy() for c in "xyz")
        p = found.column("planes").combine_chunks().flatten()
        n, offset = np.stack([p.field(c).to_numpy() for c in ("nx", "ny", "nz")], 1), p.field("offset").to_numpy()
        total = np.zeros(len(n), np.int64)
        for a in range(0, len(x), CHUNK):
            some = slice(a, a + CHUNK)
            for k in range(len(n)):
                # The order of the sum is that of the column expression of ``inlier_points``.
                total[k] += np.count_nonzero(np.abs(n[k, 0] * x[some] + n[k, 1] * y[some] + n[k, 2] * z[some] + offset[k]) <= distance_m)
        return pa.table({"frame_id": found.column("frame_id"), "counts": pa.array([total], pa.list_(pa.int64()))})

    blocks = placed.select(F.col("frame_id").cast("long").alias("frame_id"), *"xyz", F.expr(f"at div {BLOCK_ROWS}").alias("block"))
    last = placed.groupBy(F.col("frame_id").cast("long").alias("frame_id")).agg(F.expr(f"max(at) div {BLOCK_ROWS}").alias("last"))
    told = planes.select("frame_id", "planes").join(broadcast_within(written(last), BROADCAST_FRAMES), "frame_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).drop("last")
    parts = blocks.groupBy("frame_id", "block").cogroup(told.groupBy("frame_id", "block")).applyInArrow(count, "frame_id long, counts array<long>")
    added = parts.select("frame_id", F.posexplode("counts").alias("i", "c")).groupBy("frame_id", "i").agg(F.sum("c").alias("c"))
    return added.groupBy("frame_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("counts"))


def dominant_planes(points: DataFrame, triples: DataFrame | None = None, distance_m: float = DISTANCE_M, key: str = "point_id") -> DataFrame:
    """frame_id, n, nx, ny, nz, offset, inliers, inlier_ratio: the plane through a triple that most points are near; of equal ones the first round.

    A frame's planes are one row that its points meet (``near_counts``). Frames with fewer than three points, or with
    triples on lines only, have no row.
    """
    placed = written(numbered(points, key))
    counts = placed.groupBy("frame_id").agg(F.count("*").alias("n"))
    planes = candidate_planes(placed, random_triples(counts) if triples is None else triples)
    planes = written(planes.withColumn("frame_id", F.col("frame_id").cast("long")))
    near = near_counts(placed, planes, distance_m).join(planes, "frame_id")
    both = F.zip_with("planes", "counts", lambda p, c: F.struct(c.alias("inliers"), (-p["round"]).alias("earlier"), *(p[x].alias(x) for x in ("nx", "ny", "nz", "offset"))))
    best = near.select("frame_id", F.array_max(both).alias("b")).join(counts.select(F.col("frame_id").cast("long").alias("frame_id"), "n"), "frame_id")
    return best.select("frame_id", "n", "b.nx", "b.ny", "b.nz", "b.offset", "b.inliers", (F.col("b.inliers") / F.col("n")).alias("inlier_ratio"))


def inlier_points(points: DataFrame, planes: DataFrame, distance_m: float = DISTANCE_M) -> DataFrame:
    mine = points.join(planes.select("frame_id", "nx", "ny", "nz", "offset"), "frame_id")
    return mine.where(F.abs(F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz") + F.col("offset")) <= distance_m).select(*points.columns)


def hull(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions of the corners of the convex hull, in turn."""
    order = np.lexsort([v, u]).tolist()

    def chain(seq: list[int]) -> list[int]:
        out: list[int] = []
        for i in seq:
            while len(out) > 1 and (u[out[-1]] - u[out[-2]]) * (v[i] - v[out[-2]]) <= (v[out[-1]] - v[out[-2]]) * (u[i] - u[out[-2]]):
                out.pop()
            out.append(i)
        return out[:-1]

    found = chain(order) + chain(order[::-1])
    return np.array(found or order[:1], int)


def outlines(projected: DataFrame) -> DataFrame:
    """frame_id, corners (array of u, v): the convex hull of each frame's pixels.

    Each batch gives the hull of what it holds of a frame first, so what meets in one task is corners only.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame, u, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("frame_id", "u", "v"))
            for f in np.unique(frame):
                at = np.nonzero(frame == f)[0]
                keep = at[hull(u[at], v[at])]
                yield pa.RecordBatch.from_arrays([pa.array(frame[keep]), pa.array(u[keep]), pa.array(v[keep])], ["frame_id", "u", "v"])

    def whole(table: pa.Table) -> pa.Table:
        u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
        at = hull(u, v)
        return pa.table({"frame_id": table.column("frame_id").slice(0, 1), "corners": pa.array([[{"u": float(u[i]), "v": float(v[i])} for i in at]])})

    some = projected.select(F.col("frame_id").cast("long").alias("frame_id"), "u", "v").mapInArrow(partial, "frame_id long, u double, v double")
    return some.groupBy("frame_id").applyInArrow(whole, "frame_id long, corners array<struct<u:double,v:double>>")


def near_outline(projected: DataFrame, margin_px: float = MARGIN_PX) -> DataFrame:
    """The points within ``margin_px`` of their frame's hull."""
    both = projected.join(outlines(projected), "frame_id").where(F.size("corners") >= 3)
    ends = F.concat(F.slice("corners", 2, F.greatest(F.size("corners") - 1, F.lit(0))), F.slice("corners", 1, 1))
    sides = F.arrays_zip(F.col("corners").alias("a"), ends.alias("b"))

    def away(s):  # noqa: ANN001, ANN202
        du, dv = s["b"]["u"] - s["a"]["u"], s["b"]["v"] - s["a"]["v"]
        length = du * du + dv * dv
        t = F.when(length > 0, ((F.col("u") - s["a"]["u"]) * du + (F.col("v") - s["a"]["v"]) * dv) / length).otherwise(0.0)
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        return F.sqrt((F.col("u") - s["a"]["u"] - t * du) ** 2 + (F.col("v") - s["a"]["v"] - t * dv) ** 2)

    return both.where(F.array_min(F.transform(sides, away)) <= margin_px).select(*projected.columns)


def plane_metric(points: DataFrame, images: DataFrame, rig: Rig, floor: Floor, triples: DataFrame | None = None, min_share: float = MIN_SHARE, min_outline: int = MIN_OUTLINE) -> DataFrame:
    """frame_id, plane_found, inlier_ratio, inliers, outline_points, errors, floor, class of each frame: FAIL without a plane, with few points on its outline or without image edges."""
    planes = dominant_planes(points, triples)
    found = planes.where(F.col("inlier_ratio") >= min_share)
    edge = near_outline(project(inlier_points(points, found), rig))
    errors = edge.select("frame_id", "point_id", "depth").join(raster.edge_distances(images, edge), ["frame_id", "point_id"])
    one = errors.groupBy("frame_id").agg(
        F.count("*").alias("outline_points"), F.avg("error_px").alias("mean_px"), F.median("error_px").alias("median_px"), F.expr("percentile(error_px, 0.95)").alias("p95_px"), F.median("depth").alias("depth_m")
    )
    out = points.select("frame_id").distinct().join(planes, "frame_id", "left").join(one, "frame_id", "left")
    out = out.withColumns({"plane_found": F.coalesce(F.col("inlier_ratio") >= min_share, F.lit(False)), "outline_points": F.coalesce("outline_points", F.lit(0).cast("long"))})
    enough = F.col("plane_found") & (F.col("outline_points") >= min_outline)
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("mean_px", "median_px", "p95_px", "depth_m")}).withColumn("floor_px", floor.at(F.col("depth_m")))
    return out.select(
        "frame_id", "plane_found", F.coalesce("inlier_ratio", F.lit(0.0)).alias("inlier_ratio"), F.coalesce("inliers", F.lit(0).cast("long")).alias("inliers"), "outline_points",
        "mean_px", "median_px", "p95_px", "floor_px", classify(F.col("mean_px"), F.col("floor_px")).alias("classification"),
    )
