"""Radius self-join on a grid: neighbours within a distance, per frame, and the points of depth steps.

Where points lie densely, a depth step is decided on bounds of sub-cells: those wholly within the radius count as a
whole, those wholly beyond it not at all, and only points that neither decides meet the points of the cells on its rim.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import broadcast_within, written

#: Points of a cell as wide as the radius from which on its neighbourhood is decided on sub-cells; sub-cells across the radius.
DENSE, ACROSS = 256, 4
BROADCAST_CELLS = 1_000_000
#: Cells along a side of a tile, the part of a frame that one task takes; pairs of points that it holds at once.
TILE_CELLS, PAIRS = 64, 2_000_000
#: Depths within this of the least one count as the least.
EQUAL_M = 1e-9


def _cut(c: str, width: float) -> Column:
    return F.floor(F.col(c) / width).cast("int")


def with_neighbour_depths(points: DataFrame, radius: float, among: DataFrame | None = None) -> DataFrame:
    """Adds n, low and high: the points within ``radius`` pixels of the same frame (itself too) and their depths' bounds.

    Frames are cut into tiles of 64 cells a side, cells being as wide as the radius. A point is shuffled once to its own
    tile, and without its other columns to the tiles that it lies near, so a tile's task has all that its points meet.
    The neighbours are those of ``among``, by default the points themselves; no cell of theirs may hold very many.
    """
    wide = TILE_CELLS * radius
    tile = lambda c, by: F.floor((F.col(c) + by) / wide).cast("int")
    own = (F.col("tx") == tile("u", 0)) & (F.col("ty") == tile("v", 0))

    def placed(df: DataFrame, asks: Column) -> DataFrame:
        """``df`` in all tiles in reach, a little more than the radius for rounding; what is not asked there needs u, v and depth only."""
        near = df.where("frame_id is not null")
        for c, axis in (("u", "tx"), ("v", "ty")):
            near = near.withColumn(axis, F.explode(F.sequence(tile(c, -1.001 * radius), tile(c, 1.001 * radius))))
        rest = [F.when(asks, F.col(c)).alias(c) for c in kept]
        return near.select("frame_id", "u", "v", "depth", *rest, "tx", "ty", asks.alias("_asks"))

    names = points.columns
    kept = [c for c in names if c not in ("frame_id", "u", "v", "depth")]
    if among is None:
        rows = placed(points, own).withColumn("_answers", F.lit(True))
    else:
        mine = points.where("frame_id is not null").withColumns({"tx": tile("u", 0), "ty": tile("v", 0)})
        asked = mine.select("frame_id", "u", "v", "depth", *kept, "tx", "ty", F.lit(True).alias("_asks"), F.lit(False).alias("_answers"))
        other = among.select("frame_id", "u", "v", "depth", *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in kept])
        rows = asked.unionByName(placed(other, F.lit(False)).withColumn("_answers", F.lit(True)))

    def task(table: pa.Table) -> pa.Table:
        asks = table.column("_asks")
        u, v, depth = (table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("u", "v", "depth"))
        ask, answer = (np.nonzero(table.column(c).to_numpy(zero_copy_only=False).astype(bool))[0] for c in ("_asks", "_answers"))
        n, low, high = neighbour_depths(u[ask], v[ask], u[answer], v[answer], depth[answer], radius)
        found = table.select(names).filter(asks)
        for name, values, kind in (("n", n, pa.int64()), ("low", low, pa.float64()), ("high", high, pa.float64())):
            found = found.append_column(name, pa.array(values, kind))
        return found.filter(pa.array(n > 0))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return rows.groupBy("frame_id", "tx", "ty").applyInArrow(task, f"{schema}, n long, low double, high double")


def neighbour_depths(u: np.ndarray, v: np.ndarray, other_u: np.ndarray, other_v: np.ndarray, depth: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point (u, v) the others within ``radius``, their number and least and largest depth.

    The others lie in order of rows of cells, so what a point can meet are three runs; points are taken in chunks of
    at most so many pairs.
    """
    cell = lambda x: np.floor(x / radius).astype(np.int64)
    n, low, high = np.zeros(len(u), np.int64), np.full(len(u), np.inf), np.full(len(u), -np.inf)
    if not len(u) or not len(other_u):
        return n, low, high
    gx, gy = cell(other_u), cell(other_v)
    left, across = gx.min() - 2, gx.max() - gx.min() + 5
    place = gy * across + (gx - left)
    order = np.argsort(place, kind="stable")
    place, other_u, other_v, depth = place[order], other_u[order], other_v[order], depth[order]
    x, y = np.clip(cell(u) - left, 1, across - 2), cell(v)
    rows = y[:, None] + np.arange(-1, 2)
    since = np.searchsorted(place, rows * across + (x - 1)[:, None])
    size = np.searchsorted(place, rows * across + (x + 1)[:, None], "right") - since
    each = size.sum(1)
    ends = np.cumsum(each)
    at = 0
    while at < len(u):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        sizes = size[at:to].ravel()
        before = np.cumsum(sizes) - sizes
        met = np.arange(sizes.sum()) + np.repeat(since[at:to].ravel() - before, sizes)
        who = np.repeat(np.arange(at, to), each[at:to])
        du, dv = u[who] - other_u[met], v[who] - other_v[met]
        within = du * du + dv * dv <= radius * radius
        who, d = who[within], depth[met[within]]
        if len(who):
            first = np.nonzero(np.diff(who, prepend=-1))[0]
            n[who[first]] = np.diff(first, append=len(who))
            low[who[first]], high[who[first]] = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
        at = to
    return n, low, high


def _is_step(jump: float, min_neighbours: int) -> Column:
    return (F.col("n") >= min_neighbours) & (F.col("high") - F.col("low") > jump) & (F.col("depth") <= F.col("low") + EQUAL_M)


def edge_points(points: DataFrame, radius: float = 3.0, jump: float = 0.3, min_neighbours: int = 3) -> DataFrame:
    """Points on the near side of a depth step: enough neighbours, a depth range over ``jump``, and the least depth.

    Points with a dense cell next to them are decided by ``dense_edge_points``, the others by the join of all neighbours.
    """
    cell = [_cut("u", radius).alias("gx"), _cut("v", radius).alias("gy")]
    dense = written(points.groupBy("frame_id", *cell).agg(F.count("*").alias("c")).where(F.col("c") > DENSE).select("frame_id", "gx", "gy"))
    if dense.isEmpty():
        return with_neighbour_depths(points, radius).where(_is_step(jump, min_neighbours)).select(*points.columns)

    def around(reach: int) -> DataFrame:
        steps = range(-reach, reach + 1)
        wide = F.explode(F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in steps for j in steps]))
        return broadcast_within(written(dense.select("frame_id", wide.alias("g")).select("frame_id", "g.*").distinct()), BROADCAST_CELLS)

    points = written(points)
    placed = points.withColumns({"gx": _cut("u", radius), "gy": _cut("v", radius)})
    key, columns = ["frame_id", "gx", "gy"], points.columns
    near, far = placed.join(around(1), key, "left_semi").select(*columns), placed.join(around(2), key, "left_semi").select(*columns)
    thin = placed.join(around(0), key, "left_anti").select(*columns)  # none of the others has a neighbour in a dense cell
    rest = with_neighbour_depths(placed.join(around(1), key, "left_anti").select(*columns), radius, thin).where(_is_step(jump, min_neighbours))
    return rest.select(*columns).unionByName(dense_edge_points(near, far, radius, jump, min_neighbours))


def dense_edge_points(points: DataFrame, among: DataFrame, radius: float = 3.0, jump: float = 0.3, min_neighbours: int = 3) -> DataFrame:
    """The same as ``edge_points`` for ``points`` with neighbours from ``among`` (all that are within the radius), without meeting most of them.

    Count and depth bounds of sub-cells, a quarter of the radius wide, are combined cell by cell. A point deeper than
    the least depth of a cell wholly within the radius is none; nor is one around which no cell that the radius touches
    adds depth; one that is least of all these cells, with enough points and range in those within, is one. The few
    points left meet the sub-cells on the rim, and the places of a sub-cell only if it can change their bounds.
    """
    w = radius / ACROSS
    steps = range(-ACROSS - 1, ACROSS + 2)
    inside = lambda i, j: ((abs(i) + 1) ** 2 + (abs(j) + 1) ** 2) * w * w <= radius * radius
    reach = [(i, j) for i in steps for j in steps if (max(abs(i) - 1, 0) ** 2 + max(abs(j) - 1, 0) ** 2) * w * w <= radius * radius]
    own = {"sx": _cut("u", w), "sy": _cut("v", w)}
    cells = written(among.withColumns(own).groupBy("frame_id", "sx", "sy").agg(F.count("*").alias("c"), F.min("depth").alias("lo"), F.max("depth").alias("hi")))
    to = lambda offsets: F.explode(F.array(*[F.struct((F.col("sx") - i).alias("sx"), (F.col("sy") - j).alias("sy"), F.lit(inside(i, j)).alias("within")) for i, j in offsets]))
    spread = cells.select("frame_id", "c", "lo", "hi", to(reach).alias("t")).select("frame_id", "t.*", "c", "lo", "hi")
    whole = lambda c: F.when(F.col("within"), F.col(c))
    bounds = spread.groupBy("frame_id", "sx", "sy").agg(
        F.coalesce(F.sum(whole("c")), F.lit(0)).alias("n_in"), F.min(whole("lo")).alias("lo_in"), F.max(whole("hi")).alias("hi_in"), F.sum("c").alias("n_out"), F.min("lo").alias("lo_out"), F.max("hi").alias("hi_out")
    )
    least = points.withColumns(own).join(cells.select("frame_id", "sx", "sy", "lo"), ["frame_id", "sx", "sy"]).where(F.col("depth") <= F.col("lo") + EQUAL_M).drop("lo")  # of its own cell, before anything is joined
    known = least.join(bounds, ["frame_id", "sx", "sy"])
    possible = (F.col("depth") <= F.col("lo_in") + EQUAL_M) & (F.col("hi_out") - F.col("lo_out") > jump) & (F.col("n_out") >= min_neighbours)
    sure = (F.col("depth") <= F.col("lo_out") + EQUAL_M) & (F.col("hi_in") - F.col("lo_in") > jump) & (F.col("n_in") >= min_neighbours)
    known = written(known.where(possible).withColumns({"sure": sure, "row": F.monotonically_increasing_id()}))

    rim = [(i, j) for i, j in reach if not inside(i, j)]
    asked = known.where("not sure").withColumn("t", F.explode(F.array(*[F.struct((F.col("sx") + i).alias("sx"), (F.col("sy") + j).alias("sy")) for i, j in rim])))
    asked = asked.drop("sx", "sy").select("*", "t.*").drop("t").join(cells, ["frame_id", "sx", "sy"])
    at = lambda p, s, side: F.abs(F.col(p) - (F.col(s) + side) * w)
    gap = lambda p, s: F.when((F.col(p) < F.col(s) * w) | (F.col(p) > (F.col(s) + 1) * w), F.least(at(p, s, 0), at(p, s, 1))).otherwise(0.0)
    span = lambda p, s: F.greatest(at(p, s, 0), at(p, s, 1))
    # Rounding of the cells' edges is left to the exact distances below.
    touched = asked.where(gap("u", "sx") ** 2 + gap("v", "sy") ** 2 <= radius * radius * (1 + 1e-9)).withColumn("taken", span("u", "sx") ** 2 + span("v", "sy") ** 2 <= radius * radius * (1 - 1e-9))
    adds = (F.col("lo") < F.col("lo_in")) | (F.col("hi") > F.col("hi_in")) | (F.col("n_in") < min_neighbours)
    touched = written(touched.where(F.col("taken") | adds))
    places = among.withColumns(own).groupBy("frame_id", "sx", "sy", F.col("u").alias("ou"), F.col("v").alias("ov")).agg(F.count("*").alias("oc"), F.min("depth").alias("od"), F.max("depth").alias("oh"))
    single = touched.where("not taken").join(places, ["frame_id", "sx", "sy"]).where((F.col("u") - F.col("ou")) ** 2 + (F.col("v") - F.col("ov")) ** 2 <= radius * radius)
    more = touched.where("taken").select("row", "c", "lo", "hi").unionByName(single.select("row", F.col("oc").alias("c"), F.col("od").alias("lo"), F.col("oh").alias("hi")))
    more = more.groupBy("row").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    settled = known.where("not sure").join(more, "row", "left").withColumns({
        "n": F.col("n_in") + F.coalesce("c", F.lit(0)), "low": F.least("lo_in", "lo"), "high": F.greatest("hi_in", "hi"),
    }).where(_is_step(jump, min_neighbours))
    return known.where("sure").select(*points.columns).unionByName(settled.select(*points.columns))
