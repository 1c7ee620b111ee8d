"""Synchronisation of two streams: the clock offset, then one-to-one matching that never goes back in time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import broadcast_within, written
from . import pieces
from .noise_floor import named
from .order_statistics import exact_percentiles

#: Bounds of the share dropped and of the deviation against the window, and of warnings.
DROP_BOUNDS, SPREAD_BOUNDS = (0.05, 0.20), (0.2, 0.5)
POOR_DROP, LARGE_OFFSET = 0.5, 0.5
#: Rows of a recording that one task takes; longer recordings are cut into pieces of about as many.
PIECE_ROWS = 200_000


def coarse_offset(camera: np.ndarray, lidar: np.ndarray) -> float:
    """Median of camera less nearest LiDAR time, without any window; of two equally near the earlier. Both ascend."""
    if not len(camera) or not len(lidar):
        return 0.0
    after = np.searchsorted(lidar, camera)
    late, early = lidar[np.minimum(after, len(lidar) - 1)], lidar[np.maximum(after - 1, 0)]
    return float(np.median(camera - np.where(np.abs(early - camera) <= np.abs(late - camera), early, late)))


def beside(left: DataFrame, right: DataFrame, key: str = "rig") -> DataFrame:
    """key, id, t of each left row, early and late: (t, id) of the last right row up to its time and of the first one after it, null where there is none.

    Both streams (key, id, t) are ordered runs in which the last right row before and the first after are looked up: a
    short recording is one run, a long one is cut into pieces, and each piece is told the last and first right row of
    the pieces around it. Both look-ups run on from row to row, the second one backwards: a window that begins after
    its row would be read anew for every row.
    """
    both = left.select(key, "id", "t", F.lit(1).alias("side")).unionByName(right.select(key, "id", "t", F.lit(0).alias("side"))).where("t is not null")
    own, none = F.when(F.col("side") == 0, F.struct("t", "id")), F.lit(None)
    if pieces.longest(both, key) <= PIECE_ROWS:
        run, placed = [key], both.withColumns({"carried": none, "coming": none})
    else:
        run, cut = [key, "piece"], pieces.cut(both, key, "t", PIECE_ROWS)
        ends = cut.groupBy(key, "piece").agg(F.max(own).alias("last"), F.min(own).alias("first"))
        known = lambda c, *order: F.last(c, True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))  # noqa: E731  one row a piece
        ends = written(ends.select(F.col(key).alias("of"), F.col("piece").alias("at_piece"), known("last", "piece").alias("carried"), known("first", F.desc("piece")).alias("coming")))
        placed = pieces.told(cut, ends, key)
    w = Window.partitionBy(*run)
    onward, back = w.orderBy("t", "side", "id"), w.orderBy(F.desc("t"), F.desc("side"), F.desc("id"))
    return placed.withColumns({
        "early": F.coalesce(F.last(own, True).over(onward.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried")),
        "late": F.coalesce(F.last(own, True).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.col("coming")),
    }).where("side = 1").select(key, "id", "t", "early", "late")


def nearer_side() -> Column:
    """Of ``early`` and ``late`` the one nearer to t; of two equally near ones the earlier."""
    return F.when(F.col("late").isNull() | (F.col("t") - F.col("early.t") <= F.col("late.t") - F.col("t")), F.col("early")).otherwise(F.col("late"))


def nearest_of_any(left: DataFrame, right: DataFrame, key: str = "rig") -> DataFrame:
    """key, left_id, right_id, diff_s (left less right) of the nearest right time at any distance; of two equally near ones the earlier.

    Rows without any right one are left out.
    """
    seen = beside(left, right, key).withColumn("m", nearer_side()).where("m is not null")
    return seen.select(key, F.col("id").alias("left_id"), F.col("m.id").alias("right_id"), (F.col("t") - F.col("m.t")).alias("diff_s"))


def nearest_places(aim: np.ndarray, lidar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each aim the place of the nearest LiDAR time (of two the later, of equal times the last); and the last place of each LiDAR time."""
    last_of = np.searchsorted(lidar, lidar, "right") - 1
    after = np.minimum(np.searchsorted(lidar, aim), len(lidar) - 1)
    before = np.maximum(after - 1, 0)
    return last_of[np.where(np.abs(lidar[after] - aim) <= np.abs(lidar[before] - aim), after, before)], last_of


def match_in_order(camera: np.ndarray, lidar: np.ndarray, window: float, offset: float, place: int = 0) -> list[tuple[int, int]]:
    """Pairs of indices, both ascending, of LiDAR frames from ``place`` on. The nearest LiDAR time of each camera time is
    found for all at once; what is left to do in order is to keep the place from going back and to claim each LiDAR frame once."""
    if not len(camera) or not len(lidar):
        return []
    aim = camera - offset
    nearest, last_of = nearest_places(aim, lidar)
    pairs = []
    for i, near in enumerate(nearest.tolist()):
        if place >= len(lidar):
            break
        place = int(last_of[max(place, near)])
        if abs(lidar[place] - aim[i]) <= window:
            pairs.append((i, place))
            place += 1
    return pairs


def entry_map(aim: np.ndarray, lidar: np.ndarray, window: float) -> tuple[list[int], list[int]]:
    """For each place at which matching can enter a piece, the place at which it leaves it and the pairs it makes there.

    Matching comes to a piece no farther than one past the last LiDAR frame within the window of the first aim. A later
    entry never falls behind an earlier one, and once both are at one place they stay together, so each entry is
    followed only until it meets the one before it.
    """
    if not len(lidar) or not len(aim):
        return [0], [0]
    nearest, last_of = (x.tolist() for x in nearest_places(aim, lidar))
    times, aims, n = lidar.tolist(), aim.tolist(), len(lidar)
    most = int(np.searchsorted(lidar, aim[0] + window, "right"))
    leaves, counts = [], []
    way, left = [-1] * len(aims), [0] * len(aims)  # of the entry before: the place after each aim, and the pairs made from there on
    for entry in range(most + 1):
        place, made, trail, met = entry, 0, [], None
        for i, x in enumerate(aims):
            if place >= n:
                break
            place = last_of[max(place, nearest[i])]
            if abs(times[place] - x) <= window:
                place, made = place + 1, made + 1
            trail.append((place, made))
            if place == way[i]:
                met = i
                break
        leave, total = (place, made) if met is None else (leaves[-1], made + left[met])
        for i, (at, so_far) in enumerate(trail):
            way[i], left[i] = at, total - so_far
        if met is None:
            for i in range(len(trail), len(aims)):
                way[i], left[i] = place, 0
        leaves.append(leave)
        counts.append(total)
    return leaves, counts


def _fold(both: DataFrame, key: str, window_s: float) -> DataFrame:
    """Pairs of long recordings, as ``monotonic_sync`` gives them; ``both``: key, id, t, seen, at (time less the offset for camera frames).

    A recording is cut by time. What matching carries along it is one whole number, the next LiDAR frame that is free, so
    each piece works out for itself where every possible entry leaves it; these maps, one short row a piece, are
    composed along the recording, and then all pieces know their entry and give their pairs. A piece needs the LiDAR
    frames within the window of its camera frames, its neighbours' included.
    """
    kind, name = (both.schema[c].dataType.simpleString() for c in ("id", key))
    reach = window_s * 1.001 + 1e-6
    cut = pieces.cut(both, key, "at", PIECE_ROWS)
    lidar = pieces.routed(cut, F.col("seen"), ~F.col("seen"), key, "at", reach, order=["id"]).select(key, "id", "t", "seen", "at", F.col("goal").alias("piece"), "index")
    met = cut.where("seen").withColumn("index", F.lit(None).cast("long")).select(key, "id", "t", "seen", "at", "piece", "index").unionByName(lidar)

    def piece_row(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("id", "ascending")])
        seen = table.column("seen").to_numpy(zero_copy_only=False).astype(bool)
        aim, times = (table.column("at").to_numpy()[m] for m in (seen, ~seen))
        base = int(pc.min(table.column("index")).as_py() or 0)
        leaves, counts = entry_map(aim, times, window_s)
        one = lambda x, m=None: pa.array([(x if m is None else x.filter(pa.array(m))).to_pylist()], pa.list_(x.type))
        return pa.table({
            key: table.column(key).slice(0, 1), "piece": table.column("piece").slice(0, 1), "base": pa.array([base]), "camera": one(table.column("id"), seen), "aim": pa.array([aim]),
            "seen_at": one(table.column("t"), seen), "lidar": one(table.column("id"), ~seen), "time": pa.array([times]), "leaves": pa.array([leaves], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())),
        })

    arrays = f"{key} {name}, piece int, base long, camera array<{kind}>, aim array<double>, seen_at array<double>, lidar array<{kind}>, time array<double>, leaves array<long>, counts array<long>"
    rows = written(met.groupBy(key, "piece").applyInArrow(piece_row, arrays).where(F.size("camera") > 0))

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        entries, before, place, made = [], [], 0, 0
        for base, leaves, counts in zip(*(table.column(c).to_pylist() for c in ("base", "leaves", "counts"))):
            entries.append(place)
            before.append(made)
            at = min(max(place - base, 0), len(leaves) - 1)
            place, made = max(place, base + leaves[at]), made + counts[at]
        return pa.table({"of": table.column(key), "at_piece": table.column("piece"), "entry": pa.array(entries, pa.int64()), "made": pa.array(before, pa.int64())})

    known = written(rows.select(key, "piece", "base", "leaves", "counts").groupBy(key).applyInArrow(compose, f"of {name}, at_piece int, entry long, made long"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: batch.column(c)[i] for c in batch.schema.names}
                aim, times = (own[c].values.to_numpy() for c in ("aim", "time"))
                place = min(max(own["entry"].as_py() - own["base"].as_py(), 0), len(times))
                found = match_in_order(aim, times, window_s, 0.0, place)
                left, right = pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())
                index = np.arange(len(found)) + own["made"].as_py()
                seen_at = own["seen_at"].values.take(left)
                keys = pa.array([own[key].as_py()] * len(found), batch.schema.field(key).type)
                yield pa.RecordBatch.from_arrays([keys, pa.array(index, pa.int64()), own["camera"].values.take(left), own["lidar"].values.take(right), seen_at, pa.array(times[right.to_numpy()])], [key, "frame_index", "camera_id", "lidar_id", "t", "lidar_t"])

    joined = pieces.told(rows.drop("leaves", "counts"), known, key)
    out = joined.mapInArrow(pairs, f"{key} {name}, frame_index long, camera_id {kind}, lidar_id {kind}, t double, lidar_t double")
    return out.select(key, "frame_index", "camera_id", "lidar_id", "t", (F.col("t") - F.col("lidar_t")).alias("diff_s"))


def monotonic_sync(camera: DataFrame, lidar: DataFrame, window_s: float, key: str = "rig") -> DataFrame:
    """key, frame_index, camera_id, lidar_id, t, diff_s (camera less LiDAR): each frame in at most one pair, both sides ascending.

    Both inputs: key, id, t. The window counts after the offset (the median of all nearest differences); where the offset
    leaves no pair at all, it is taken as 0. Matching is a fold over time: recordings of up to 200,000 frames are one task's
    work each, longer ones are folded in pieces side by side (``_fold``). Null times are left out.
    """
    both = camera.select(key, "id", "t", F.lit(True).alias("seen")).unionByName(lidar.select(key, "id", "t", F.lit(False).alias("seen"))).where("t is not null")
    if pieces.longest(both, key) <= PIECE_ROWS:
        return _in_one_task(both, key, window_s)
    both = written(both)
    near = nearest_of_any(both.where("seen"), both.where("not seen"), key)
    offset = written(exact_percentiles(near, key, "diff_s", {"offset": 0.5}).select(F.col(key).alias("of"), "offset"))
    told = both.join(broadcast_within(offset, pieces.BROADCAST_PIECES), pieces.same(key, "of"))
    first = written(_fold(told.withColumn("at", F.when(F.col("seen"), F.col("t") - F.col("offset")).otherwise(F.col("t"))).select(key, "id", "t", "seen", "at"), key, window_s))
    met = first.select(F.col(key).alias("of")).distinct()
    rest = told.where("offset <> 0").drop("of").join(met, pieces.same(key, "of"), "left_anti")
    if rest.isEmpty():
        return first
    return first.unionByName(_fold(rest.withColumn("at", F.col("t")).select(key, "id", "t", "seen", "at"), key, window_s))


def _in_one_task(both: DataFrame, key: str, window_s: float) -> DataFrame:
    def task(table: pa.Table) -> pa.Table:
        t, seen = table.column("t").to_numpy(), table.column("seen").to_numpy(zero_copy_only=False)
        order = np.lexsort([table.column("id").to_numpy(), t])
        cam, lid = order[seen[order]], order[~seen[order]]
        offset = coarse_offset(t[cam], t[lid])
        pairs = match_in_order(t[cam], t[lid], window_s, offset)
        if not pairs and offset:
            pairs = match_in_order(t[cam], t[lid], window_s, 0.0)
        left, right = cam[[i for i, _ in pairs]].astype(int), lid[[j for _, j in pairs]].astype(int)
        ids = table.column("id")
        return pa.table({
            key: table.column(key).take(pa.array(left)), "frame_index": pa.array(np.arange(len(pairs))), "camera_id": ids.take(pa.array(left)), "lidar_id": ids.take(pa.array(right)),
            "t": pa.array(t[left]), "diff_s": pa.array(t[left] - t[right]),
        })

    kind, name = (both.schema[c].dataType.simpleString() for c in ("id", key))
    return both.groupBy(key).applyInArrow(task, f"{key} {name}, frame_index long, camera_id {kind}, lidar_id {kind}, t double, diff_s double")


def sync_summary(pairs: DataFrame, camera: DataFrame, lidar: DataFrame, window_s: float, keys: tuple[str, ...] = ("rig",)) -> DataFrame:
    """A row for each rig seen by either stream: counts, means, offset, deviation, drop ratio, class and warnings."""
    keys = list(keys)
    counts = camera.groupBy(*keys).agg(F.count("*").alias("camera_frames")).join(lidar.groupBy(*keys).agg(F.count("*").alias("lidar_frames")), keys, "full_outer") if keys else (
        camera.agg(F.count("*").alias("camera_frames")).crossJoin(lidar.agg(F.count("*").alias("lidar_frames")))
    )
    near = F.abs("diff_s")
    met = pairs.groupBy(*keys).agg(
        F.count("*").alias("matched"), F.avg(near).alias("mean_abs_s"), F.max(near).alias("max_abs_s"), F.avg("diff_s").alias("offset_s"), F.stddev_pop("diff_s").alias("std_s")
    )
    zero = F.lit(0).cast("long")
    out = (counts.join(met, keys, "left") if keys else counts.crossJoin(met)).withColumns({c: F.coalesce(c, zero) for c in ("camera_frames", "lidar_frames", "matched")})
    out = out.withColumns({
        "camera_dropped": F.col("camera_frames") - F.col("matched"), "lidar_dropped": F.col("lidar_frames") - F.col("matched"),
        "drop_ratio": 1 - F.col("matched") / F.greatest("camera_frames", F.lit(1)),
    })
    poor = F.when(F.col("matched") == 0, "no pairs matched").when(F.col("drop_ratio") > POOR_DROP, "synchronisation is poor")
    large = F.when(F.abs("offset_s") > LARGE_OFFSET * window_s, "offset is large against the window")
    return out.withColumns({"classification": sync_class(window_s), "warnings": F.array_compact(F.array(poor, large))})


def sync_class(window_s: float) -> Column:
    """FAIL without pairs, else the worse of the share dropped and the deviation against the window."""
    level = lambda c, bounds: F.when(c <= bounds[0], 0).when(c <= bounds[1], 1).otherwise(2)
    spread = F.coalesce(F.col("std_s"), F.lit(0.0)) / window_s if window_s > 0 else F.lit(0.0)
    return F.when(F.col("matched") == 0, "FAIL").otherwise(named(F.greatest(level(F.col("drop_ratio"), DROP_BOUNDS), level(spread, SPREAD_BOUNDS))))
