"""Errors over frames: hold-out blocks, robust outliers, drift, and nearest-in-time matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import written
from . import sync
from .noise_floor import Floor, classify, severity
from .order_statistics import exact_percentiles

MAD_FACTOR = 1.4826
#: Ranges of the index that time_blocks counts in.
RANGES = 4096
#: Degrees of freedom beyond which Student's distribution is taken as normal.
SERIES = 10_000


def time_blocks(frames: DataFrame, blocks: int) -> DataFrame:
    """Adds block (1..blocks): contiguous runs of frames by frame_index, the first ones longer by one; equal indices in any order.

    Frames are dealt to ranges of the index and counted in each; only the counts of the ranges meet in one place.
    """
    if blocks < 1:
        raise ValueError("at least one block is needed")
    ranged = frames.select(F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"), F.count("*").alias("n"))
    slot = F.floor((F.col("frame_index") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) * (RANGES - 1)).cast("int")
    placed = frames.crossJoin(F.broadcast(ranged)).withColumn("slot", slot)  # one-row side
    before = F.coalesce(F.sum("c").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # RANGES rows at most
    counts = placed.groupBy("slot").agg(F.count("*").alias("c")).select("slot", before.alias("before"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("slot").orderBy("frame_index")) - 1
    size, longer = F.floor(F.col("n") / blocks), F.col("n") % blocks
    block = F.when(F.col("at") < longer * (size + 1), F.floor(F.col("at") / (size + 1))).otherwise(longer + F.floor((F.col("at") - longer * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    return placed.join(F.broadcast(counts), "slot").withColumn("at", at).select(*frames.columns, block.cast("int").alias("block"))


def block_summary(frames: DataFrame, min_frames: int = 30) -> DataFrame:
    """block, frames, status and the mean of its frames' means and the median of their floors: a quick look, not M3, which pools points (``pooled_blocks``)."""
    grouped = frames.groupBy("block").agg(F.count("*").alias("frames"), F.avg("mean_px").alias("mean_px"), F.expr("percentile(floor_px, 0.5)").alias("floor_px"))
    short = F.col("frames") < min_frames
    return grouped.select("block", "frames", F.when(short, "EXCLUDED").otherwise("VALID").alias("status"), F.when(~short, F.col("mean_px")).alias("mean_px"), F.when(~short, F.col("floor_px")).alias("floor_px"))


def pooled_blocks(frames: DataFrame, points: DataFrame, floor: Floor, width: int, height: int, min_frames: int = 30) -> DataFrame:
    """M3 of each block: counts, pooled errors of the points of its valid frames, their scene's traits and the class.

    ``frames``: block, frame_id, classification, representative_depth_m, num_edge_points, num_projected, and
    dynamic_ratio if a motion mask was used; ``points``: frame_id, u, v, error_px. A block with fewer than
    ``min_frames`` frames is EXCLUDED, one whose frames all failed FAIL.
    """
    valid = frames.where("classification <> 'FAIL'")
    dynamic = "dynamic_ratio" if "dynamic_ratio" in frames.columns else None
    counts = frames.groupBy("block").agg(F.count("*").alias("frames"), F.count_if(F.col("classification") != "FAIL").alias("valid_frames"))
    scene = valid.groupBy("block").agg(
        F.expr("percentile(representative_depth_m, 0.5)").alias("depth_m"), F.sum("num_edge_points").alias("edge_points"), F.avg("num_edge_points").alias("edge_density"),
        F.avg("num_projected").alias("points_avg"), (F.avg(dynamic) if dynamic else F.lit(None).cast("double")).alias("dynamic_ratio"),
    )
    mine = points.join(valid.select("frame_id", "block"), "frame_id")
    area = (F.max("u") - F.min("u")) * (F.max("v") - F.min("v")) / (width * height)
    errors = mine.groupBy("block").agg(F.avg("error_px").alias("mean_px"), area.alias("fov_coverage"))
    ranks = exact_percentiles(mine, "block", "error_px", {"median_px": 0.5, "p95_px": 0.95})
    out = counts.join(scene, "block", "left").join(errors, "block", "left").join(ranks, "block", "left")
    short = F.col("frames") < min_frames
    measured = ("depth_m", "edge_density", "points_avg", "dynamic_ratio", "mean_px", "fov_coverage", "median_px", "p95_px", "edge_points")
    out = out.withColumns({c: F.when(~short, F.col(c)) for c in measured}).withColumn("floor_px", floor.at(F.col("depth_m")))
    return out.withColumn("classification", F.when(short, "EXCLUDED").otherwise(classify(F.col("mean_px"), F.col("floor_px"))))


#: Traits of a scene and what being far above or below the other blocks' median is called.
TRAITS = (
    ("depth_m", "Long-range scenes", "Short-range scenes"), ("edge_density", "Dense edge structure", "Sparse edge structure"),
    ("points_avg", "Dense point cloud", "Sparse point cloud"), ("fov_coverage", "Wide FOV coverage", "Narrow FOV coverage"),
)


def instability(blocks: DataFrame, threshold: float = 0.5, min_blocks: int = 3) -> DataFrame:
    """rank, worst_block, metric, worst_value, others_median, relative_diff, explanation: how the worst block's scene differs.

    The worst has the largest mean (of equals the first block); traits within ``threshold`` of the others' median are
    left out, the farthest comes first. Empty with fewer than ``min_blocks`` valid blocks. Blocks are few.
    """
    valid = blocks.where("classification in ('GOOD', 'WARNING', 'BAD')")
    worst = valid.agg(F.count("*").alias("n"), F.max_by("block", F.struct(F.col("mean_px"), -F.col("block"))).alias("worst_block")).where(F.col("n") >= min_blocks)
    traits = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(hi).alias("above"), F.lit(lo).alias("below")) for i, (m, hi, lo) in enumerate(TRAITS)]))
    long = valid.crossJoin(F.broadcast(worst)).select("block", "worst_block", traits.alias("t")).select("block", "worst_block", "t.*")  # one-row side
    mine = F.col("block") == F.col("worst_block")
    both = long.groupBy("i", "metric", "above", "below", "worst_block").agg(F.max(F.when(mine, F.col("value"))).alias("worst_value"), F.median(F.when(~mine, F.col("value"))).alias("others_median"))
    both = both.where(F.abs("others_median") >= 1e-9).withColumn("relative_diff", (F.col("worst_value") - F.col("others_median")) / F.abs("others_median"))
    both = both.where(F.abs("relative_diff") >= threshold)
    order = F.row_number().over(Window.orderBy(F.abs("relative_diff").desc(), "i"))  # four rows at most
    return both.select(order.alias("rank"), "worst_block", "metric", "worst_value", "others_median", "relative_diff", F.when(F.col("relative_diff") > 0, F.col("above")).otherwise(F.col("below")).alias("explanation"))


def holdout_overall(blocks: DataFrame, min_blocks: int = 3) -> DataFrame:
    """One row: valid blocks, mean, sample deviation and range of their pooled means, median of their floors, and the class by 1 and 3 floors.

    ``blocks`` is what ``pooled_blocks`` gives; EXCLUDED and FAIL ones don't count. FAIL and no figures below ``min_blocks``.
    """
    v = blocks.where("classification in ('GOOD', 'WARNING', 'BAD')")
    one = v.agg(F.count("*").alias("valid_blocks"), F.avg("mean_px").alias("mean_px"), F.stddev_samp("mean_px").alias("std_px"), (F.max("mean_px") - F.min("mean_px")).alias("range_px"), F.median("floor_px").alias("floor_px"))
    enough = F.col("valid_blocks") >= min_blocks
    one = one.withColumns({c: F.when(enough, F.col(c)) for c in ("mean_px", "std_px", "range_px", "floor_px")})
    return one.withColumn("classification", F.when(enough, classify(F.col("std_px"), F.col("floor_px"), 1.0, 3.0)).otherwise("FAIL"))


def robust_stats(frames: DataFrame) -> DataFrame:
    """One row: n, median, scaled MAD, quartiles; all null but n without frames. Frames are worked out once."""
    frames = written(frames.select("mean_px"))
    whole = frames.select(F.lit(1).alias("k"), "mean_px")
    quartiles = exact_percentiles(whole, "k", "mean_px", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    away = whole.join(F.broadcast(quartiles.select("k", "median")), "k").select("k", F.abs(F.col("mean_px") - F.col("median")).alias("away"))  # one-row side
    spread = exact_percentiles(away, "k", "away", {"m": 0.5})
    total = frames.agg(F.count("mean_px").alias("n")).withColumn("k", F.lit(1))
    one = total.join(quartiles, "k", "left").join(spread, "k", "left")
    return one.select("n", "median", (F.col("m") * MAD_FACTOR).alias("mad"), "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))


def outliers(frames: DataFrame, rule: str = "hampel", hampel_k: float = 3.0, multiplier: float = 5.0, iqr_k: float = 1.5) -> DataFrame:
    """Frames with z (null without spread) and is_outlier by one of hampel, multiplier, iqr; degenerate spreads have fixed margins."""
    x, m = F.col("mean_px"), F.col("median")
    tests = {
        "hampel": F.abs(x - m) > F.when(F.col("mad") > 1e-6, hampel_k * F.col("mad")).otherwise(F.greatest(F.lit(0.05), 0.05 * F.abs(m))),
        "multiplier": x > F.when(m > 1e-6, multiplier * m).otherwise(max(0.1 * multiplier, 0.5)),
        "iqr": F.when(F.col("iqr") > 1e-6, (x < F.col("q1") - iqr_k * F.col("iqr")) | (x > F.col("q3") + iqr_k * F.col("iqr"))).otherwise(F.abs(x - m) > 0.5),
    }
    z = F.when(F.col("mad") > 1e-9, (x - m) / F.col("mad"))
    return frames.crossJoin(F.broadcast(robust_stats(frames))).withColumns({"z": z, "is_outlier": tests[rule]}).drop("n", "median", "mad", "q1", "q3", "iqr")


def multiframe(frames: DataFrame, rule: str = "hampel", min_frames: int = 30, **bounds: float) -> DataFrame:
    """M4 in one row: counts, ratios, mean, sample deviation, percentiles, robust figures, floor and class by 1 and 3 floors.

    ``frames``: frame_index, mean_px, floor_px, classification. FAIL with fewer than ``min_frames`` frames or two valid ones.
    """
    valid = frames.where("classification <> 'FAIL'")
    marked = outliers(valid, rule, **bounds)
    counts = frames.agg(F.count("*").alias("frames"), F.count_if(F.col("classification") != "FAIL").alias("valid_frames"))
    sums = marked.agg(F.avg("mean_px").alias("mean_px"), F.stddev_samp("mean_px").alias("std_px"), F.max("mean_px").alias("max_px"), F.count_if("is_outlier").alias("outlier_frames"))
    high = exact_percentiles(valid.select(F.lit(1).alias("k"), "mean_px"), "k", "mean_px", {"p95_px": 0.95}).drop("k")
    low = exact_percentiles(valid.select(F.lit(1).alias("k"), "floor_px"), "k", "floor_px", {"floor_px": 0.5}).drop("k")
    one = counts.crossJoin(sums).crossJoin(robust_stats(valid).drop("n"))  # one row each
    one = one.withColumn("k", F.lit(1)).join(high.withColumn("k", F.lit(1)), "k", "left").join(low.withColumn("k", F.lit(1)), "k", "left").drop("k")
    enough = (F.col("frames") >= min_frames) & (F.col("valid_frames") >= 2)
    measured = ("mean_px", "std_px", "max_px", "median", "mad", "q1", "q3", "iqr", "p95_px", "floor_px")
    one = one.withColumns({c: F.when(enough, F.col(c)) for c in measured}).withColumn("outlier_frames", F.when(enough, F.col("outlier_frames")).otherwise(F.lit(0).cast("long")))
    share = lambda a, b: F.when(F.col("frames") >= min_frames, F.try_divide(F.col(a), F.col(b)))
    one = one.withColumns({
        "failed_frames": F.col("frames") - F.col("valid_frames"), "valid_ratio": share("valid_frames", "frames"), "failure_ratio": 1 - share("valid_frames", "frames"),
        "outlier_ratio": F.when(enough, F.try_divide("outlier_frames", "valid_frames")), "classification": F.when(enough, classify(F.col("std_px"), F.col("floor_px"), 1.0, 3.0)).otherwise("FAIL"),
    })
    return one


def drift(frames: DataFrame, floor_px: Column | None = None, alpha: float = 0.05, min_frames: int = 5) -> DataFrame:
    """One row: n, slope, r, t statistic, p value, the drift over the whole span, and the class.

    Frames classified FAIL and those without a mean don't count. A slope that is not significant is GOOD; else the drift
    is judged by 1 and 3 median floors (``floor_px`` overrides them). FAIL, without figures, with fewer than
    ``min_frames`` frames or all at one index.
    """
    frames = frames.where("mean_px is not null and frame_index is not null")
    if "classification" in frames.columns:
        frames = frames.where("classification <> 'FAIL'")
    fit = frames.agg(F.count("*").alias("n"), F.covar_pop("mean_px", "frame_index").alias("c"), F.var_pop("frame_index").alias("vx"), F.var_pop("mean_px").alias("vy"), (F.max("frame_index") - F.min("frame_index")).alias("span"))
    fit = fit.select("n", "span", F.when(F.col("vx") > 0, F.col("c") / F.col("vx")).alias("slope"), F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).alias("r"))
    if floor_px is None and "floor_px" in frames.columns:
        middle = exact_percentiles(frames.select(F.lit(1).alias("k"), "floor_px"), "k", "floor_px", {"floor_px": 0.5})
        fit = fit.withColumn("k", F.lit(1)).join(middle, "k", "left").drop("k")
    else:
        fit = fit.withColumn("floor_px", floor_px if floor_px is not None else F.lit(None).cast("double"))
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    one = fit.withColumns({"t_stat": t, "drift_px": F.abs("slope") * F.col("span")})
    one = one.withColumn("p_value", F.when(F.abs("r") >= 1, F.lit(0.0)).otherwise(two_sided_p(F.col("t_stat"), F.col("n") - 2)))
    fails = (F.col("n") < min_frames) | F.coalesce(F.col("span") == 0, F.lit(True))
    significant = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    kind = F.when(fails, "FAIL").when(~significant, "GOOD").otherwise(classify(F.col("drift_px"), F.col("floor_px"), 1.0, 3.0))
    figures = [F.when(~fails, F.col(c)).alias(c) for c in ("slope", "r", "t_stat", "p_value", "drift_px", "floor_px")]
    return one.select("n", *figures, (significant & ~fails).alias("significant"), kind.alias("classification"))


def two_sided_p(t: Column, degrees: Column) -> Column:
    """p of Student's t with a whole number of degrees of freedom: the finite series in the angle atan(t / sqrt(degrees)).

    More than 10,000 degrees count as 10,000: beyond that t is as good as normal.
    """
    degrees = F.least(degrees.cast("long"), F.lit(SERIES))
    angle = F.atan(F.abs(t) / F.sqrt(degrees))
    c2, odd = F.cos(angle) ** 2, degrees % 2 == 1
    steps = F.when(degrees < 4, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(2), (degrees - F.when(odd, 3).otherwise(2)).cast("int"), F.lit(2)))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(a: Column, i: Column) -> Column:
        grown = a["term"] * c2 * F.when(odd, i / (i + 1.0)).otherwise((i - 1.0) / i)
        return F.struct(grown.alias("term"), (a["total"] + grown).alias("total"))

    total = F.aggregate(steps, start, step, lambda a: a["total"])
    inside_odd = 2 / F.pi() * (angle + F.when(degrees > 1, F.sin(angle) * F.cos(angle) * total).otherwise(0.0))
    inside = F.when(odd, inside_odd).otherwise(F.sin(angle) * total)
    return F.when(degrees >= 1, F.greatest(F.lit(0.0), 1 - inside))


def nearest_in_time(left: DataFrame, right: DataFrame, bucket_s: float) -> DataFrame:
    """For each left (id, t) the nearest right one within ``bucket_s`` seconds: left_id, right_id, diff_s (right minus left); of equal ones the earlier.

    Right rows of one time are one row, that of the smallest id; both streams are then one ordered run, or pieces of
    one, in which each left row meets the right row before and the one after it. So the work does not grow with how
    many rows lie within ``bucket_s``.
    """
    l = left.select(F.lit(0).alias("run"), "id", "t")
    r = right.groupBy("t").agg(F.min("id").alias("id")).select(F.lit(0).alias("run"), "id", "t")
    near = sync.beside(l, r, "run").withColumn("m", sync.nearer_side()).where("m is not null").withColumn("diff_s", F.col("m.t") - F.col("t")).where(F.abs("diff_s") <= bucket_s)
    best = F.min(F.struct(F.abs("diff_s").alias("d"), F.col("m.t").alias("rt"), F.col("m.id").alias("right_id"), F.col("diff_s")))
    return near.groupBy(F.col("id").alias("left_id")).agg(best.alias("m")).select("left_id", "m.right_id", "m.diff_s")


def report_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, scores, classes and regressed of two reports' categories (name, score, classification); a missing or unknown class counts as FAIL."""
    both = old.select("name", F.col("score").alias("old_score"), F.col("classification").alias("old_class")).join(
        new.select("name", F.col("score").alias("new_score"), F.col("classification").alias("new_class")), "name", "full_outer"
    )
    a, b = severity(F.col("old_class")), severity(F.col("new_class"))
    lower = F.coalesce(F.col("new_score") < F.col("old_score"), F.lit(False))
    return both.withColumns({"delta_score": F.col("new_score") - F.col("old_score"), "regressed": (b > a) | ((a == b) & lower)})
