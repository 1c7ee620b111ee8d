"""Queries over the driver's tables, with the SQL that checks them.

The tables are turned into sensor views: order lines are LiDAR points, groups of
suppliers frames, days of orders frames of a sequence, events two streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import matching, motion, noise_floor, projection, radius, scans, sensitivity, spatial, stability
from .registry import ORACLES, QUERIES
from .registry import query as _query
from .registry import rounded as _r

SHIFT = (1, 0, 0, 0.2, 0, 1, 0, -0.1, 0, 0, 1, 0.1)
PLAIN = projection.Rig(320, 240, 150.0, 150.0, 160.0, 120.0, SHIFT)
BENT = projection.Rig(320, 240, 150.0, 150.0, 160.0, 120.0, SHIFT, "plumb_bob", {"k1": -0.1, "k2": 0.01, "p1": 0.001, "p2": -0.002})
FISHEYE = projection.Rig(320, 240, 150.0, 150.0, 160.0, 120.0, SHIFT, "fisheye", {"k1": 0.02, "k2": -0.003})
FLOOR = noise_floor.Floor(150.0, baseline_m=0.2449489742783178)
KEYS = ["frame_id", "point_id"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, point_id, x, y, z, error, matched. An order's lines differ in price, so order and cents name a point."""
    l = _table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    u0 = cents % 32000 / 100.0
    v0 = (F.col("l_partkey") * 7919 + F.col("l_orderkey") * 104729 + F.col("l_linenumber") * 31) % 24000 / 100.0
    return l.select(
        F.expr("l_suppkey div 25").alias("frame_id"), (F.col("l_orderkey") * 100_000_000 + cents).alias("point_id"),
        ((u0 - 160) * F.col("l_quantity") / 150).alias("x"), ((v0 - 120) * F.col("l_quantity") / 150).alias("y"), F.col("l_quantity").alias("z"),
        (F.col("l_tax") * 100).alias("error"), (F.col("l_returnflag") != "R").alias("matched"),
    )


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the image, by what the radius join needs of them."""
    return projection.project(points(spark, sf_dir), PLAIN).select(*KEYS, "u", "v", "depth")


_PTS = """
pts AS (
  SELECT l_suppkey // 25 AS frame_id, l_orderkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS point_id,
    (CAST(round(l_extendedprice * 100) AS BIGINT) % 32000 / 100.0 - 160) * l_quantity / 150 AS x,
    ((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 31) % 24000 / 100.0 - 120) * l_quantity / 150 AS y,
    l_quantity AS z, l_tax * 100 AS error, l_returnflag <> 'R' AS matched
  FROM lineitem),
cam AS (SELECT *, x + 0.2 AS xc, y - 0.1 AS yc, z + 0.1 AS zc FROM pts),
proj AS (
  SELECT * FROM (SELECT *, 150 * (xc / zc) + 160 AS u, 150 * (yc / zc) + 120 AS v, zc AS depth FROM cam WHERE zc > 0.05)
  WHERE u >= 0 AND u < 320 AND v >= 0 AND v < 240)"""
_EDGES = """,
cell AS (SELECT *, floor(u / 3) AS gx, floor(v / 3) AS gy FROM proj),
near AS (
  SELECT a.point_id, a.frame_id, count(*) AS n, min(b.depth) AS low, max(b.depth) AS high
  FROM cell a, (SELECT unnest([-1, 0, 1]) AS i) i, (SELECT unnest([-1, 0, 1]) AS j) j, cell b
  WHERE a.frame_id = b.frame_id AND b.gx = a.gx + i.i AND b.gy = a.gy + j.j AND (a.u - b.u) ** 2 + (a.v - b.v) ** 2 <= 9
  GROUP BY ALL),
edge AS (SELECT proj.* FROM proj JOIN near USING (frame_id, point_id) WHERE n >= 3 AND high - low > 0.3 AND depth <= low + 1e-9)"""


@_query(f"WITH {_PTS} SELECT frame_id, point_id, round(u, 5) AS u, round(v, 5) AS v, round(depth, 5) AS depth FROM proj")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.project(points(spark, sf_dir), PLAIN).select(*KEYS, *_r("u", "v", "depth"))


@_query(f"""WITH {_PTS}, ab AS (SELECT *, xc / zc AS a, yc / zc AS b FROM cam WHERE zc > 0.05), r AS (SELECT *, a * a + b * b AS r2 FROM ab),
uv AS (SELECT *, 150 * (a * (1 - 0.1 * r2 + 0.01 * r2 * r2) + 0.002 * a * b - 0.002 * (r2 + 2 * a * a)) + 160 AS u,
  150 * (b * (1 - 0.1 * r2 + 0.01 * r2 * r2) + 0.001 * (r2 + 2 * b * b) - 0.004 * a * b) + 120 AS v FROM r)
SELECT frame_id, point_id, round(u, 5) AS u, round(v, 5) AS v, round(zc, 5) AS depth FROM uv WHERE u >= 0 AND u < 320 AND v >= 0 AND v < 240""")
def project_distorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.project(points(spark, sf_dir), BENT).select(*KEYS, *_r("u", "v", "depth"))


@_query(f"""WITH {_PTS}, ab AS (SELECT *, xc / zc AS a, yc / zc AS b FROM cam WHERE zc > 0.05), r AS (SELECT *, sqrt(a * a + b * b) AS r FROM ab),
s AS (SELECT *, CASE WHEN r > 1e-8 THEN atan(r) * (1 + 0.02 * atan(r) ** 2 - 0.003 * atan(r) ** 4) / r ELSE 1 END AS s FROM r),
uv AS (SELECT *, 150 * (a * s) + 160 AS u, 150 * (b * s) + 120 AS v FROM s)
SELECT frame_id, point_id, round(u, 5) AS u, round(v, 5) AS v, round(zc, 5) AS depth FROM uv WHERE u >= 0 AND u < 320 AND v >= 0 AND v < 240""")
def project_fisheye(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.project(points(spark, sf_dir), FISHEYE).select(*KEYS, *_r("u", "v", "depth"))


@_query(f"""WITH {_PTS}, low AS (SELECT *, min(depth) OVER (PARTITION BY frame_id, floor(u / 8), floor(v / 8)) AS low FROM proj)
SELECT frame_id, count(*) AS n, round(count_if(depth > low + 0.5) / count(*), 6) AS ratio FROM low GROUP BY frame_id""")
def occlusion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.occlusion(projection.project(points(spark, sf_dir), PLAIN)).select("frame_id", "n", *_r("ratio", digits=6))


@_query(f"WITH {_PTS}{_EDGES} SELECT frame_id, point_id, round(u, 5) AS u, round(v, 5) AS v, round(depth, 5) AS depth FROM edge")
def edge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radius.edge_points(_placed(spark, sf_dir)).select(*KEYS, *_r("u", "v", "depth"))


_FLOOR = "sqrt((150 * radians(0.2)) ** 2 + 0.25 + (150 * 0.2449489742783178 * 0.02 / ({0} * {0})) ** 2)"


@_query(f"""WITH {_PTS}{_EDGES}, frames AS (SELECT DISTINCT frame_id FROM pts), np AS (SELECT frame_id, count(*) AS n FROM proj GROUP BY 1),
ne AS (SELECT frame_id, count(*) AS n, quantile_cont(depth, 0.5) AS d FROM edge GROUP BY 1)
SELECT frame_id, coalesce(np.n, 0) AS num_projected, coalesce(ne.n, 0) AS num_edge_points, round(d, 5) AS representative_depth_m,
  round({_FLOOR.format('d')}, 5) AS floor_px FROM frames LEFT JOIN np USING (frame_id) LEFT JOIN ne USING (frame_id)""")
def m2_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = points(spark, sf_dir)
    placed = _placed(spark, sf_dir)
    edges = radius.edge_points(placed).groupBy("frame_id").agg(F.count("*").alias("e"), F.expr("percentile(depth, 0.5)").alias("d"))
    frames = pts.select("frame_id").distinct().join(placed.groupBy("frame_id").agg(F.count("*").alias("n")), "frame_id", "left").join(edges, "frame_id", "left")
    zero = F.lit(0).cast("long")
    return frames.select(
        "frame_id", F.coalesce("n", zero).alias("num_projected"), F.coalesce("e", zero).alias("num_edge_points"), F.round("d", 5).alias("representative_depth_m"),
        F.round(FLOOR.at(F.col("d")), 5).alias("floor_px"),
    )


@_query(f"""WITH {_PTS}, f AS (SELECT *, {_FLOOR.format('depth')} AS fl, 150 * 0.2449489742783178 * 0.02 / (depth * depth) AS rg FROM proj),
s AS (SELECT *, 100 / (1 + (error / fl / 5) ** (ln(0.25) / ln(0.4))) AS sc FROM f)
SELECT frame_id, point_id, round(fl, 5) AS floor_px, CASE WHEN 150 * radians(0.2) >= rg AND 150 * radians(0.2) >= 0.5 THEN 'angular' WHEN rg >= 0.5 THEN 'range' ELSE 'edge' END AS dominant,
  CASE WHEN error < 2 * fl THEN 'GOOD' WHEN error < 5 * fl THEN 'WARNING' ELSE 'BAD' END AS classification, round(sc, 4) AS score FROM s""")
def floor_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    floor = FLOOR.at(F.col("depth"))
    return projection.project(points(spark, sf_dir), PLAIN).select(
        *KEYS, F.round(floor, 5).alias("floor_px"), FLOOR.dominant(F.col("depth")).alias("dominant"),
        noise_floor.classify(F.col("error"), floor).alias("classification"), F.round(noise_floor.score(F.col("error"), floor), 4).alias("score"),
    )


_STATS = """round(avg(error) FILTER (matched), 5) AS mean_px, round(quantile_cont(error, 0.5) FILTER (matched), 5) AS median_px,
  round(quantile_cont(error, 0.95) FILTER (matched), 5) AS p95_px, round(stddev_pop(error) FILTER (matched), 5) AS std_px,
  count_if(matched)::BIGINT AS valid, count_if(NOT matched)::BIGINT AS failed"""
_NAMES = ("mean_px", "median_px", "p95_px", "std_px")
_DEPTH = "CASE WHEN depth < 10 THEN '0-10m' WHEN depth < 20 THEN '10-20m' WHEN depth < 30 THEN '20-30m' WHEN depth < 50 THEN '30-50m' ELSE '50m+' END"


def _depth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = projection.project(points(spark, sf_dir), PLAIN).withColumn("label", spatial.depth_bin(F.col("depth")))
    return spatial.error_stats(placed, [b[2] for b in spatial.DEPTH_BINS])


@_query(f"WITH {_PTS} SELECT {_DEPTH} AS label, {_STATS} FROM proj GROUP BY 1")
def depth_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depth_stats(spark, sf_dir).select("label", *_r(*_NAMES), "valid", "failed")


@_query(f"""WITH {_PTS}, s AS (SELECT {_DEPTH} AS label, min(depth) AS d, avg(error) FILTER (matched) AS m FROM proj GROUP BY 1),
t AS (SELECT m - lag(m) OVER (ORDER BY d) AS step FROM s WHERE m IS NOT NULL)
SELECT count(*) AS bins, CASE WHEN count(*) < 3 THEN NULL WHEN min(step) >= -1e-9 THEN 'increases_with_depth' WHEN max(step) <= 1e-9 THEN 'decreases_with_depth' ELSE 'stable' END AS trend FROM t""")
def depth_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.depth_trend(_depth_stats(spark, sf_dir))


def _region_sql(at: str, extent: int, names: list[str]) -> str:
    return f"WITH {_PTS} SELECT {names}[least(greatest(floor({at} / ({extent} / 3)), 0), 2)::INT + 1] AS label, {_STATS} FROM proj GROUP BY 1"


@_query(_region_sql("u", 320, ["LEFT", "CENTER", "RIGHT"]))
def horizontal_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("LEFT", "CENTER", "RIGHT")
    placed = projection.project(points(spark, sf_dir), PLAIN).withColumn("label", spatial.third(F.col("u"), 320, names))
    return spatial.error_stats(placed, list(names)).select("label", *_r(*_NAMES), "valid", "failed")


@_query(_region_sql("v", 240, ["TOP", "CENTER", "BOTTOM"]))
def vertical_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("TOP", "CENTER", "BOTTOM")
    placed = projection.project(points(spark, sf_dir), PLAIN).withColumn("label", spatial.third(F.col("v"), 240, names))
    return spatial.error_stats(placed, list(names)).select("label", *_r(*_NAMES), "valid", "failed")


@_query(f"""WITH {_PTS} SELECT frame_id, least(floor(v * 6 / 240), 5)::INT AS row, least(floor(u * 8 / 320), 7)::INT AS col, count(*) AS n,
  CASE WHEN count(*) >= 3 THEN round(avg(error), 5) END AS mean_px FROM proj GROUP BY 1, 2, 3""")
def error_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.error_grid(projection.project(points(spark, sf_dir), PLAIN), 320, 240).select("frame_id", "row", "col", "n", *_r("mean_px"))


_CELLS = """, cells AS (SELECT *, sqrt(x ** 2 + y ** 2 + z ** 2) AS range_m,
  least(greatest(floor((atan2(z, sqrt(x ** 2 + y ** 2)) + radians(60) / 2) / radians(60) * 32), 0), 31)::INT AS ring,
  least(greatest(floor((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END) / (2 * pi()) * 900), 0), 899)::INT AS az FROM pts),
img AS (SELECT frame_id, ring, az, min(range_m) AS range_m, arg_min(point_id, (range_m, point_id)) AS point_id FROM cells GROUP BY ALL)"""


def _image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.range_image(scans.with_cells(points(spark, sf_dir)))


@_query(f"WITH {_PTS}{_CELLS} SELECT frame_id, ring, az, round(range_m, 5) AS range_m, point_id FROM img")
def range_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _image(spark, sf_dir).select("frame_id", "ring", "az", *_r("range_m"), "point_id")


@_query(f"""WITH {_PTS}{_CELLS}, around AS (SELECT *, false AS c FROM img UNION ALL SELECT frame_id, ring, -1, range_m, point_id, true FROM img WHERE az = 899
  UNION ALL SELECT frame_id, ring, 900, range_m, point_id, true FROM img WHERE az = 0),
far AS (SELECT *, max(range_m) OVER (PARTITION BY frame_id, ring ORDER BY az RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS far FROM around)
SELECT frame_id, ring, az, point_id FROM far WHERE NOT c AND far - range_m > 0.3""")
def range_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.edge_cells(_image(spark, sf_dir)).select("frame_id", "ring", "az", "point_id")


@_query(f"""WITH {_PTS}{_CELLS} SELECT ring, az, count(*) AS frames, round(stddev_pop(range_m), 5) AS std_m,
  CASE WHEN count(*) < 3 THEN 'unknown' WHEN stddev_pop(range_m) > 0.3 THEN 'dynamic' ELSE 'static' END AS label FROM img GROUP BY 1, 2""")
def motion_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.motion_cells(_image(spark, sf_dir)).select("ring", "az", "frames", *_r("std_m"), "label")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each day of orders: frame_index, mean_px, floor_px."""
    days = _table(spark, sf_dir, "orders").groupBy(F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long").alias("frame_index"))
    return days.agg((F.avg("o_totalprice") / 1e5).alias("mean_px"), (F.min("o_totalprice") / 1e5 + 0.1).alias("floor_px"))


_FRAMES = "frames AS (SELECT date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS frame_index, avg(o_totalprice) / 1e5 AS mean_px, min(o_totalprice) / 1e5 + 0.1 AS floor_px FROM orders GROUP BY 1)"
_BLOCKS = f"""{_FRAMES}, b AS (SELECT *, ntile(5) OVER (ORDER BY frame_index) AS block FROM frames),
blocks AS (SELECT block, count(*) AS frames, CASE WHEN count(*) < 30 THEN 'EXCLUDED' ELSE 'VALID' END AS status,
  CASE WHEN count(*) >= 30 THEN avg(mean_px) END AS mean_px, CASE WHEN count(*) >= 30 THEN quantile_cont(floor_px, 0.5) END AS floor_px FROM b GROUP BY 1)"""


@_query(f"WITH {_BLOCKS} SELECT block::INT AS block, frames, status, round(mean_px, 4) AS mean_px, round(floor_px, 4) AS floor_px FROM blocks")
def m3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.block_summary(stability.time_blocks(frames(spark, sf_dir), 5)).select("block", "frames", "status", *_r("mean_px", "floor_px", digits=4))


_ROBUST = f"""{_FRAMES}, q AS (SELECT count(*) AS n, quantile_cont(mean_px, 0.25) AS q1, quantile_cont(mean_px, 0.5) AS median, quantile_cont(mean_px, 0.75) AS q3 FROM frames),
s AS (SELECT any_value(n) AS n, any_value(median) AS median, quantile_cont(abs(mean_px - median), 0.5) * 1.4826 AS mad, any_value(q1) AS q1, any_value(q3) AS q3, any_value(q3 - q1) AS iqr FROM frames, q)"""


@_query(f"WITH {_ROBUST} SELECT n, round(median, 5) AS median, round(mad, 5) AS mad, round(q1, 5) AS q1, round(q3, 5) AS q3, round(iqr, 5) AS iqr FROM s")
def m4_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.robust_stats(frames(spark, sf_dir)).select("n", *_r("median", "mad", "q1", "q3", "iqr"))


def _outlier_query(rule: str, test: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stability.outliers(frames(spark, sf_dir), rule).select("frame_index", *_r("z"), "is_outlier")

    name = f"m4_outliers_{rule}"
    QUERIES[name] = run
    ORACLES[name] = f"WITH {_ROBUST} SELECT frame_index, CASE WHEN mad > 1e-9 THEN round((mean_px - median) / mad, 5) END AS z, {test} AS is_outlier FROM frames, s"


_outlier_query("hampel", "abs(mean_px - median) > CASE WHEN mad > 1e-6 THEN 3 * mad ELSE greatest(0.05, 0.05 * abs(median)) END")
_outlier_query("multiplier", "mean_px > CASE WHEN median > 1e-6 THEN 5 * median ELSE 0.5 END")
_outlier_query("iqr", "CASE WHEN iqr > 1e-6 THEN mean_px < q1 - 1.5 * iqr OR mean_px > q3 + 1.5 * iqr ELSE abs(mean_px - median) > 0.5 END")


@_query(f"""WITH {_FRAMES}, ok AS (SELECT * FROM frames WHERE frame_index % 5 <> 0), f AS (SELECT count(*) AS n, regr_slope(mean_px, frame_index) AS slope, corr(mean_px, frame_index) AS r, max(frame_index) - min(frame_index) AS span, quantile_cont(floor_px, 0.5) AS fl FROM ok)
SELECT n, round(slope, 8) AS slope, round(r, 5) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t_stat, round(abs(slope) * span, 5) AS drift_px, round(fl, 5) AS floor_px,
  abs(r * sqrt((n - 2) / (1 - r * r))) > 1.9625 AS significant,
  CASE WHEN abs(r * sqrt((n - 2) / (1 - r * r))) <= 1.9625 THEN 'GOOD' WHEN abs(slope) * span < fl THEN 'GOOD' WHEN abs(slope) * span < 3 * fl THEN 'WARNING' ELSE 'BAD' END AS classification FROM f""")
def temporal_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth frame failed. The SQL tells significance by the bound of t for about a thousand frames; tests check the p value."""
    failed = F.col("frame_index") % 5 == 0
    out = stability.drift(frames(spark, sf_dir).withColumns({"classification": F.when(failed, "FAIL").otherwise("GOOD"), "mean_px": F.when(failed & (F.col("frame_index") % 2 == 0), F.lit(1e6)).when(~failed, F.col("mean_px"))}))
    return out.select("n", *_r("slope", digits=8), *_r("r"), *_r("t_stat", digits=4), *_r("drift_px", "floor_px"), "significant", "classification")


def _stream(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


_NEAREST = """s AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS t, event_type FROM events),
near AS (SELECT a.id AS left_id, b.id AS right_id, b.t AS rt, b.t - a.t AS diff_s FROM s a JOIN s b ON a.event_type = 'view' AND b.event_type = 'click' AND b.t BETWEEN a.t - 600 AND a.t + 600),
pairs AS (SELECT left_id, arg_min(right_id, (abs(diff_s), rt, right_id)) AS right_id, arg_min(diff_s, (abs(diff_s), rt, right_id)) AS diff_s FROM near GROUP BY 1)"""


@_query(f"WITH {_NEAREST} SELECT left_id, right_id, round(diff_s, 4) AS diff_s FROM pairs")
def sync_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.nearest_in_time(_stream(spark, sf_dir, "view"), _stream(spark, sf_dir, "click"), 600.0).select("left_id", "right_id", *_r("diff_s", digits=4))


@_query(f"""WITH {_PTS}{_CELLS}, m AS (SELECT ring, az, CASE WHEN count(*) < 3 THEN 'unknown' WHEN stddev_pop(range_m) > 0.3 THEN 'dynamic' ELSE 'static' END AS label FROM img GROUP BY 1, 2)
SELECT frame_id, label, count(*) AS n FROM cells JOIN m USING (ring, az) GROUP BY 1, 2""")
def dynamic_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = scans.with_cells(points(spark, sf_dir))
    labelled = scans.dynamic_points(cells, scans.motion_cells(scans.range_image(cells)))
    return labelled.groupBy("frame_id", "label").agg(F.count("*").alias("n"))


@_query(f"""WITH {_PTS}, t AS (SELECT *, -(CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END) / (2 * pi()) * 0.1 AS dt FROM pts),
q AS (SELECT *, x - 5 * dt AS qx, y - dt AS qy, cos(0.3 * dt) AS c, sin(0.3 * dt) AS s FROM t),
d AS (SELECT frame_id, sqrt((qx * c + qy * s - x) ** 2 + (qy * c - qx * s - y) ** 2) AS m FROM q)
SELECT frame_id, count(*) AS n, round(avg(m), 5) AS mean_m, round(max(m), 5) AS max_m, round(quantile_cont(m, 0.95), 5) AS p95_m FROM d GROUP BY 1""")
def deskew(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = motion.deskew(points(spark, sf_dir).withColumn("t_offset", motion.time_offset()), (5.0, 1.0, 0.0), (0.0, 0.0, 0.3))
    return motion.deskew_summary(moved).select("frame_id", "n", *_r("mean_m", "max_m", "p95_m"))


_GRID = "grid AS (SELECT * FROM (VALUES " + ", ".join(str(c) for c in sensitivity.candidates(PLAIN)) + ") g(axis, direction, delta, " + ", ".join(f"m{i}" for i in range(12)) + "))"
_SAMPLES = f"""WITH {_PTS}, {_GRID}, c AS (SELECT axis, direction, delta, u AS u0, v AS v0, m0 * x + m1 * y + m2 * z + m3 AS a, m4 * x + m5 * y + m6 * z + m7 AS b, m8 * x + m9 * y + m10 * z + m11 AS d FROM proj, grid),
w AS (SELECT *, 150 * (a / d) + 160 AS u1, 150 * (b / d) + 120 AS v1 FROM c WHERE d > 0.05),
samples AS (SELECT axis, direction, delta::DOUBLE AS delta, count(*) AS n, avg(sqrt((u1 - u0) ** 2 + (v1 - v0) ** 2)) AS mean_px FROM w
  WHERE u1 >= 0 AND u1 < 320 AND v1 >= 0 AND v1 < 240 GROUP BY 1, 2, 3)"""


@_query(f"{_SAMPLES} SELECT axis, direction::INT AS direction, delta, n, round(mean_px, 4) AS mean_px FROM samples")
def perturbation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.shift_samples(spark, points(spark, sf_dir), PLAIN).select("axis", "direction", "delta", "n", *_r("mean_px", digits=4))


@_query(f"""{_SAMPLES}, e AS (SELECT axis, min(delta) AS lo, max(delta) AS hi FROM samples GROUP BY 1),
s AS (SELECT axis, avg(mean_px) FILTER (delta = lo) AS small_px, avg(mean_px) FILTER (delta = hi) AS large_px FROM samples JOIN e USING (axis) GROUP BY 1)
SELECT axis, round(small_px, 4) AS small_px, round(large_px, 4) AS large_px, CASE WHEN small_px > 0.5 THEN 'HIGH' WHEN large_px > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS classification FROM s""")
def axis_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = sensitivity.shift_samples(spark, points(spark, sf_dir), PLAIN)
    return sensitivity.axis_sensitivity(samples, 0.0, 0.5).select("axis", *_r("small_px", "large_px", digits=4), "classification")


@_query(f"""WITH {_PTS}{_EDGES}, pix AS (SELECT o_custkey % 4 AS frame_id, o_orderkey * 7919 % 320 AS pu, o_orderkey * 104729 % 240 AS pv, max(o_totalprice) AS strength, min(o_custkey * 37 % 180) AS deg FROM orders GROUP BY 1, 2, 3),
met AS (SELECT e.frame_id, e.point_id, pu, pv, strength, sqrt((u - pu) ** 2 + (v - pv) ** 2) AS d, abs(floor(u * 10)::BIGINT % 180 - deg) AS a
  FROM edge e JOIN pix p ON p.frame_id = e.frame_id AND pu BETWEEN u - 15 AND u + 15 AND pv BETWEEN v - 15 AND v + 15),
ok AS (SELECT *, CASE WHEN d <= 5 THEN 5 WHEN d <= 10 THEN 10 ELSE 15 END AS tier FROM met WHERE d <= 15 AND least(a, 180 - a) <= 30),
low AS (SELECT *, min(tier) OVER (PARTITION BY frame_id, point_id) AS lo FROM ok),
best AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY frame_id, point_id) AS n FROM low WHERE tier = lo WINDOW w AS (PARTITION BY frame_id, point_id ORDER BY strength DESC, d, pv, pu))
SELECT e.frame_id, e.point_id, b.k IS NOT NULL AS matched, b.pu::DOUBLE AS pixel_u, b.pv::DOUBLE AS pixel_v, round(coalesce(b.d, 15), 5) AS distance_px, coalesce(b.n, 0) AS num_candidates
FROM edge e LEFT JOIN best b ON b.frame_id = e.frame_id AND b.point_id = e.point_id AND b.k = 1""")
def correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = radius.edge_points(_placed(spark, sf_dir))
    orders = _table(spark, sf_dir, "orders")
    pixels = orders.groupBy((F.col("o_custkey") % 4).alias("frame_id"), (F.col("o_orderkey") * 7919 % 320).alias("pixel_u"), (F.col("o_orderkey") * 104729 % 240).alias("pixel_v"))
    pixels = pixels.agg(F.max("o_totalprice").alias("strength"), F.min(F.col("o_custkey") * 37 % 180).alias("pixel_deg"))
    found = matching.correspondences(edges.withColumn("orientation_deg", (F.floor(F.col("u") * 10) % 180).cast("double")), pixels)
    return found.select(*KEYS, "matched", F.col("pixel_u").cast("double").alias("pixel_u"), F.col("pixel_v").cast("double").alias("pixel_v"), *_r("distance_px"), "num_candidates")


_REPORTS = """r AS (SELECT o_orderpriority AS name, o_orderstatus AS st, avg(o_totalprice) / 1e4 AS a FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN a < 14.9 THEN 0 WHEN a < 15.1 THEN 1 ELSE 2 END AS c FROM r)"""
_CLASSES = "['GOOD', 'WARNING', 'BAD']"


@_query(f"""WITH {_REPORTS} SELECT name, round(o.a, 4) AS old_score, round(n.a, 4) AS new_score, round(n.a - o.a, 4) AS delta_score, {_CLASSES}[o.c + 1] AS old_class, {_CLASSES}[n.c + 1] AS new_class,
  (coalesce(n.c, 3) > coalesce(o.c, 3)) OR (coalesce(n.c, 3) = coalesce(o.c, 3) AND coalesce(n.a < o.a, false)) AS regressed
FROM (SELECT * FROM k WHERE st = 'F') o FULL JOIN (SELECT * FROM k WHERE st = 'O') n USING (name)""")
def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"), "o_orderstatus").agg((F.avg("o_totalprice") / 1e4).alias("score"))
    rows = rows.withColumn("classification", F.when(F.col("score") < 14.9, "GOOD").when(F.col("score") < 15.1, "WARNING").otherwise("BAD"))
    diff = stability.report_diff(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"))
    return diff.select("name", *_r("old_score", "new_score", "delta_score", digits=4), "old_class", "new_class", "regressed")
