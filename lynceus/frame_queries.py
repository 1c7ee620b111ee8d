"""Queries of synchronisation, input checks, correspondences, M2 and planes over the driver's tables, with their SQL.

Users are rigs, their views and clicks camera and LiDAR frames; orders are edge pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .driver_queries import _EDGES, _FLOOR, _PTS, FLOOR, KEYS, PLAIN, _placed, _table, points
from .functions import rigid
from .operators import decisions, frame_metrics, images, motion, neighbours, noise_floor, planes, radius, scans, sensitivity, sync, validation, views
from .plans import evaluate
from .registry import query, rounded
from .sources import frames as clouds_of
from .tables import written

RIGS, WINDOW_S = 8, 7200.0


def _stream(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select((F.col("user_id") % RIGS).alias("rig"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


_STREAMS = f"""s AS (SELECT user_id % {RIGS} AS rig, event_id AS id, epoch_us(ts) / 1e6 AS t, event_type AS e FROM events),
c0 AS (SELECT rig, id, t, row_number() OVER (PARTITION BY rig ORDER BY t, id) - 1 AS i FROM s WHERE e = 'view'),
l AS (SELECT rig, id, t, row_number() OVER (PARTITION BY rig ORDER BY t, id) - 1 AS j FROM s WHERE e = 'click'),
near AS (SELECT c0.rig, c0.id, arg_min(l.id, (abs(l.t - c0.t), l.t)) AS lid, c0.t - arg_min(l.t, (abs(l.t - c0.t), l.t)) AS d FROM c0 JOIN l USING (rig) GROUP BY c0.rig, c0.id, c0.t)"""
_SYNC = f"""WITH RECURSIVE {_STREAMS}, off AS (SELECT rig, quantile_cont(d, 0.5) AS off FROM near GROUP BY 1),
c AS (SELECT rig, 0 AS mode, i, t - off AS aim FROM c0 JOIN off USING (rig) UNION ALL SELECT rig, 1, i, t FROM c0),
nn AS (SELECT c.rig, c.mode, c.i, c.aim, max_by(l.j, struct_pack(d := -abs(l.t - c.aim), j := l.j)) AS nn FROM c JOIN l USING (rig) GROUP BY ALL),
n AS (SELECT rig, count(*) AS n FROM l GROUP BY 1),
f(rig, mode, i, jn, jm, ok) AS (
  SELECT DISTINCT rig, mode, -1::BIGINT, 0::BIGINT, NULL::BIGINT, false FROM c
  UNION ALL
  SELECT f.rig, f.mode, f.i + 1, CASE WHEN abs(l.t - nn.aim) <= {WINDOW_S} THEN l.j + 1 ELSE l.j END, l.j, abs(l.t - nn.aim) <= {WINDOW_S}
  FROM f JOIN nn ON nn.rig = f.rig AND nn.mode = f.mode AND nn.i = f.i + 1 JOIN n ON n.rig = f.rig JOIN l ON l.rig = f.rig AND l.j = greatest(f.jn, nn.nn) WHERE f.jn < n.n),
every AS (SELECT f.rig, f.mode, c0.id AS camera_id, l.id AS lidar_id, c0.t, c0.t - l.t AS diff_s FROM f JOIN c0 ON c0.rig = f.rig AND c0.i = f.i JOIN l ON l.rig = f.rig AND l.j = f.jm WHERE ok),
pairs AS (SELECT * FROM every WHERE mode = 0 OR rig NOT IN (SELECT rig FROM every WHERE mode = 0))"""


def _synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.monotonic_sync(_stream(spark, sf_dir, "view"), _stream(spark, sf_dir, "click"), WINDOW_S)


@query(f"{_SYNC} SELECT rig, row_number() OVER (PARTITION BY rig ORDER BY t) - 1 AS frame_index, camera_id, lidar_id, round(diff_s, 4) AS diff_s FROM pairs")
def sync_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir).select("rig", "frame_index", "camera_id", "lidar_id", *rounded("diff_s", digits=4))


@query(f"WITH {_STREAMS} SELECT rig, count(*) AS n, round(quantile_cont(d, 0.5), 4) AS offset_s FROM near GROUP BY 1")
def sync_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = sync.nearest_of_any(_stream(spark, sf_dir, "view"), _stream(spark, sf_dir, "click"))
    return near.groupBy("rig").agg(F.count("*").alias("n"), F.round(F.expr("percentile(diff_s, 0.5)"), 4).alias("offset_s"))


_SYNC_STATS = f"""{_SYNC}, k AS (SELECT rig, count_if(e = 'view')::BIGINT AS camera_frames, count_if(e = 'click')::BIGINT AS lidar_frames FROM s GROUP BY 1 HAVING count_if(e IN ('view', 'click')) > 0),
m AS (SELECT rig, count(*) AS matched, avg(abs(diff_s)) AS mean_abs_s, max(abs(diff_s)) AS max_abs_s, avg(diff_s) AS offset_s, stddev_pop(diff_s) AS std_s FROM pairs GROUP BY 1),
st AS (SELECT k.*, coalesce(matched, 0) AS matched, mean_abs_s, max_abs_s, offset_s, std_s, 1 - coalesce(matched, 0) / greatest(camera_frames, 1) AS dr, coalesce(std_s, 0) / {WINDOW_S} AS sp FROM k LEFT JOIN m USING (rig))"""
_SYNC_CLASS = "CASE WHEN matched = 0 THEN 'FAIL' WHEN dr <= 0.05 AND sp <= 0.2 THEN 'GOOD' WHEN dr <= 0.2 AND sp <= 0.5 THEN 'WARNING' ELSE 'BAD' END"


def _sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_summary(_synced(spark, sf_dir), _stream(spark, sf_dir, "view"), _stream(spark, sf_dir, "click"), WINDOW_S)


@query(f"""{_SYNC_STATS} SELECT rig, camera_frames, lidar_frames, matched, camera_frames - matched AS camera_dropped, lidar_frames - matched AS lidar_dropped, round(mean_abs_s, 4) AS mean_abs_s,
  round(max_abs_s, 4) AS max_abs_s, round(offset_s, 4) AS offset_s, round(std_s, 4) AS std_s, round(dr, 5) AS drop_ratio FROM st""")
def sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("rig", "camera_frames", "lidar_frames", "matched", "camera_dropped", "lidar_dropped")
    return _sync_summary(spark, sf_dir).select(*names, *rounded("mean_abs_s", "max_abs_s", "offset_s", "std_s", digits=4), *rounded("drop_ratio"))


@query(f"""{_SYNC_STATS} SELECT rig, matched, {_SYNC_CLASS} AS classification,
  array_to_string(list_filter([CASE WHEN matched = 0 THEN 'no pairs matched' WHEN dr > 0.5 THEN 'synchronisation is poor' END, CASE WHEN abs(offset_s) > {WINDOW_S / 2} THEN 'offset is large against the window' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM st""")
def sync_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync_summary(spark, sf_dir).select("rig", "matched", "classification", F.array_join("warnings", "; ").alias("warnings"))


# Rigs of the input checks: one for each nation, some of them broken.
_RIGS = """rigs AS (SELECT n_nationkey AS rig, 20.0 * n_nationkey - 40 AS fx, 150.0 AS fy, 30.0 * n_nationkey AS cx, 400.0 - 20 * n_nationkey AS cy, 320 AS width, CASE WHEN n_nationkey = 24 THEN 0 ELSE 240 END AS height,
  ['none', 'plumb_bob', 'fisheye_equidistant'][n_nationkey % 3 + 1] AS lens, n_nationkey % 5 + 1 AS k FROM nation)"""


def _rigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    names = F.transform(F.sequence(F.lit(1), n % 5 + 1), lambda i: F.concat(F.lit("k"), i.cast("string")))
    return _table(spark, sf_dir, "nation").select(
        n.alias("rig"), (20.0 * n - 40).alias("fx"), F.lit(150.0).alias("fy"), (30.0 * n).alias("cx"), (400.0 - 20 * n).alias("cy"), F.lit(320).alias("width"), F.when(n == 24, 0).otherwise(240).alias("height"),
        F.element_at(F.array(*map(F.lit, ("none", "plumb_bob", "fisheye_equidistant"))), n % 3 + 1).alias("lens"), F.map_from_arrays(names, F.transform(names, lambda _: F.lit(0.1))).alias("coefficients"),
    )


def _all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rigs = _rigs(spark, sf_dir)
    camera, lidar = (_stream(spark, sf_dir, k).withColumn("position", F.col("id")) for k in ("view", "click"))
    scans_of = points(spark, sf_dir).withColumn("rig", F.col("frame_id") % RIGS)
    order = scans_of.select("rig", "frame_id").distinct().withColumn("position", F.col("frame_id"))
    parts = [
        validation.rig_checks(rigs), validation.stream_checks(camera, rigs, "camera"), validation.stream_checks(lidar, rigs, "lidar"),
        validation.scan_checks(validation.sampled_frames(order), scans_of, 2.0, 30.0), validation.overlap_checks(camera, lidar, rigs),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_CHECKS = f"""{_PTS}, {_RIGS}, ev AS (SELECT user_id % {RIGS} AS rig, event_id AS id, epoch_us(ts) / 1e6 AS t, event_type AS e FROM events WHERE event_type IN ('view', 'click')),
lagged AS (SELECT *, lag(t) OVER (PARTITION BY rig, e ORDER BY id) AS b FROM ev),
st AS (SELECT rig, e, count(*) AS n, count_if(t <= b) AS back, min(t) AS lo, max(t) AS hi FROM lagged GROUP BY 1, 2),
names AS (SELECT * FROM (VALUES ('camera', 'view'), ('lidar', 'click')) v(sensor, e)),
streams AS (SELECT rigs.rig, sensor, n, back FROM rigs CROSS JOIN names LEFT JOIN st ON st.rig = rigs.rig AND st.e = names.e),
ov AS (SELECT rigs.rig, a.n AS cn, b.n AS ln, greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS len FROM rigs LEFT JOIN st a ON a.rig = rigs.rig AND a.e = 'view' LEFT JOIN st b ON b.rig = rigs.rig AND b.e = 'click'),
fr AS (SELECT frame_id % {RIGS} AS rig, frame_id, count(*) AS n, count_if(sqrt(x * x + y * y + z * z) BETWEEN 2 AND 30) AS near FROM pts GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY rig ORDER BY frame_id) - 1 AS pos, count(*) OVER (PARTITION BY rig) AS c FROM fr),
smp AS (SELECT * FROM rk WHERE list_contains(list_transform(range(least(5, c)), lambda i: CASE WHEN least(5, c) > 1 THEN floor(i * (c - 1) / (least(5, c) - 1))::BIGINT ELSE 0 END), pos)),
sc AS (SELECT rig, count_if(n < 100) AS sparse, count_if(near < 0.5 * n) AS outside FROM smp GROUP BY 1),
checks(rig, name, status, value) AS (
  SELECT rig, 'camera.fx_positive', CASE WHEN fx > 0 THEN 'VALID' ELSE 'INVALID' END, fx::DOUBLE FROM rigs
  UNION ALL SELECT rig, 'camera.fy_positive', 'VALID', fy::DOUBLE FROM rigs
  UNION ALL SELECT rig, 'camera.cx_in_image_bounds', CASE WHEN cx BETWEEN 0 AND width THEN 'VALID' ELSE 'WARNING' END, cx::DOUBLE FROM rigs
  UNION ALL SELECT rig, 'camera.cy_in_image_bounds', CASE WHEN cy BETWEEN 0 AND height THEN 'VALID' ELSE 'WARNING' END, cy::DOUBLE FROM rigs
  UNION ALL SELECT rig, 'camera.image_size_valid', CASE WHEN width > 0 AND height > 0 THEN 'VALID' ELSE 'INVALID' END, NULL FROM rigs
  UNION ALL SELECT rig, 'camera.distortion_params_valid', CASE WHEN lens = 'none' OR (lens = 'plumb_bob' AND k = 5) OR (lens = 'fisheye_equidistant' AND k = 4) THEN 'VALID' ELSE 'WARNING' END, NULL FROM rigs
  UNION ALL SELECT rig, sensor || '.frames_present', 'INVALID', NULL FROM streams WHERE n IS NULL
  UNION ALL SELECT rig, sensor || '.timestamps_finite', 'VALID', 0 FROM streams WHERE n IS NOT NULL
  UNION ALL SELECT rig, sensor || '.timestamps_monotonic', CASE WHEN back = 0 THEN 'VALID' ELSE 'INVALID' END, NULL FROM streams WHERE n IS NOT NULL
  UNION ALL SELECT rig, 'lidar.point_count_nonzero', 'VALID', NULL FROM sc
  UNION ALL SELECT rig, 'lidar.point_count_sufficient', 'WARNING', sparse FROM sc WHERE sparse > 0
  UNION ALL SELECT rig, 'lidar.xyz_finite', 'VALID', NULL FROM sc
  UNION ALL SELECT rig, 'lidar.range_within_sensor_spec', CASE WHEN outside = 0 THEN 'VALID' ELSE 'WARNING' END, CASE WHEN outside > 0 THEN outside END FROM sc
  UNION ALL SELECT rig, 'dataset.frame_counts_nonzero', CASE WHEN cn IS NOT NULL AND ln IS NOT NULL THEN 'VALID' ELSE 'INVALID' END, NULL FROM ov
  UNION ALL SELECT rig, 'dataset.overlap_duration', CASE WHEN len <= 0 THEN 'INVALID' WHEN len < 1 THEN 'WARNING' ELSE 'VALID' END, CASE WHEN len > 0 THEN len END FROM ov WHERE cn IS NOT NULL AND ln IS NOT NULL)"""


@query(f"WITH {_CHECKS} SELECT rig, name, status, round(value, 3) AS value FROM checks")
def validation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_checks(spark, sf_dir).select("rig", "name", "status", *rounded("value", digits=3))


@query(f"""WITH {_CHECKS}, g AS (SELECT rig, max(CASE status WHEN 'VALID' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END) AS lv, count(*) AS checks, count_if(status = 'WARNING')::BIGINT AS warnings, count_if(status = 'INVALID')::BIGINT AS invalid,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (status <> 'VALID'), '') AS reasons FROM checks GROUP BY 1)
SELECT rig, ['INPUT_VALID', 'INPUT_WARNING', 'INPUT_INVALID'][lv + 1] AS status, checks, warnings, invalid, reasons FROM g""")
def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.combined(_all_checks(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {_PTS}, a AS (SELECT frame_id, count(*) AS n, count_if(sqrt(x * x + y * y + z * z) BETWEEN 0 AND 30) AS near FROM pts GROUP BY 1),
w AS (SELECT *, min(depth) OVER (PARTITION BY frame_id, floor(u / 8), floor(v / 8)) AS low FROM proj), o AS (SELECT frame_id, count(*) AS m, count_if(depth > low + 0.5) / count(*) AS ratio FROM w GROUP BY 1),
g AS (SELECT a.*, coalesce(m, 0) AS m, ratio FROM a LEFT JOIN o USING (frame_id))
SELECT frame_id, 'depth_distribution_valid' AS name, near > 0.5 * n AS passed, round(near / n, 5) AS value FROM g
UNION ALL SELECT frame_id, 'fov_coverage_sufficient', m / n >= 0.3, round(m / n, 5) FROM g
UNION ALL SELECT frame_id, 'sufficient_valid_points', m >= 500, m::DOUBLE FROM g
UNION ALL SELECT frame_id, 'occlusion_plausible', coalesce(ratio <= 0.2, false), round(ratio, 5) FROM g""")
def sanity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = validation.sanity_gate(points(spark, sf_dir), scans.occlusion(_placed(spark, sf_dir)), max_range_m=30.0)
    return gate.select("frame_id", "name", "passed", *rounded("value"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radius.edge_points(_placed(spark, sf_dir))


_NEIGHBOURS = f"""{_EDGES}, pair AS (SELECT a.frame_id, a.point_id, b.point_id AS other, b.u AS bu, b.v AS bv, sqrt((a.u - b.u) ** 2 + (a.v - b.v) ** 2) AS d FROM edge a JOIN edge b ON a.frame_id = b.frame_id AND a.point_id <> b.point_id AND abs(a.u - b.u) <= 60 AND abs(a.v - b.v) <= 60),
knn AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY frame_id, point_id ORDER BY d, other) <= 6),
cloud AS (SELECT frame_id, point_id, bu, bv FROM knn UNION ALL SELECT frame_id, point_id, u, v FROM edge),
turned AS (SELECT frame_id, point_id, degrees(atan2(2 * covar_pop(bu, bv), var_pop(bu) - var_pop(bv))) / 2 AS a FROM cloud GROUP BY 1, 2),
oriented AS (SELECT edge.*, CASE WHEN a < 0 THEN a + 180 ELSE a END AS deg FROM edge JOIN turned USING (frame_id, point_id))"""


@query(f"WITH {_PTS}{_NEIGHBOURS} SELECT frame_id, point_id, round(deg, 3) AS orientation_deg FROM oriented")
def knn_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.edge_directions(_edges(spark, sf_dir)).select(*KEYS, *rounded("orientation_deg", digits=3))


#: Orders as edge pixels, dense enough that most points find one.
_PIXELS = """, pix AS (SELECT (o_orderkey * 31 + o_custkey) % 40 AS frame_id, o_orderkey * 7919 % 320 AS pu, o_custkey * 104729 % 240 AS pv, max(o_totalprice) AS strength, min(o_custkey * 37 % 180) AS deg FROM orders GROUP BY 1, 2, 3)"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    frame = ((F.col("o_orderkey") * 31 + F.col("o_custkey")) % 40).alias("frame_id")
    spots = orders.groupBy(frame, (F.col("o_orderkey") * 7919 % 320).alias("pixel_u"), (F.col("o_custkey") * 104729 % 240).alias("pixel_v"))
    return spots.agg(F.max("o_totalprice").alias("strength"), F.min(F.col("o_custkey") * 37 % 180).cast("double").alias("pixel_deg"))


_MATCHES = f"""{_PIXELS}, turned0 AS (SELECT *, floor(u * 10)::BIGINT % 180 AS deg FROM edge),
met AS (SELECT e.frame_id, e.point_id, pu, pv, strength, sqrt((u - pu) ** 2 + (v - pv) ** 2) AS d, abs(e.deg - p.deg) AS a
  FROM turned0 e JOIN pix p ON p.frame_id = e.frame_id AND pu BETWEEN u - 15 AND u + 15 AND pv BETWEEN v - 15 AND v + 15),
ok AS (SELECT *, CASE WHEN d <= 5 THEN 5 WHEN d <= 10 THEN 10 ELSE 15 END AS tier FROM met WHERE d <= 15 AND least(a, 180 - a) <= 30),
low AS (SELECT *, min(tier) OVER (PARTITION BY frame_id, point_id) AS lo FROM ok),
best AS (SELECT *, count(*) OVER (PARTITION BY frame_id, point_id) AS n FROM low WHERE tier = lo QUALIFY row_number() OVER (PARTITION BY frame_id, point_id ORDER BY strength DESC, d, pv, pu) = 1),
way AS (SELECT e.frame_id, e.point_id, e.u, e.v, b.pu - e.u AS du, b.pv - e.v AS dv, count(*) OVER (PARTITION BY e.frame_id) AS m FROM edge e JOIN best b USING (frame_id, point_id)),
wp AS (SELECT a.frame_id, a.point_id, b.du, b.dv, b.point_id AS other, sqrt((a.u - b.u) ** 2 + (a.v - b.v) ** 2) AS d FROM way a JOIN way b ON a.frame_id = b.frame_id AND a.point_id <> b.point_id WHERE a.m >= 3),
wk AS (SELECT * FROM wp QUALIFY row_number() OVER (PARTITION BY frame_id, point_id ORDER BY d, other) <= 5),
usual AS (SELECT frame_id, point_id, count(*) AS n, quantile_cont(du, 0.5) AS mu, quantile_cont(dv, 0.5) AS mv FROM wk WHERE sqrt(du * du + dv * dv) > 1e-9 GROUP BY 1, 2 HAVING count(*) >= 2),
sz AS (SELECT w.frame_id, w.point_id, sqrt(du * du + dv * dv) AS own, sqrt(mu * mu + mv * mv) AS mid, du * mu + dv * mv AS dot FROM way w JOIN usual USING (frame_id, point_id)),
undone AS (SELECT frame_id, point_id FROM sz WHERE own > 1e-9 AND mid > 1e-9 AND (
  (own >= 1.5 AND degrees(acos(least(1, greatest(-1, dot / (own * mid))))) > 45) OR (greatest(own / mid, mid / own) > 3 AND abs(own - mid) > 3))),
final AS (SELECT e.frame_id, e.point_id, e.u, e.v, e.depth, b.d IS NOT NULL AND x.point_id IS NULL AS matched, CASE WHEN x.point_id IS NULL THEN coalesce(b.d, 15) ELSE 15 END AS distance_px,
    CASE WHEN x.point_id IS NULL THEN coalesce(b.n, 0) ELSE 0 END AS num_candidates, CASE WHEN x.point_id IS NOT NULL THEN 'consistency' WHEN b.d IS NULL THEN 'no_candidate' END AS reason
  FROM edge e LEFT JOIN best b ON b.frame_id = e.frame_id AND b.point_id = e.point_id LEFT JOIN undone x ON x.frame_id = e.frame_id AND x.point_id = e.point_id)"""


def _degrees() -> F.Column:
    return (F.floor(F.col("u") * 10) % 180).cast("double")


@query(f"WITH {_PTS}{_EDGES}{_MATCHES} SELECT frame_id, point_id, matched, round(distance_px, 5) AS distance_px, num_candidates, reason FROM final")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.match_edges(_edges(spark, sf_dir), _pixels(spark, sf_dir), directions=_degrees())
    return found.select(*KEYS, "matched", *rounded("distance_px"), "num_candidates", "reason")


_M2 = f"""{_MATCHES}, er AS (SELECT *, distance_px / {_FLOOR.format('depth')} AS ne FROM final),
fs AS (SELECT DISTINCT frame_id FROM pts), np AS (SELECT frame_id, count(*) AS n FROM proj GROUP BY 1), nx AS (SELECT frame_id, count(*) AS n FROM pix GROUP BY 1),
ag AS (SELECT frame_id, count(*) AS n, avg(distance_px) AS mean_px, quantile_cont(distance_px, 0.5) AS median_px, quantile_cont(distance_px, 0.95) AS p95_px, max(distance_px) AS max_px, quantile_cont(depth, 0.5) AS depth_m,
  count_if(matched) AS matched, avg(ne) AS mean_n, (max(u) - min(u)) * (max(v) - min(v)) / (320 * 240) AS fov FROM er GROUP BY 1),
fr AS (SELECT frame_id, coalesce(np.n, 0) AS num_projected, coalesce(ag.n, 0) AS num_edge_points, CASE WHEN coalesce(np.n, 0) = 0 THEN 'nothing projected' WHEN coalesce(ag.n, 0) < 100 THEN 'too few edge points' WHEN nx.n IS NULL THEN 'no image edges' END AS fail_reason,
  mean_px, median_px, p95_px, max_px, depth_m, matched, mean_n, fov FROM fs LEFT JOIN np USING (frame_id) LEFT JOIN ag USING (frame_id) LEFT JOIN nx USING (frame_id)),
m2 AS (SELECT frame_id, num_projected, num_edge_points, fail_reason, CASE WHEN fail_reason IS NULL THEN mean_px END AS mean_px, CASE WHEN fail_reason IS NULL THEN median_px END AS median_px, CASE WHEN fail_reason IS NULL THEN p95_px END AS p95_px,
  CASE WHEN fail_reason IS NULL THEN max_px END AS max_px, CASE WHEN fail_reason IS NULL THEN depth_m END AS depth_m, CASE WHEN fail_reason IS NULL THEN matched ELSE 0 END AS matched, CASE WHEN fail_reason IS NULL THEN mean_n END AS mean_n,
  CASE WHEN fail_reason IS NULL THEN {_FLOOR.format('depth_m')} END AS floor_px FROM fr),
m2c AS (SELECT *, CASE WHEN mean_px IS NULL THEN 'FAIL' WHEN mean_px < 2 * floor_px THEN 'GOOD' WHEN mean_px < 5 * floor_px THEN 'WARNING' ELSE 'BAD' END AS classification FROM m2)"""


def _aligned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pts = points(spark, sf_dir)
    return evaluate.edge_alignment(pts, pts.select("frame_id").distinct(), _pixels(spark, sf_dir), PLAIN, FLOOR, directions=_degrees())


@query(f"""WITH {_PTS}{_EDGES}{_M2} SELECT frame_id, num_projected, num_edge_points, fail_reason, round(mean_px, 5) AS mean_px, round(median_px, 5) AS median_px, round(p95_px, 5) AS p95_px, round(max_px, 5) AS max_px,
  round(depth_m, 5) AS representative_depth_m, matched::BIGINT AS num_matched, round(mean_n, 5) AS mean_normalized, round(floor_px, 5) AS floor_px, classification FROM m2c""")
def m2_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics, _ = _aligned(spark, sf_dir)
    return metrics.select(
        "frame_id", "num_projected", "num_edge_points", "fail_reason", *rounded("mean_px", "median_px", "p95_px", "max_px", "representative_depth_m"), "num_matched", *rounded("mean_normalized", "floor_px"), "classification"
    )


@query(f"""WITH {_PTS}{_EDGES}{_MATCHES}, e2 AS (SELECT *, {_FLOOR.format('depth')} AS fl FROM final)
SELECT frame_id, point_id, round(distance_px, 5) AS error_px, round(distance_px / fl, 4) AS normalized_error, CASE WHEN distance_px < 2 * fl THEN 'GOOD' WHEN distance_px < 5 * fl THEN 'WARNING' ELSE 'BAD' END AS classification FROM e2""")
def m2_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, errors = _aligned(spark, sf_dir)
    return errors.select(*KEYS, *rounded("error_px"), *rounded("normalized_error", digits=4), "classification")


_CELL = """, cells AS (SELECT frame_id, point_id, least(greatest(floor((atan2(z, sqrt(x ** 2 + y ** 2)) + radians(60) / 2) / radians(60) * 32), 0), 31)::INT AS ring,
  least(greatest(floor((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END) / (2 * pi()) * 900), 0), 899)::INT AS az, sqrt(x ** 2 + y ** 2 + z ** 2) AS range_m FROM pts),
img AS (SELECT frame_id, ring, az, min(range_m) AS r FROM cells GROUP BY 1, 2, 3), mo AS (SELECT ring, az, stddev_pop(r) > 0.3 AS dyn FROM img GROUP BY 1, 2 HAVING count(*) >= 3)"""
_STATIC = """, e1 AS (SELECT frame_id, count(*) AS n FROM edge GROUP BY 1),
still AS (SELECT p.* FROM proj p JOIN cells c USING (frame_id, point_id) LEFT JOIN mo ON mo.ring = c.ring AND mo.az = c.az WHERE NOT coalesce(mo.dyn, false)),
cell2 AS (SELECT *, floor(u / 3) AS gx, floor(v / 3) AS gy FROM still),
near2 AS (SELECT a.point_id, a.frame_id, count(*) AS n, min(b.depth) AS low, max(b.depth) AS high FROM cell2 a, (SELECT unnest([-1, 0, 1]) AS i) i, (SELECT unnest([-1, 0, 1]) AS j) j, cell2 b
  WHERE a.frame_id = b.frame_id AND b.gx = a.gx + i.i AND b.gy = a.gy + j.j AND (a.u - b.u) ** 2 + (a.v - b.v) ** 2 <= 9 GROUP BY ALL),
e2 AS (SELECT frame_id, count(*) AS n FROM still JOIN near2 USING (frame_id, point_id) WHERE near2.n >= 3 AND high - low > 0.3 AND depth <= low + 1e-9 GROUP BY 1),
gone AS (SELECT frame_id, count(*) AS n FROM cells JOIN mo USING (ring, az) WHERE dyn GROUP BY 1)"""


@query(f"""WITH {_PTS}{_EDGES}{_CELL}{_STATIC} SELECT f.frame_id, coalesce(e1.n, 0) AS overall_edge_points, coalesce(e2.n, 0) AS static_edge_points,
  CASE WHEN coalesce(e1.n, 0) > 0 THEN round(1 - coalesce(e2.n, 0) / e1.n, 6) END AS contamination, coalesce(gone.n, 0) AS removed
FROM (SELECT DISTINCT frame_id FROM pts) f LEFT JOIN e1 USING (frame_id) LEFT JOIN e2 USING (frame_id) LEFT JOIN gone USING (frame_id)""")
def dynamic_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = points(spark, sf_dir)
    cells = scans.with_cells(pts)
    marks = scans.dynamic_points(cells, scans.motion_cells(scans.range_image(cells))).select(*KEYS, (F.col("label") == "dynamic").alias("is_dynamic"))
    frames, pixels = pts.select("frame_id").distinct(), _pixels(spark, sf_dir)
    overall, _ = evaluate.edge_alignment(pts, frames, pixels, PLAIN, FLOOR, directions=_degrees())
    static, _ = evaluate.edge_alignment(frame_metrics.without_marked(pts, marks), frames, pixels, PLAIN, FLOOR, directions=_degrees())
    removed = marks.where("is_dynamic").groupBy("frame_id").agg(F.count("*").alias("removed"))
    return frame_metrics.static_against_all(overall, static, removed).select("frame_id", "overall_edge_points", "static_edge_points", *rounded("contamination", digits=6), "removed")


ROUNDS = 300


@query(f"""WITH {_PTS}, pl AS (SELECT frame_id, point_id, x, y, z, row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 AS at, count(*) OVER (PARTITION BY frame_id) AS n FROM pts),
tr AS (SELECT frame_id, any_value(n) AS n, r FROM pl, (SELECT unnest(range({ROUNDS})) AS r) GROUP BY frame_id, r),
tp AS (SELECT frame_id, r, a.x AS x0, a.y AS y0, a.z AS z0, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz FROM tr
  JOIN pl a USING (frame_id) JOIN pl b USING (frame_id) JOIN pl c USING (frame_id) WHERE a.at = r * 7919 % tr.n AND b.at = (r * 7919 + 101) % tr.n AND c.at = (r * 7919 + 997) % tr.n),
cr AS (SELECT *, uy * vz - uz * vy AS cx, uz * vx - ux * vz AS cy, ux * vy - uy * vx AS cz FROM tp),
pn AS (SELECT frame_id, r, cx / s AS nx, cy / s AS ny, cz / s AS nz, -(cx * x0 + cy * y0 + cz * z0) / s AS o FROM (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS s FROM cr) WHERE s >= 1e-9),
ct AS (SELECT frame_id, r, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz, any_value(o) AS o, count(*) AS n, count_if(abs(x * nx + y * ny + z * nz + o) <= 1.0) AS k FROM pl JOIN pn USING (frame_id) GROUP BY 1, 2)
SELECT frame_id, n, k::BIGINT AS inliers, round(k / n, 6) AS inlier_ratio, round(nx, 4) AS nx, round(ny, 4) AS ny, round(nz, 4) AS nz, round(o, 3) AS "offset" FROM ct QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY k DESC, r) = 1""")
def plane_ransac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 triples by a rule, and 1 m, so that SQL can follow; ``dominant_planes`` draws as many at random."""
    pts = points(spark, sf_dir)
    n, r = F.col("n"), F.col("round")
    triples = pts.groupBy("frame_id").agg(F.count("*").alias("n")).withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))))
    triples = triples.select("frame_id", "round", (r * 7919 % n).alias("i0"), ((r * 7919 + 101) % n).alias("i1"), ((r * 7919 + 997) % n).alias("i2"))
    found = planes.dominant_planes(pts, triples, 1.0)
    return found.select("frame_id", "n", "inliers", *rounded("inlier_ratio", digits=6), *rounded("nx", "ny", "nz", digits=4), *rounded("offset", digits=3))


def _step_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 64 x 48 for each nation: black left of a column, white from it on."""
    at = F.col("n_nationkey") + 20
    row = F.concat(F.expr("repeat('00', n_nationkey + 20)"), F.expr("repeat('FF', 64 - 20 - n_nationkey)"))
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("frame_id"), F.lit(48).alias("height"), F.lit(64).alias("width"), F.lit(1).alias("nchannels"), F.unhex(F.repeat(row, 48)).alias("data"), at.alias("at"))


@query("""SELECT n_nationkey::BIGINT AS frame_id, (n_nationkey + 19)::INT AS pixel_u, v::INT AS pixel_v, 90.0::DOUBLE AS pixel_deg, 1020.0::DOUBLE AS strength FROM nation, (SELECT unnest(range(48)) AS v)""")
def image_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.edge_pixels(_step_images(spark, sf_dir))


@query("""WITH s AS (SELECT n_nationkey::BIGINT AS frame_id, unnest(range(0, 60, 7)) AS k FROM nation) SELECT frame_id, k AS point_id, round(abs(k + 0.25 - (frame_id + 19)), 4) AS error_px FROM s""")
def image_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("frame_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(56).cast("long"), F.lit(7).cast("long"))).alias("point_id"))
    spots = spots.select("frame_id", "point_id", (F.col("point_id") + 0.25).alias("u"), F.lit(20.5).alias("v"))
    return images.edge_distances(_step_images(spark, sf_dir), spots).select("frame_id", "point_id", *rounded("error_px", digits=4))


@query("SELECT n_nationkey AS rig, 'camera.image_shape' AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'VALID' ELSE 'INVALID' END AS status, (n_nationkey % 2)::DOUBLE AS value FROM nation")
def image_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = _step_images(spark, sf_dir).select(F.col("frame_id").cast("int").alias("rig"), "width", "height")
    declared = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rig"), F.lit(64).alias("width"), (48 + F.col("n_nationkey") % 2).alias("height"))
    return validation.image_shapes(shots, declared)


# Transforms from suppliers: angles, quaternions and matrices in all units, both ways round.
_RAW = """q AS (SELECT s_suppkey AS rig, s_suppkey % 360 - 180.0 AS a, s_suppkey * 7 % 180 - 90.0 AS b, s_suppkey * 13 % 360 - 180.0 AS c, ['m', 'cm', 'mm'][s_suppkey % 3 + 1] AS unit, s_suppkey % 2 AS back,
    s_acctbal / 1000 AS t0, s_suppkey % 17 AS t1, s_suppkey % 5 - 2.0 AS t2 FROM supplier),
r AS (SELECT *, cos(radians(a)) AS ca, sin(radians(a)) AS sa, cos(radians(b)) AS cb, sin(radians(b)) AS sb, cos(radians(c)) AS cc, sin(radians(c)) AS sc, CASE unit WHEN 'm' THEN 1.0 WHEN 'cm' THEN 0.01 ELSE 0.001 END AS k FROM q),
m AS (SELECT rig, back, cc * cb AS r0, cc * sb * sa - sc * ca AS r1, cc * sb * ca + sc * sa AS r2, sc * cb AS r3, sc * sb * sa + cc * ca AS r4, sc * sb * ca - cc * sa AS r5, -sb AS r6, cb * sa AS r7, cb * ca AS r8, t0 * k AS x, t1 * k AS y, t2 * k AS z FROM r),
e AS (SELECT rig, CASE WHEN back = 0 THEN [r0, r1, r2, x, r3, r4, r5, y, r6, r7, r8, z]
  ELSE [r0, r3, r6, -(r0 * x + r3 * y + r6 * z), r1, r4, r7, -(r1 * x + r4 * y + r7 * z), r2, r5, r8, -(r2 * x + r5 * y + r8 * z)] END AS m FROM m)"""


def _raw_extrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rotation by angles in degrees or radians, as quaternion, or as matrix, in turn."""
    k = F.col("s_suppkey")
    a, b, c = ((k * f % m - h).cast("double") for f, m, h in ((1, 360, 180), (7, 180, 90), (13, 360, 180)))
    half = [F.radians(x) / 2 for x in (a, b, c)]
    (ca, sa), (cb, sb), (cc, sc) = ((F.cos(h), F.sin(h)) for h in half)
    quaternion = F.array(sa * cb * cc - ca * sb * sc, ca * sb * cc + sa * cb * sc, ca * cb * sc - sa * sb * cc, ca * cb * cc + sa * sb * sc)
    matrix = rigid.from_angles(a, b, c)
    forms = [("rpy_deg", F.array(a, b, c)), ("rpy_rad", F.array(*[2 * h for h in half])), ("quaternion", quaternion), ("matrix3x3", F.array(*matrix))]
    form = F.element_at(F.array(*[F.lit(n) for n, _ in forms]), (k % 4 + 1).cast("int"))
    chosen = F.when(k % 4 == 0, forms[0][1]).when(k % 4 == 1, forms[1][1]).when(k % 4 == 2, forms[2][1]).otherwise(forms[3][1])
    return _table(spark, sf_dir, "supplier").select(
        k.alias("rig"), F.when(k % 2 == 0, "lidar").otherwise("camera").alias("parent"), F.when(k % 2 == 0, "camera").otherwise("lidar").alias("child"),
        F.element_at(F.array(*map(F.lit, ("m", "cm", "mm"))), (k % 3 + 1).cast("int")).alias("unit"), form.alias("rotation_format"), chosen.alias("rotation"),
        F.array(F.col("s_acctbal") / 1000, (k % 17).cast("double"), (k % 5 - 2).cast("double")).alias("translation"),
    )


@query(f"WITH {_RAW} SELECT rig, " + ", ".join(f"round(m[{i + 1}], 5) + 0.0 AS m{i}" for i in range(12)) + " FROM e")
def extrinsic_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rigid.normalised_extrinsics(_raw_extrinsics(spark, sf_dir))
    return out.select("rig", *[(F.round(f"m{i}", 5) + 0.0).alias(f"m{i}") for i in range(12)])


@query(f"""WITH {_RAW}, l AS (SELECT rig, sqrt(m[4] ** 2 + m[8] ** 2 + m[12] ** 2) AS n FROM e)
SELECT rig, 'rotation_valid' AS name, true AS passed, 0.0::DOUBLE AS value FROM l UNION ALL SELECT rig, 'translation_finite', true, NULL FROM l
UNION ALL SELECT rig, 'translation_magnitude_plausible', n <= 5, round(n, 5) FROM l UNION ALL SELECT rig, 'homogeneous_bottom_row_valid', true, NULL FROM l""")
def extrinsic_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rigid.extrinsic_checks(rigid.normalised_extrinsics(_raw_extrinsics(spark, sf_dir)), max_shift_m=5.0).select("rig", "name", "passed", *rounded("value"))


_SPECS = """specs AS (SELECT s_suppkey AS rig, 100.0 + s_suppkey AS fx, CASE WHEN s_suppkey % 3 = 0 THEN 0.1 + s_suppkey % 5 * 0.1 END AS h, CASE WHEN s_suppkey % 4 = 0 THEN 0.25 END AS v, CASE WHEN s_suppkey % 5 < 3 THEN 32 END AS ch,
  CASE WHEN s_suppkey % 7 < 5 THEN 30.0 END AS fov, CASE WHEN s_suppkey % 2 = 0 THEN 0.03 END AS ra, CASE WHEN s_suppkey % 6 = 0 THEN 0.4 END AS ed, s_acctbal / 1000 AS tx FROM supplier)"""


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(
        k.alias("rig"), (100.0 + k).alias("fx"), F.when(k % 3 == 0, 0.1 + k % 5 * 0.1).alias("h_res_deg"), F.when(k % 4 == 0, 0.25).alias("v_res_deg"), F.when(k % 5 < 3, 32).alias("channels"),
        F.when(k % 7 < 5, 30.0).alias("vfov_deg"), F.when(k % 2 == 0, 0.03).alias("range_acc_m"), F.when(k % 6 == 0, 0.4).alias("edge_floor_px"), (F.col("s_acctbal") / 1000).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"),
    )


@query(f"""WITH {_SPECS}, g AS (SELECT *, CASE WHEN v IS NULL AND ch > 0 THEN fov / ch END AS st FROM specs), a AS (SELECT *, greatest(h, coalesce(v, st)) AS an FROM g)
SELECT rig, round(coalesce(an, 0.2), 6) AS angle_deg, coalesce(ra, 0.02)::DOUBLE AS range_m, coalesce(ed, 0.5)::DOUBLE AS edge_px, round(abs(tx), 5) AS baseline_m, an IS NULL OR st IS NOT NULL AS angle_guessed, ra IS NULL AS range_guessed, ed IS NULL AS edge_guessed,
  (CASE WHEN an IS NULL OR st IS NOT NULL THEN 1 ELSE 0 END + (ra IS NULL)::INT + (ed IS NULL)::INT)::INT AS warnings FROM a""")
def floor_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = noise_floor.resolved_inputs(_specs(spark, sf_dir))
    return out.select("rig", *rounded("angle_deg", digits=6), "range_m", "edge_px", *rounded("baseline_m"), "angle_guessed", "range_guessed", "edge_guessed", F.size("warnings").alias("warnings"))


@query(f"""WITH {_PTS} SELECT frame_id, count(*) AS n, count(strength) AS hit, round(sum(strength), 2) AS total FROM proj LEFT JOIN (SELECT o_custkey % 4 AS f, o_orderkey * 7919 % 320 AS pu, o_orderkey * 104729 % 240 AS pv, max(o_totalprice) AS strength FROM orders GROUP BY 1, 2, 3)
  ON f = frame_id AND pu = floor(u) AND pv = floor(v) GROUP BY 1""")
def pixel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    pix = orders.groupBy((F.col("o_custkey") % 4).alias("frame_id"), (F.col("o_orderkey") * 7919 % 320).alias("pixel_u"), (F.col("o_orderkey") * 104729 % 240).alias("pixel_v")).agg(F.max("o_totalprice").alias("strength"))
    met = views.pixel_lookup(_placed(spark, sf_dir), pix, ("strength",))
    return met.groupBy("frame_id").agg(F.count("*").alias("n"), F.count("strength").alias("hit"), F.round(F.sum("strength"), 2).alias("total"))




_RISE = "atan2(z, sqrt(x ** 2 + y ** 2))"
_TURN = "least(greatest(floor((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END) / (2 * pi()) * 900), 0), 899)::INT"
_HOLES = "holed AS (SELECT frame_id, point_id, x, y, CASE WHEN point_id % 97 = 0 THEN 'NaN'::DOUBLE ELSE z END AS z FROM pts)"


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of which some have no height."""
    return points(spark, sf_dir).withColumn("z", F.when(F.col("point_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("z")))


@query(f"""WITH {_PTS}, {_HOLES}, sp AS (SELECT frame_id, min({_RISE}) AS lo, max({_RISE}) AS hi FROM holed WHERE NOT isnan(z) GROUP BY 1)
SELECT frame_id, point_id, CASE WHEN isnan(z) THEN -1 ELSE least(greatest(floor(({_RISE} - lo) / (hi - lo) * 32), 0), 31)::INT END AS ring FROM holed JOIN sp USING (frame_id)""")
def ring_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.with_cells(_holed(spark, sf_dir), fov_deg=None).select(*KEYS, "ring")


_GIVEN = f"""{_HOLES}, gv AS (SELECT *, {_TURN} AS az, sqrt(x ** 2 + y ** 2 + z ** 2) AS range_m, greatest((point_id % 53)::INT - 5, -1) AS ring FROM holed),
gi AS (SELECT frame_id, ring, az, min(range_m) AS range_m, arg_min(point_id, (range_m, point_id)) AS point_id FROM gv WHERE ring >= 0 AND NOT isnan(range_m) GROUP BY 1, 2, 3)"""


def _given_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor's own 48 rings, more than the 32 of the default, and points it gives none."""
    own = _holed(spark, sf_dir).withColumn("channel", (F.col("point_id") % 53 - 5).cast("int"))
    return scans.with_cells(own, ring="channel")


@query(f"WITH {_PTS}, {_GIVEN} SELECT frame_id, ring, az, round(range_m, 5) AS range_m, point_id FROM gi")
def range_image_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.range_image(_given_rings(spark, sf_dir)).select("frame_id", "ring", "az", *rounded("range_m"), "point_id")


@query(f"""WITH {_PTS}, {_GIVEN}, ar AS (SELECT * FROM gi), st AS (SELECT a.frame_id, a.point_id FROM ar a JOIN ar b ON a.frame_id = b.frame_id AND a.ring = b.ring AND (b.az = (a.az + 1) % 900 OR b.az = (a.az + 899) % 900) AND b.range_m - a.range_m > 0.3 GROUP BY 1, 2)
SELECT gv.frame_id, count(*) AS n, count(st.point_id) AS edges, coalesce(sum(st.point_id % 1000003), 0)::BIGINT AS marks FROM gv LEFT JOIN st ON st.frame_id = gv.frame_id AND st.point_id = gv.point_id GROUP BY 1""")
def native_edge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = scans.native_edges(_given_rings(spark, sf_dir))
    mark = F.when(F.col("is_edge"), F.col("point_id") % 1000003).otherwise(0)
    return marked.groupBy("frame_id").agg(F.count("*").alias("n"), F.count_if("is_edge").alias("edges"), F.sum(mark).alias("marks"))


@query(f"""WITH {_PTS}, a AS (SELECT *, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END - 0.5 AS raw FROM pts), d AS (SELECT *, CASE WHEN raw < 0 THEN raw + 2 * pi() ELSE raw END AS t FROM a)
SELECT frame_id, point_id, round(least(greatest(error / 50 - 0.02, 0), 0.1), 6) AS given_s, round(t / (2 * pi()) * 0.1, 6) AS swept_s, round(CASE WHEN t = 0 THEN 0 ELSE (2 * pi() - t) / (2 * pi()) * 0.1 END, 6) AS clockwise_s FROM d""")
def time_offset_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(
        *KEYS, F.round(motion.time_offset(given=F.col("error") / 50 - 0.02), 6).alias("given_s"), F.round(motion.time_offset(start_rad=0.5), 6).alias("swept_s"),
        F.round(motion.time_offset(clockwise=True, start_rad=0.5), 6).alias("clockwise_s"),
    )


_PTS0 = _PTS[: _PTS.index("),\ncam AS") + 1].replace("pts AS", "pts0 AS", 1)
_VARIED_M2 = _M2.replace("pix AS (SELECT", "pix0 AS (SELECT", 1).replace(", turned0 AS", ", pix AS (SELECT vr.variant * 1000000 + pix0.frame_id AS frame_id, pu, pv, strength, deg FROM pix0, vr), turned0 AS", 1)


#: The same neighbours as in _EDGES, met by one equal cell, so that many variants don't meet frame by frame.
_RIM_EDGES = """,
cell AS (SELECT *, floor(u / 3) AS gx, floor(v / 3) AS gy FROM proj),
rim AS MATERIALIZED (SELECT frame_id, u, v, depth, gx + i AS gx, gy + j AS gy FROM cell, (SELECT unnest([-1, 0, 1]) AS i) i, (SELECT unnest([-1, 0, 1]) AS j) j),
near AS (
  SELECT a.point_id, a.frame_id, count(*) AS n, min(b.depth) AS low, max(b.depth) AS high
  FROM cell a JOIN rim b ON b.frame_id = a.frame_id AND b.gx = a.gx AND b.gy = a.gy WHERE (a.u - b.u) ** 2 + (a.v - b.v) ** 2 <= 9
  GROUP BY ALL),
""" + _EDGES[_EDGES.index("edge AS (") :]


def _errors_sql(grid: list[tuple], edges: str = _EDGES) -> str:
    """SQL of the errors under each transform of ``grid``. The frames of a variant are numbered apart."""
    rows = ", ".join(str((i, *c)) for i, c in enumerate([("none", 1, 0.0, *map(float, PLAIN.transform)), *grid]))
    varied = f"""vr AS (SELECT * FROM (VALUES {rows}) g(variant, axis, direction, delta, {", ".join(f"m{i}" for i in range(12))})),
pts AS (SELECT variant * 1000000 + frame_id AS frame_id, point_id, m0 * x + m1 * y + m2 * z + m3 AS xc, m4 * x + m5 * y + m6 * z + m7 AS yc, m8 * x + m9 * y + m10 * z + m11 AS zc FROM pts0, vr),
proj AS (SELECT * FROM (SELECT *, 150 * (xc / zc) + 160 AS u, 150 * (yc / zc) + 120 AS v, zc AS depth FROM pts WHERE zc > 0.05) WHERE u >= 0 AND u < 320 AND v >= 0 AND v < 240)"""
    return f"{_PTS0}, {varied}{edges}{_VARIED_M2}, pe AS (SELECT m2c.frame_id % 1000000 AS frame_id, vr.variant, axis, direction, delta::DOUBLE AS delta, mean_px, floor_px FROM m2c JOIN vr ON vr.variant = m2c.frame_id // 1000000)"


#: Every candidate, and two turns of them for the queries that list the errors themselves.
CANDIDATES = sensitivity.candidates(PLAIN)
VARIANTS = [c for c in CANDIDATES if (c[0], c[2]) == ("yaw_deg", 0.5)]
_ERRORS, _ALL_ERRORS = _errors_sql(VARIANTS), _errors_sql(CANDIDATES, _RIM_EDGES)


def _perturbed(spark: SparkSession, sf_dir: str, grid: list[tuple] = VARIANTS) -> DataFrame:
    """The edge error of each frame, under each transform of ``grid``."""
    pts = points(spark, sf_dir)
    return evaluate.perturbed_alignment(pts, pts.select("frame_id").distinct(), _pixels(spark, sf_dir), PLAIN, FLOOR, grid, directions=_degrees())


@query(f"WITH {_ERRORS} SELECT frame_id, axis, direction::INT AS direction, delta, round(mean_px, 4) AS mean_px, round(floor_px, 4) AS floor_px FROM pe")
def perturbation_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _perturbed(spark, sf_dir).select("frame_id", "axis", "direction", "delta", *rounded("mean_px", "floor_px", digits=4))


@query(f"""WITH {_ERRORS}, base AS (SELECT frame_id, mean_px AS b FROM pe WHERE axis = 'none'), cand AS (SELECT * FROM pe WHERE axis <> 'none'),
least1 AS (SELECT frame_id, arg_min(mean_px, (mean_px, variant)) AS m, arg_min(axis, (mean_px, variant)) AS axis FROM cand WHERE mean_px IS NOT NULL GROUP BY 1), lost AS (SELECT frame_id, count_if(mean_px IS NULL)::BIGINT AS invalid FROM cand GROUP BY 1)
SELECT frame_id AS run, axis, round(m, 4) AS best_px, round(b - m, 4) AS margin_px, invalid, CASE WHEN b - m IS NULL THEN 'FAIL' WHEN b - m <= {decisions.MINIMUM_TOLERANCE_PX} THEN 'AT_LOCAL_MINIMUM' ELSE 'NOT_AT_LOCAL_MINIMUM' END AS classification
FROM base JOIN lost USING (frame_id) LEFT JOIN least1 USING (frame_id)""")
def local_minimum_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _perturbed(spark, sf_dir).withColumns({"run": F.col("frame_id"), "position": F.col("variant")})
    out = decisions.local_minimum(every.where("axis <> 'none'"), every.where("axis = 'none'").select("run", F.col("mean_px").alias("baseline_px")))
    return out.select("run", "axis", *rounded("best_px", "margin_px", digits=4), "invalid", "classification")


@query(f"""WITH {_ALL_ERRORS}, al AS (SELECT axis, direction, delta, avg(mean_px) AS mean_px FROM pe GROUP BY 1, 2, 3), base AS (SELECT mean_px AS b, (SELECT avg(floor_px) FROM pe WHERE axis = 'none') AS f FROM al WHERE axis = 'none'),
cand AS (SELECT * FROM al WHERE axis <> 'none' AND mean_px IS NOT NULL), e AS (SELECT axis, min(delta) AS lo, max(delta) AS hi FROM cand GROUP BY 1),
s AS (SELECT axis, avg(abs(mean_px - b)) FILTER (delta = lo) AS small_px, avg(abs(mean_px - b)) FILTER (delta = hi) AS large_px FROM cand JOIN e USING (axis), base GROUP BY 1)
SELECT axis, round(small_px, 4) AS small_px, round(large_px, 4) AS large_px, CASE WHEN small_px > 0.1 THEN 'HIGH' WHEN large_px > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS classification FROM s""")
def axis_sensitivity_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the mean over the frames under each of the 54 candidates, with a floor of 0.1 px."""
    samples = written(_perturbed(spark, sf_dir, CANDIDATES)).groupBy("axis", "direction", "delta").agg(F.avg("mean_px").alias("mean_px"))
    samples = written(samples)
    base = samples.where("axis = 'none'").first()
    out = sensitivity.axis_sensitivity(samples.where("axis <> 'none'"), base["mean_px"] if base and base["mean_px"] is not None else 0.0, 0.1)
    return out.select("axis", *rounded("small_px", "large_px", digits=4), "classification")


@query(f"WITH {_PTS}, {_HOLES} SELECT frame_id, least(count(*), 50) AS n, count(*) >= 50 AS full_sample FROM holed GROUP BY 1")
def frame_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty points of each frame; which ones is up to the hash and tested apart."""
    some = views.sampled_points(_holed(spark, sf_dir), 50)
    return some.groupBy("frame_id").agg(F.count("*").alias("n")).withColumn("full_sample", F.col("n") >= 50)


@query(f"""WITH {_SPECS} SELECT rig, array_to_string(list_filter([CASE WHEN h IS NULL AND v IS NULL AND NOT coalesce(ch > 0 AND fov > 0, false) THEN 'no angular resolution in the sensor''s specification' END,
  CASE WHEN ra IS NULL THEN 'no range accuracy in the sensor''s specification' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM specs""")
def spec_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds_of.spec_warnings(_specs(spark, sf_dir)).select("rig", F.array_join("warnings", "; ").alias("warnings"))


_CHANNEL = "round(CASE WHEN error <= 5 THEN {a} + ({b} - {a}) * least(greatest((error - 2) / 3, 0), 1) ELSE {b} + ({c} - {b}) * least(greatest((error - 5) / 3, 0), 1) END)::INT"
_RGB = ", ".join(f"{_CHANNEL.format(a=a, b=b, c=c)} AS {n}" for n, a, b, c in zip(("red", "green", "blue"), *views.RAMP))


@query(f"WITH {_PTS}, c AS (SELECT {_RGB} FROM pts) SELECT red, green, blue, count(*) AS n FROM c GROUP BY 1, 2, 3")
def error_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    shade = points(spark, sf_dir).select(views.cell_colour(F.col("error"), 2.0, 5.0, 8.0).alias("c"))
    return shade.groupBy(*[F.col("c")[i].alias(n) for i, n in enumerate(("red", "green", "blue"))]).agg(F.count("*").alias("n"))


@query(f"WITH {_PTS}{_EDGES} SELECT frame_id, point_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM edge")
def edges_from_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge points where they lie around the LiDAR, for a view from above."""
    pts = points(spark, sf_dir)
    return views.back_in_lidar(_edges(spark, sf_dir), pts).select(*KEYS, *rounded("x", "y", "z", digits=4))
