"""Synchronisation, neighbours, images, planes, files and reports against their definitions."""

import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.functions import rigid
from lynceus.operators import decisions, images, neighbours, noise_floor, order_statistics, planes, projection, radius, sensitivity, stability, sync, validation, views
from lynceus.plans import evaluate, report
from lynceus.sources import frames as files


def two_pointers(cam, lid, window, offset):
    pairs, j = [], 0
    for i, t in enumerate(cam):
        if j >= len(lid):
            break
        while j + 1 < len(lid) and abs(lid[j + 1] - (t - offset)) <= abs(lid[j] - (t - offset)):
            j += 1
        if abs(lid[j] - (t - offset)) <= window:
            pairs.append((i, j))
            j += 1
    return pairs


def test_matching_in_order_equals_two_pointers():
    rng = random.Random(3)
    for _ in range(3000):
        cam, lid = (np.array(sorted(float(rng.randint(0, 30)) for _ in range(rng.randint(0, 12)))) for _ in range(2))
        w, o = float(rng.randint(0, 3)), float(rng.randint(-2, 2))
        assert sync.match_in_order(cam, lid, w, o) == two_pointers(cam.tolist(), lid.tolist(), w, o)


STREAMS = [  # camera, LiDAR, window in s, matched, class
    ([0, 1, 2], [0, 1, 2], 0.05, 3, "GOOD"), ([0, 1, 2], [0.02, 1.03, 2.01], 0.05, 3, "GOOD"), ([0, 10, 20, 30], [-0.5, 10.5, 19.5, 30.5], 0.05, 0, "FAIL"), ([0, 0.01], [0.005], 0.05, 1, "BAD"),
    (list(range(20)), [i - 0.017 for i in range(20)], 0.01, 20, "GOOD"), (list(range(20)), [i for i in range(20) if i not in (3, 7, 11, 15)], 0.05, 16, "WARNING"), (list(range(10)), [0, 1], 0.05, 2, "BAD"), ([0.0], [], 0.05, 0, "FAIL"),
]


def test_streams(spark):
    rows = lambda k: [(r, i, float(t)) for r, s in enumerate(STREAMS) for i, t in enumerate(s[k])]
    cam, lid = (spark.createDataFrame(rows(k), "rig int, id long, t double") for k in (0, 1))
    for window in {s[2] for s in STREAMS}:
        pairs = sync.monotonic_sync(cam, lid, window)
        got = {r["rig"]: r for r in sync.sync_summary(pairs, cam, lid, window).collect()}
        for r, s in enumerate(STREAMS):
            if s[2] == window:
                assert (got[r]["matched"], got[r]["classification"]) == (s[3], s[4]), s
    assert round(got[4]["offset_s"], 3) == 0.017


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 40, 700):
        u, v = rng.uniform(0, 300, n), rng.uniform(0, 200, n)
        d = np.hypot(u[:, None] - u, v[:, None] - v)
        np.fill_diagonal(d, np.inf)
        want = np.argsort(d, axis=1, kind="stable")[:, : min(6, max(n - 1, 0))]
        assert (neighbours.nearest(u, v, 6)[:, : want.shape[1]] == want).all() if n else True
    flat = neighbours.nearest(np.zeros(5), np.zeros(5), 2)
    assert flat.tolist()[0] == [1, 2] and flat.tolist()[4] == [0, 1]


def step_scene():
    """White right of column 320; a wall at 5 m left of it and one at 10 m right of it."""
    us, vs = np.linspace(0, 639, 220), np.linspace(0, 479, 140)
    rows = []
    for i, v in enumerate(vs):
        for j, u in enumerate(us):
            z = 5.0 if u < 320 else 10.0
            rows.append((0, i * 220 + j, float((u - 320) * z / 500), float((v - 240) * z / 500), z))
    image = np.zeros((480, 640), np.uint8)
    image[:, 320:] = 255
    return rows, image


@pytest.fixture(scope="module")
def scene(spark):
    rows, image = step_scene()
    points = spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double").repartition(4).cache()
    shots = spark.createDataFrame([(0, 480, 640, 1, bytearray(image.tobytes()))], "frame_id long, height int, width int, nchannels int, data binary")
    return points, images.edge_pixels(shots).cache(), shots


RIG = projection.Rig(640, 480, 500.0, 500.0, 320.0, 240.0)
FLOOR = noise_floor.Floor(500.0, 0.05, 0.0, 0.02)


def test_depth_step_is_good_and_a_local_minimum(spark, scene):
    points, pixels, _ = scene
    assert radius.edge_points(projection.project(points, RIG)).count() == 140
    frames = spark.createDataFrame([(0,), (7,)], "frame_id long")
    metrics, errors = evaluate.edge_alignment(points, frames, pixels, RIG, FLOOR)
    good, none = sorted(metrics.collect(), key=lambda r: r["frame_id"])
    assert good["classification"] == "GOOD" and good["num_edge_points"] == 140 and good["match_rate"] > 0.95 and errors.count() == 140
    assert none["classification"] == "FAIL" and none["fail_reason"] == "nothing projected"
    grid = sensitivity.candidates(RIG, (0.05,), (0.5,), (2.0, 0.0, 0.0), None, (0.1,))
    found = evaluate.perturbed_alignment(points, frames.where("frame_id = 0"), pixels, RIG, FLOOR, grid, min_edge_points=20)
    by = {(r["axis"], r["direction"]): r["mean_px"] for r in found.collect()}
    assert len(by) == len(grid) + 1 and math.isclose(by[("none", 1)], good["mean_px"])
    worse = lambda axis: max(by[(axis, s)] or 0.0 for s in (1, -1)) > by[("none", 1)] + 1  # noqa: E731  a gap hides the step from one side
    assert worse("pitch_deg") and worse("tx")  # both move the image sideways
    samples = found.where("axis <> 'none'").select(F.lit(1).alias("run"), "axis", "direction", "delta", "mean_px", F.col("variant").alias("position"))
    one = decisions.local_minimum(samples, spark.createDataFrame([(1, good["mean_px"])], "run int, baseline_px double")).first()
    assert one["classification"] == "AT_LOCAL_MINIMUM"


def test_direction_decides_not_distance(spark):
    """A line of another direction runs nearer than the one that fits."""
    pixels = [(0, x, 105, 0.0, 100.0) for x in range(40, 160)] + [(0, 112, y, 90.0, 100.0) for y in range(40, 160)]
    px = spark.createDataFrame(pixels, "frame_id long, pixel_u int, pixel_v int, pixel_deg double, strength double")
    pts = spark.createDataFrame([(0, i, 100.0, 90.0 + 2 * i) for i in range(11)], "frame_id long, point_id long, u double, v double")
    rows = neighbours.match_edges(pts, px).collect()
    assert all(r["matched"] and r["pixel_u"] == 112 and r["distance_px"] >= 10 for r in rows)


def test_one_that_disagrees_is_undone(spark):
    rows = [(0, i, 10.0 + i, 50.0, True, (14.0 if i != 5 else 6.0) + i, 50.0, 4.0, 1) for i in range(11)]
    df = spark.createDataFrame(rows, "frame_id long, point_id long, u double, v double, matched boolean, pixel_u double, pixel_v double, distance_px double, num_candidates long")
    got = {r["point_id"]: r["reason"] for r in neighbours.agreeing(df).collect()}
    assert got[5] == "consistency" and sum(v is not None for v in got.values()) == 1
    assert not any(r["reason"] for r in neighbours.agreeing(df.where("point_id > 8")).collect())


def test_edges_and_distances_of_shapes():
    image = np.zeros((60, 80), np.uint8)
    image[20:40, 30:60] = 255
    mask = images.edge_mask(image)
    v, u = np.nonzero(mask)
    assert 60 < len(u) < 120 and u.min() >= 28 and u.max() <= 61 and v.min() >= 18 and v.max() <= 41
    far = images.distance_to(mask)
    exact = np.sqrt(((np.arange(80)[None, :, None] - u) ** 2 + (np.arange(60)[:, None, None] - v) ** 2).min(2))
    assert np.abs(far - exact).max() < 0.05 * exact.max() + 0.1 and (far[mask] == 0).all()
    assert np.isinf(images.distance_to(np.zeros((3, 3), bool))).all() and not images.edge_mask(np.full((5, 5), 9, np.uint8)).any()
    assert images.grey(bytes([255, 0, 0, 0, 0, 255]), 1, 2, 3).tolist() == [[29, 76]]


def test_planes(spark):
    rng = np.random.default_rng(0)
    rows = [(0, i, float(x), float(y), float(5 + e)) for i, (x, y, e) in enumerate(zip(rng.uniform(-1.5, 1.5, 2000), rng.uniform(-1, 1, 2000), rng.normal(0, 0.005, 2000)))]
    rows += [(1, 0, 0.0, 0.0, 1.0), (1, 1, 1.0, 0.0, 1.0)] + [(2, i, float(i), 0.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double").repartition(3)
    found = {r["frame_id"]: r for r in planes.dominant_planes(df).collect()}
    assert set(found) == {0} and found[0]["inlier_ratio"] > 0.9 and abs(found[0]["nz"]) > 0.99
    image = np.zeros((480, 640), np.uint8)
    image[150:331, 200:441] = 255
    patch = [(0, i, float((u - 320) / 100), float((v - 240) / 100), 5.0) for i, (u, v) in enumerate((u, v) for u in np.linspace(200, 440, 60) for v in np.linspace(150, 330, 45))]
    shots = spark.createDataFrame([(0, 480, 640, 1, bytearray(image.tobytes()))], "frame_id long, height int, width int, nchannels int, data binary")
    got = planes.plane_metric(spark.createDataFrame(patch, "frame_id long, point_id long, x double, y double, z double"), shots, RIG, FLOOR).first()
    assert got["plane_found"] and got["outline_points"] >= 200 and got["mean_px"] < 2.5 and got["classification"] in ("GOOD", "WARNING")


def png(image):
    h, w, _ = image.shape
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    body = zlib.compress(b"".join(b"\0" + image[y].tobytes() for y in range(h)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def test_folders(spark, tmp_path):
    xyz = np.array([[1, 2, 3, 0.5], [4, 5, 6, 0.25]], np.float32)
    head = "# c\nVERSION .7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA "
    clouds, shots, odd = tmp_path / "c", tmp_path / "i", tmp_path / "o"
    for d in (clouds, shots, odd):
        d.mkdir()
    (clouds / "10.0.pcd").write_bytes((head + "binary\n").encode() + xyz.tobytes())
    (clouds / "2.5.pcd").write_text(head + "ascii\n1 2 3 .5\n4 5 6 .25\n")
    (clouds / "3.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n7 8 9\n")
    listed = files.cloud_folder(spark, str(clouds)).orderBy("frame_index").collect()
    assert [(r["frame_index"], r["t"], r["renumbered"]) for r in listed] == [(0, 2.5, False), (1, 3.0, False), (2, 10.0, False)]
    got = sorted((r["path"][-8:], r["point_id"], r["x"], r["z"], r["intensity"]) for r in files.cloud_points(spark, str(clouds)).collect())
    assert len(got) == 5 and [g[4] for g in got].count(None) == 1 and {g[2] for g in got} == {1.0, 4.0, 7.0}
    for k in range(3):
        (shots / f"a{k}.png").write_bytes(png(np.full((4, 6, 3), [10, 20, 30 + k], np.uint8)))
    assert [(r["t"], r["renumbered"]) for r in files.image_folder(spark, str(shots)).orderBy("frame_index").collect()] == [(0.0, True), (1.0, True), (2.0, True)]
    first = files.decoded(spark, str(shots)).orderBy("path").first()
    assert (first["height"], first["width"], bytes(first["data"])[:3]) == (4, 6, bytes([30, 20, 10]))  # blue first
    with pytest.raises(FileNotFoundError):
        files.cloud_folder(spark, str(odd))
    with pytest.raises(NotImplementedError):
        files.image_folder(spark, str(shots), "embedded")
    for bad, error in ((b"FIELDS x y\n", ValueError), ((head + "binary_compressed\n").encode(), NotImplementedError), (head.replace("z", "q").encode() + b"ascii\n", ValueError)):
        with pytest.raises(error):
            files.parse_pcd(bad)
    with pytest.raises(NotImplementedError):
        files.parse_ply(b"ply\nformat binary_little_endian 1.0\nend_header\n")


def test_rotations(spark):
    one = spark.range(1)
    e = lambda v: [F.lit(float(x)) for x in v]
    value = lambda m: np.array(one.select(F.array(*m).alias("m")).first()["m"])
    assert np.allclose(value(rigid.from_angles(*e((0, 0, 90)))), [0, -1, 0, 1, 0, 0, 0, 0, 1])
    assert np.allclose(value(rigid.from_quaternion(*e((0, 0, 2, 2)))), [0, -1, 0, 1, 0, 0, 0, 0, 1])
    r, t = rigid.from_angles(*e((10, 20, 30))), e((1, 2, 3))
    back = rigid.composed(*rigid.inverted(r, t), r, t)
    assert np.allclose(value(back[0]), np.eye(3).ravel()) and np.allclose(value(back[1]), 0)
    assert one.select(rigid.is_rotation(r).alias("a"), rigid.is_rotation(e((2, 0, 0, 0, 1, 0, 0, 0, 1))).alias("b")).first()[:] == (True, False)
    with pytest.raises(Exception, match="no rotation"):
        value(rigid.from_quaternion(*e((0, 0, 0, 0))))
    raw = spark.createDataFrame([(1, "lidar", "camera", "mm", "matrix4x4", [float(x) for x in (1, 0, 0, 100, 0, 1, 0, 200, 0, 0, 1, 300, 0, 0, 0, 1)], None)], "rig int, parent string, child string, unit string, rotation_format string, rotation array<double>, translation array<double>")
    got = rigid.normalised_extrinsics(raw).first()
    assert [round(got[f"m{i}"], 6) for i in (3, 7, 11)] == [0.1, 0.2, 0.3]
    for column, wrong in (("unit", "ft"), ("rotation_format", "axis"), ("child", "imu")):
        with pytest.raises(Exception, match="unknown|not a LiDAR"):
            rigid.normalised_extrinsics(raw.withColumn(column, F.lit(wrong))).collect()


def test_student_p(spark):
    """Bounds of the table at 5 %."""
    rows = [(12.706, 1), (4.303, 2), (3.182, 3), (2.776, 4), (2.228, 10), (2.011, 48), (1.984, 100), (1.96, 200_000)]
    df = spark.createDataFrame(rows, "t double, n long")
    assert all(abs(r[0] - 0.05) < 2e-4 for r in df.select(stability.two_sided_p(F.col("t"), F.col("n"))).collect())


def test_drift_and_m4(spark):
    frames = lambda f: spark.createDataFrame([(i, float(f(i)), 0.5, "GOOD") for i in range(50)], "frame_index long, mean_px double, floor_px double, classification string")
    rng = random.Random(0)
    assert stability.drift(frames(lambda i: 0.5 + 0.5 * i)).first()["classification"] == "BAD"
    assert stability.drift(frames(lambda i: 1 + rng.gauss(0, 0.05))).first()["significant"] in (True, False)
    assert stability.drift(frames(lambda i: 1.0).limit(3)).first()["classification"] == "FAIL"
    one = stability.multiframe(frames(lambda i: 0.1 + 0.001 * (i % 3))).first()
    assert one["classification"] == "GOOD" and one["valid_ratio"] == 1 and stability.multiframe(frames(float).limit(5)).first()["classification"] == "FAIL"


def test_percentiles_and_blocks(spark):
    rng = random.Random(5)
    rows = [(k, x) for k, n in ((0, 1), (1, 2), (2, 5000)) for x in ([rng.choice([1.0, 1.0, 2.5, rng.gauss(0, 1e6)]) for _ in range(n)])] + [(3, 7.0)] * 9 + [(4, None)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(5)
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    for r in order_statistics.exact_percentiles(df, "k", "x", shares).collect():
        values = [x for k, x in rows if k == r["k"]]
        assert np.allclose([r[n] for n in shares], np.percentile(values, [100 * s for s in shares.values()])), r
    for n, blocks in ((9, 3), (10, 3), (2, 5), (101, 4)):
        index = sorted(rng.sample(range(10_000), n))
        got = stability.time_blocks(spark.createDataFrame([(i,) for i in index], "frame_index long").repartition(3), blocks).orderBy("frame_index").collect()
        want = [b + 1 for b, part in enumerate(np.array_split(np.arange(n), blocks)) for _ in part]
        assert [r["block"] for r in got] == want
    with pytest.raises(ValueError):
        stability.time_blocks(df, 0)


def test_rules_with_missing_facts(spark):
    """Nothing known gives no cause; the known cause comes first."""
    names = "run int, sync_class string, offset_ms double, std_ms double, drop_ratio double, left_px double, right_px double, h_center_px double, top_px double, bottom_px double, v_center_px double, depth_trend string, near_px double, far_px double, contamination double, overall_class string, overall_px double, static_class string, static_px double, m3_class string, worst_block int, worst_px double, worst_metric string, worst_diff double, worst_text string, axes map<string,string>"
    blank = dict.fromkeys(x.split()[0] for x in names.split(", "))
    known = [blank | {"run": 0}, blank | {"run": 1, "sync_class": "FAIL", "axes": {"tz": "HIGH"}}, blank | {"run": 2, "left_px": 1.0, "right_px": 9.0, "h_center_px": 1.0, "axes": {"yaw_deg": "HIGH", "tx": "LOW"}}, blank | {"run": 3, "contamination": 0.4, "static_class": "BAD"}]
    facts = spark.createDataFrame(known, names)
    found = [(r["run"], r["rank"], r["cause"], r["confidence"]) for r in decisions.root_causes(facts).orderBy("run", "rank").collect()]
    assert found == [(1, 1, "UNEXPLAINED_SENSITIVITY_TZ", "LOW"), (2, 1, "YAW_MISALIGNMENT", "HIGH")]
    assert decisions.confirmations(facts).count() == 0
    with pytest.raises(ValueError):
        decisions.quality(facts, {"geometry": 1.0})


def test_scores_follow_classes(spark):
    rng = random.Random(42)
    df = spark.createDataFrame([(rng.uniform(0, 8),) for _ in range(500)], "r double")
    for good, warning in ((2.0, 5.0), (1.0, 3.0)):
        kind, points = noise_floor.classify(F.col("r"), F.lit(1.0), good, warning), noise_floor.score(F.col("r"), F.lit(1.0), good, warning)
        assert df.where(noise_floor.score_class(points) != kind).count() == 0
    odd = spark.range(1).select(noise_floor.classify(F.lit(float("nan")), F.lit(1.0)).alias("a"), noise_floor.score(F.lit(1.0), F.lit(0.0)).alias("b"), noise_floor.score(F.lit(float("nan")), F.lit(1.0)).alias("c")).first()
    assert odd["a"] == "FAIL" and odd["b"] is None and odd["c"] is None
    with pytest.raises(Exception, match="never negative"):
        spark.range(1).select(noise_floor.score(F.lit(-1.0), F.lit(1.0))).collect()


def test_inputs_that_are_wrong(spark):
    rigs = spark.createDataFrame([(1, float("nan"), 1.0, 5.0, 5.0, 10, 10, "plumb_bob", {"k1": float("inf")}), (2, 5.0, 5.0, 50.0, 5.0, 10, 0, "none", None)], "rig int, fx double, fy double, cx double, cy double, width int, height int, lens string, coefficients map<string,double>")
    got = {(r["rig"], r["name"].split(".")[1]): r["status"] for r in validation.rig_checks(rigs).collect()}
    assert got[(1, "fx_positive")] == got[(1, "distortion_params_valid")] == got[(2, "image_size_valid")] == "INVALID" and got[(2, "cx_in_image_bounds")] == "WARNING"
    scan = spark.createDataFrame([(1, 0, 0, float("nan") if i % 2 else 1.0) for i in range(10)], "rig int, frame_id long, position int, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    frames = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "rig int, frame_id long, position int")
    status = {r["name"]: r["status"] for r in validation.scan_checks(validation.sampled_frames(frames), scan).collect()}
    assert status["lidar.point_count_nonzero"] == status["lidar.xyz_finite"] == "INVALID" and status["lidar.point_count_sufficient"] == "WARNING"
    with pytest.raises(Exception, match="input invalid"):
        validation.combined(validation.rig_checks(rigs), raise_on_invalid=True).collect()


def test_reports_are_strict_json(spark, tmp_path):
    m2 = spark.createDataFrame([(1, float("nan"), float("inf"), "FAIL")], "run int, mean_px double, floor_px double, classification string")
    whole = report.report(m2.select("run"), {"m2_edge_alignment": report.section(m2, "m2_edge_alignment", metric="M2")})
    report.write_json(whole, str(tmp_path / "j"))
    text = spark.read.text(str(tmp_path / "j")).first()[0]
    found = json.loads(text, parse_constant=lambda x: pytest.fail(x))
    assert list(found) == list(report.SECTIONS) and found["m2_edge_alignment"] == {"metric": "M2", "mean_px": None, "floor_px": None, "classification": "FAIL"} and found["advanced"] is None
    (tmp_path / "old.json").write_text(json.dumps({"quality_score": {"overall_score": 90.0, "overall_classification": "GOOD", "categories": [{"name": "geometry", "score": None, "classification": "FAIL"}]}}))
    assert {(r["name"], r["score"]) for r in files.previous_report(spark, str(tmp_path / "old.json")).collect()} == {("overall", 90.0), ("geometry", None)}
    report.write_tables({"m2": m2}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "m2")).count() == 1


def test_views(spark):
    rows = views.histogram(spark.createDataFrame([(float(x),) for x in (0, 1, 2, 39.9, 40, float("nan"))], "x double"), "x").orderBy("bin").collect()
    assert len(rows) == 40 and [r["n"] for r in rows][:3] == [1, 1, 1] and rows[-1]["n"] == 2
    assert views.histogram(spark.createDataFrame([(3.0,)], "x double"), "x").where("n > 0").count() == 1
    colours = spark.createDataFrame([(0.0,), (2.0,), (99.0,), (None,)], "v double").select(views.cell_colour(F.col("v"), 1.0, 2.0, 5.0)).collect()
    assert [tuple(r[0]) if r[0] else None for r in colours] == [*views.RAMP, None]
    assert sorted(r["n_static"] for r in decisions.label_counts(spark.createDataFrame([("static",), ("dynamic",)], "label string")).collect()) == [1]
