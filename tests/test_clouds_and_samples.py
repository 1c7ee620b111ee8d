"""Point clouds read in pieces, samples of each group, rings and times."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.operators import motion, scans, views
from lynceus.sources import clouds, frames


def binary_pcd(n, seed, fields="x y z intensity ring", sizes="4 4 4 4 2", types="F F F F U"):
    rng = np.random.default_rng(seed)
    layout = np.dtype([(f, frames.PCD_TYPES[t, int(s)]) for f, s, t in zip(fields.split(), sizes.split(), types.split())])
    rows = np.zeros(n, layout)
    for f in "xyz":
        rows[f] = rng.normal(size=n)
    if "intensity" in layout.names:
        rows["intensity"] = rng.random(n)
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS {fields}\nSIZE {sizes}\nTYPE {types}\nCOUNT {' '.join('1' for _ in fields.split())}\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA binary\n"
    return head.encode() + rows.tobytes()


def test_large_files_are_read_in_pieces(spark, tmp_path):
    contents = {"1.5.pcd": binary_pcd(20_000, 1), "2.5.pcd": binary_pcd(3, 2, "x y z", "4 4 4", "F F F"), "30.pcd": b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nPOINTS 1\nDATA ascii\n1 2 3\n"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "note.txt").write_text("x")
    df = clouds.cloud_pieces(spark, str(tmp_path), 50_000)
    assert df.rdd.getNumPartitions() >= 8
    got = {}
    for r in df.collect():
        got.setdefault(r["path"].rsplit("/", 1)[-1], {})[r["point_id"]] = (r["x"], r["y"], r["z"], math.nan if r["intensity"] is None else r["intensity"])
    for name, content in contents.items():
        want = frames.parse_pcd(content)
        assert np.array_equal(np.array([got[name][i] for i in range(want.shape[1])], np.float32).T, want, equal_nan=True)
    # A bound of the time leaves the other files unread, so a broken one among them is no error.
    (tmp_path / "40.pcd").write_bytes(contents["1.5.pcd"][:5000])
    late = clouds.cloud_pieces(spark, str(tmp_path), 50_000).where("t > 2 and t <= 30")
    assert late.rdd.getNumPartitions() == 2 and {r["t"] for r in late.select("t").distinct().collect()} == {2.5, 30.0}
    assert clouds.cloud_pieces(spark, str(tmp_path)).where("t = 7").count() == 0
    with pytest.raises(Exception, match="40.pcd.*ends before its last point"):
        clouds.cloud_pieces(spark, f"file://{tmp_path}").where("t = 40").count()
    with pytest.raises(Exception, match="fields are missing"):
        clouds.pieces_of("a.pcd", b"FIELDS x y\nSIZE 4 4\nTYPE F F\nCOUNT 1 1\nPOINTS 1\nDATA binary\n", 10)


def test_samples_of_each_group(spark, monkeypatch):
    monkeypatch.setattr(views, "SAMPLE_ROWS", 40)
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i, float(i)) for i in range(900)] + [(3, 5000, 1.0)]
    df = spark.createDataFrame(rows, "frame_id int, point_id long, x double").repartition(5)
    hashes = {r[0]: r[1] for r in df.select("point_id", F.xxhash64("point_id")).collect()}
    got = views.sampled_points(df, 20).collect()
    for f in {r[0] for r in rows}:
        want = sorted((r[1] for r in rows if r[0] == f), key=lambda i: (hashes[i], i))[:20]
        assert sorted(r["point_id"] for r in got if r["frame_id"] == f) == sorted(want)
    assert views.sampled_points(df.limit(0), 20).count() == 0


def test_rings(spark):
    nan = math.nan
    rows = [(1, 1, 1.0, 0.0, 0.0, 3), (1, 2, 1.0, 0.0, 1.0, 70), (1, 3, 1.0, 0.0, nan, -4), (1, 4, 0.0, 1.0, 0.5, None), (2, 5, 1.0, 1.0, 0.0, 1), (2, 6, 2.0, 2.0, 0.0, 1), (3, 7, nan, 0.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "frame_id int, point_id int, x double, y double, z double, channel int")
    ring = lambda **k: {r["point_id"]: r["ring"] for r in scans.with_cells(df, **k).collect()}
    assert ring(fov_deg=None, rings=4) == {1: 0, 2: 3, 3: -1, 4: 2, 5: 0, 6: 0, 7: -1}
    assert ring(ring="channel") == {1: 3, 2: 70, 3: -1, 4: -1, 5: 1, 6: 1, 7: 0}
    assert {r["point_id"] for r in scans.range_image(scans.with_cells(df, ring="channel")).collect()} == {1, 2, 5}
    circle = spark.createDataFrame([(1, i, r * math.cos((i + 0.5) * math.pi / 18), r * math.sin((i + 0.5) * math.pi / 18), 0.0) for i in range(36) for r in [5.0 if i < 18 else 10.0]], "frame_id int, point_id int, x double, y double, z double")
    marks = {r["point_id"]: r["is_edge"] for r in scans.native_edges(scans.with_cells(circle, azimuths=36), 1.0, 36).collect()}
    assert len(marks) == 36 and {i for i, e in marks.items() if e} == {0, 17}


def test_times(spark):
    df = spark.createDataFrame([(1.0, 0.0, -1.0), (0.0, 1.0, 0.04), (-1.0, 0.0, 9.0)], "x double, y double, t double")
    one = lambda **k: [round(r[0], 6) for r in df.select(motion.time_offset(**k)).collect()]
    assert one() == [0.0, 0.025, 0.05] and one(clockwise=True) == [0.0, 0.075, 0.05]
    assert one(start_rad=math.pi / 2) == [0.075, 0.0, 0.025] and one(given=F.col("t")) == [0.0, 0.04, 0.1]
