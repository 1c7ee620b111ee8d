"""Every registered query against its SQL on the smallest tables, and properties of the operators."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lynceus import decision_queries, driver_queries, frame_queries  # noqa: F401
from lynceus.operators import noise_floor, projection, radius, scans, stability
from lynceus.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in ("lineitem", "orders", "events", "nation", "supplier", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str([None if v is None or v != v else v if isinstance(v, str) else float(v) for v in row]) for row in frame.values.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _rows(mine) == _rows(theirs)


def test_depth_step_scene_has_a_near_edge(spark):
    """A step from 5 m to 10 m in the middle of the image: the edge lies on the near side."""
    n = 41
    rows = [(1, i * n + j, float(i * 3 - 60) / 100 * (5 if i < 20 else 10), float(j * 3 - 60) / 100 * (5 if i < 20 else 10), 5.0 if i < 20 else 10.0) for i in range(n) for j in range(n)]
    pts = spark.createDataFrame(rows, "frame_id int, point_id int, x double, y double, z double")
    rig = projection.Rig(200, 200, 100.0, 100.0, 100.0, 100.0)
    placed = projection.project(pts, rig)
    assert placed.count() == n * n
    edges = radius.edge_points(placed)
    assert {r["depth"] for r in edges.collect()} == {5.0} and edges.count() == n


def test_floor_scores_and_classes(spark):
    one = spark.range(1)
    row = one.select(*[noise_floor.score(F.lit(x), F.lit(1.0)).alias(f"s{i}") for i, x in enumerate((0.0, 2.0, 5.0))], noise_floor.classify(F.lit(2.0), F.lit(1.0)).alias("c")).first()
    assert [round(row[i], 6) for i in range(3)] == [100.0, 80.0, 50.0] and row["c"] == "WARNING"


def test_outliers_and_wrap(spark):
    frames = spark.createDataFrame([(i, 0.1 if i == 39 else 0.0) for i in range(40)], "frame_index long, mean_px double")
    for rule in ("hampel", "multiplier"):
        found = [r for r in stability.outliers(frames, rule).collect() if r["is_outlier"]]
        assert rule == "multiplier" or ([r["frame_index"] for r in found] == [39] and found[0]["z"] is None)
    ring = spark.createDataFrame([(0, 0, a, 5.0 if a < 18 else 10.0) for a in range(36)], "frame_id int, ring int, az int, range_m double")
    edge = lambda **k: sorted(r["az"] for r in scans.edge_cells(ring, 1.0, 36, **k).collect())
    assert edge() == [0, 17] and edge(wrap=False) == [17]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_axis_sensitivity_has_every_axis(spark, duck):
    """All six axes, each by its least and its largest step, as the 54 candidates have them."""
    axes = ["pitch_deg", "roll_deg", "tx", "ty", "tz", "yaw_deg"]
    assert sorted(duck.sql(ORACLES["axis_sensitivity_m2"]).df()["axis"]) == axes
    mine = QUERIES["axis_sensitivity_m2"](spark, DATA).toPandas()
    assert sorted(mine["axis"]) == axes and (mine["small_px"] != mine["large_px"]).all()
