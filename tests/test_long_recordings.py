"""Recordings and groups that no task may hold: folded matching, and percentiles of heavy tails."""

import math
import random

import numpy as np
import pytest

from lynceus.operators import order_statistics, sync


def streams(seed, rigs=6):
    """Streams of whole numbers (many ties), of steady rates, with bursts, gaps and clock offsets."""
    rng = random.Random(seed)
    cam, lid = [], []
    for r in range(rigs):
        n, m = rng.randint(0, 90), rng.randint(0, 90)
        if r % 3 == 0:
            a, b = ([float(rng.randint(0, 40)) for _ in range(k)] for k in (n, m))
        elif r % 3 == 1:
            a, b = [i * 0.1 + rng.uniform(-0.02, 0.02) for i in range(n)], [i * 0.13 + 5.0 * (r > 2) for i in range(m)]
        else:
            a, b = [rng.choice([0.0, 10.0, 11.0]) + rng.random() for _ in range(n)], [rng.random() * 12 for _ in range(m)]
        cam += [(r if r else None, i, t) for i, t in enumerate(a)]
        lid += [(r if r else None, i, t) for i, t in enumerate(b)]
    return [*cam, (1, 999, None)], lid


@pytest.mark.parametrize("seed,window", [(1, 0.05), (2, 1.0), (3, 4.0)])
def test_folded_matching_equals_one_task(spark, monkeypatch, seed, window):
    cam, lid = (spark.createDataFrame(rows, "rig int, id long, t double") for rows in streams(seed))
    order = lambda df: sorted(map(tuple, df.collect()), key=lambda r: (r[0] or 0, r[1]))
    nearest = lambda: sorted(map(str, sync.nearest_of_any(cam, lid).collect()))
    want, want_nearest = order(sync.monotonic_sync(cam, lid, window)), nearest()
    monkeypatch.setattr(sync, "PIECE_ROWS", 16)
    assert order(sync.monotonic_sync(cam, lid, window)) == want and len(want) > 20
    assert nearest() == want_nearest


def test_maps_of_entries():
    rng = random.Random(4)
    for _ in range(2000):
        aim, lidar = (np.array(sorted(float(rng.randint(0, 20)) for _ in range(rng.randint(1, 12)))) for _ in range(2))
        window = float(rng.randint(0, 4))
        leaves, counts = sync.entry_map(aim, lidar, window)
        nearest, last_of = sync.nearest_places(aim, lidar)
        for entry, (leave, made) in enumerate(zip(leaves, counts)):
            pairs = sync.match_in_order(aim, lidar, window, 0.0, entry)
            assert made == len(pairs)
            place = entry
            for near, x in zip(nearest, aim):
                if place >= len(lidar):
                    break
                place = last_of[max(place, near)]
                place += abs(lidar[place] - x) <= window
            assert leave == place


VALUES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1e-310, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0), -1.0, 1e308, 1.7976931348623157e308, math.inf, -math.inf, math.nan, 3.0, 4.0, math.nextafter(4.0, 0), 0.1, 1e-5]


def test_bits_are_in_order(spark):
    rng = random.Random(5)
    values = VALUES + [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1070, 1020) for _ in range(2000)] + [2.0**k for k in range(-1074, 1024)] + [math.nextafter(2.0**k, 0) for k in range(-1022, 1024)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", order_statistics.ordered_bits(order_statistics.F.col("x")).alias("b")).collect()
    key = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v)
    rows.sort(key=lambda r: key(r["x"]))
    for p, q in zip(rows, rows[1:]):
        assert (p["b"] == q["b"]) == (key(p["x"]) == key(q["x"])) and p["b"] <= q["b"], (p, q)


@pytest.mark.parametrize("cell", [8, 65_536])
def test_percentiles_of_heavy_tails(spark, monkeypatch, cell):
    monkeypatch.setattr(order_statistics, "CELL_ROWS", cell)
    rng = random.Random(6)
    rows = [("tail", rng.gauss(0, 1)) for _ in range(3000)] + [("tail", 1e9), ("tail", -1e300)] + [("same", 7.0)] * 500 + [("two", x) for x in (1.0, 2.0)] + [(None, rng.random()) for _ in range(100)]
    rows += [("one", 3.0), ("none", None)] + [("close", 1.0 + k * 2.0**-52) for k in range(200)] + [("cauchy", math.tan(math.pi * (rng.random() - 0.5))) for _ in range(2000)]
    got = {r["g"]: r for r in order_statistics.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}).collect()}
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    assert set(got) == set(groups)
    for g, x in groups.items():
        for name, q in zip("abcd", (0, 50, 95, 100)):
            assert got[g][name] == pytest.approx(np.percentile(x, q), rel=1e-12, abs=1e-12), (g, name)


def test_no_large_cell_is_sorted(spark, monkeypatch):
    """200,000 values and one outlier: what is left to sort is at most a cell."""
    monkeypatch.setattr(order_statistics, "CELL_ROWS", 1000)
    values = spark.range(200_001).selectExpr("1 AS g", "CASE WHEN id = 0 THEN 1e9D ELSE 1 + id / 200000D END AS v")
    cells = []
    plain = order_statistics.written
    monkeypatch.setattr(order_statistics, "written", lambda df: cells.append(plain(df)) or cells[-1])
    got = order_statistics.exact_percentiles(values, "g", "v", {"m": 0.5}).first()
    assert got["m"] == pytest.approx(1.500005, abs=1e-9)
    assert cells[-1].agg({"m": "max"}).first()[0] <= 1000


def brute_edges(rows, radius, jump, least):
    out = set()
    for f, i, u, v, d in rows:
        near = [e for g, _, x, y, e in rows if g == f and (u - x) ** 2 + (v - y) ** 2 <= radius * radius]
        if len(near) >= least and max(near) - min(near) > jump and d <= min(near) + 1e-9:
            out.add(i)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_dense_cells_equal_all_pairs(spark, monkeypatch, seed):
    from lynceus.operators import radius

    monkeypatch.setattr(radius, "DENSE", 6)
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        f, (cu, cv, s) = i % 2, rng.choice([(10, 10, 1.5), (40, 30, 4), (30, 30, 15), (12, 14, 0.4)])
        u, v = rng.gauss(cu, s), rng.gauss(cv, s)
        rows.append((f, i, round(u) if seed == 1 else u, round(v) if seed == 1 else v, rng.choice([5.0, 5.2, 5.25, 5.5]) if seed < 3 else 5 + rng.random() / 2))
    rows += [(3, 500 + i, float(i % 3), 0.0, 5.0) for i in range(40)] + [(3, 600, 4.9, 0.0, 9.0)]
    rows = [(f, i, float(u), float(v), d) for f, i, u, v, d in rows]
    df = spark.createDataFrame(rows, "frame_id int, point_id int, u double, v double, depth double").repartition(3)
    got = radius.edge_points(df).collect()
    assert {r["point_id"] for r in got} == brute_edges(rows, 3.0, 0.3, 3) and len(got) == len({r["point_id"] for r in got})


def test_a_million_points_on_one_cell(spark):
    from lynceus.operators import radius

    h = "(xxhash64(id, {}) & 1048575) / 1048576D"
    df = spark.range(1_000_000).selectExpr("1 AS frame_id", "id AS point_id", f"{h.format(1)} * 3 AS u", f"{h.format(2)} * 3 AS v", f"5 + {h.format(3)} AS depth")
    found = [r["depth"] for r in radius.edge_points(df).collect()]
    assert found and min(found) == df.agg({"depth": "min"}).first()[0] and max(found) < 5.001


def test_frames_in_strips_equal_whole_frames(spark, monkeypatch):
    from lynceus.operators import neighbours

    rng = random.Random(8)
    rows = []
    for i in range(700):
        f = rng.choice([0, 0, 0, 1, 2])
        cu, cv, s = rng.choice([(10, 10, 1.0), (200, 30, 30), (100, 300, 3)])
        u, v = (rng.gauss(cu, s), rng.gauss(cv, s)) if f else (float(rng.randint(0, 30)), 300 * rng.random())
        rows.append((f, i, u, v, rng.random() < 0.8, u + rng.gauss(2, 1), v + rng.gauss(1, 3), 1.0, 1))
    rows += [(5, 900, 1.0, 1.0, True, 2.0, 2.0, 1.0, 1), (6, 901, 1.0, 1.0, False, 2.0, 2.0, 15.0, 0), (7, 902, 0.0, 0.0, True, 0.0, 5.0, 5.0, 1), (7, 903, 1e4, 0.0, True, 9e3, 5.0, 5.0, 1)]
    rows = [(*r[:5], *((r[5], r[6]) if r[4] else (None, None)), float(r[7]), r[8]) for r in rows]
    df = spark.createDataFrame(rows, "frame_id int, point_id long, u double, v double, matched boolean, pixel_u double, pixel_v double, distance_px double, num_candidates long").repartition(3)
    ask = lambda: [sorted(map(str, (r.asDict() for r in out.select(sorted(out.columns)).collect()))) for out in (neighbours.edge_directions(df), neighbours.agreeing(df))]
    want = ask()
    monkeypatch.setattr(neighbours, "FRAME_ROWS", 60)
    assert ask() == want and sum("consistency" in r for r in want[1]) > 10


def test_planes_in_pieces(spark, monkeypatch):
    from lynceus.operators import planes

    rng = random.Random(3)
    rows = [(f, i, rng.random() * 5, rng.random() * 5, 0.01 * rng.random() if i % 3 else rng.random() * 5) for f in (1, 2) for i in range(300)] + [(3, 1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "frame_id int, point_id int, x double, y double, z double").repartition(4)
    want = sorted(map(tuple, planes.dominant_planes(df).collect()))
    monkeypatch.setattr(planes, "PIECE_ROWS", 50)
    monkeypatch.setattr(planes, "BROADCAST_FRAMES", 0)
    assert sorted(map(tuple, planes.dominant_planes(df).collect())) == want and len(want) == 2
    for f, n, nx, ny, nz, o, k, share in want:
        assert abs(nz) > 0.99 and k == sum(abs(x * nx + y * ny + z * nz + o) <= 0.05 for g, _, x, y, z in rows if g == f) and share == k / n


def test_parts_with_seeds():
    from lynceus.operators import images

    rng = np.random.default_rng(2)

    def flood(mask, seeds):
        out, todo = np.zeros_like(mask), list(zip(*np.nonzero(mask & seeds)))
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = True
                todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        return out

    for share in (0.05, 0.3, 0.5, 0.8):
        for _ in range(60):
            mask = rng.random((int(rng.integers(1, 25)), int(rng.integers(1, 25)))) < share
            seeds = rng.random(mask.shape) < 0.05
            assert (images.with_seeds(mask, seeds) == flood(mask, seeds)).all()
    spiral = np.zeros((101, 101), bool)
    y = x = 0
    dy, dx, left, turns = 0, 1, 100, 0
    while left > 0:
        for _ in range(left):
            spiral[y, x] = True
            y, x = y + dy, x + dx
        dy, dx, turns = dx, -dy, turns + 1
        left -= 2 if turns % 2 == 1 and turns > 1 else 0
    spiral[y, x] = True
    seeds = np.zeros_like(spiral)
    seeds[0, 0] = True
    assert (images.with_seeds(spiral, seeds) == flood(spiral, seeds)).all() and images.with_seeds(spiral, seeds).sum() > 2000


def test_nearest_rows_of_dense_streams(spark):
    """60,000 rows a side within one bucket and one piece: pairs of all, or windows read anew for each row, would take many minutes."""
    import time

    from lynceus.operators import stability

    h = "CAST(pmod(xxhash64(id, {}), 40000) AS DOUBLE) / 64"
    left, right = (spark.range(60_000).selectExpr("1 AS rig", "id", f"{h.format(k)} AS t") for k in (1, 2))
    began = time.time()
    near = {r["left_id"]: r for r in sync.nearest_of_any(left, right).collect()}
    within = {r["left_id"]: r for r in stability.nearest_in_time(left, right, 600.0).collect()}
    assert time.time() - began < 90
    ids, t = (np.array(x) for x in zip(*[(r["id"], r["t"]) for r in right.orderBy("t", "id").collect()]))
    mine = left.collect()
    assert len(near) == len(within) == len(mine)
    for r in mine[::50]:
        d = np.abs(t - r["t"])
        first = int(np.argmin(d))  # the earliest of the nearest, and of its time the smallest id
        assert (within[r["id"]]["right_id"], within[r["id"]]["diff_s"]) == (ids[first], t[first] - r["t"])
        assert near[r["id"]]["diff_s"] == r["t"] - t[first]


def shuffled_rows(spark):
    """Rows written to shuffles so far by this session."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


def test_points_are_shuffled_about_once_for_their_neighbours(spark):
    """Nine copies of each point, and edge points worked out again for each of their readers, were some twenty times the rows."""
    from lynceus.operators import neighbours, radius

    rng = random.Random(4)
    rows = [(i % 2, i, rng.uniform(-250, 420), rng.uniform(-10, 230), float(rng.choice([5, 5, 5, 6, 9]))) for i in range(6000)]
    rows += [(1, 6000 + i, 192.0 * (i % 3), 192.0 + (i // 3 - 2) * 1.5, 5.0 + i % 2) for i in range(12)]  # on the tiles' sides
    df = spark.createDataFrame(rows, "frame_id int, point_id int, u double, v double, depth double").repartition(3)
    before = shuffled_rows(spark)
    edges = radius.edge_points(df)
    got = neighbours.edge_directions(edges).select("point_id").collect()
    moved = shuffled_rows(spark) - before
    want = set()
    for f in (0, 1):
        i, u, v, d = (np.array([r[k] for r in rows if r[0] == f]) for k in (1, 2, 3, 4))
        near = (u[:, None] - u) ** 2 + (v[:, None] - v) ** 2 <= 9
        low, high = np.where(near, d, np.inf).min(1), np.where(near, d, -np.inf).max(1)
        want |= set(i[(near.sum(1) >= 3) & (high - low > 0.3) & (d <= low + 1e-9)].tolist())
    assert {r["point_id"] for r in got} == want and len(got) == len(want) > 100
    assert moved < 6 * len(rows)


def test_planes_meet_blocks_of_points(spark, monkeypatch):
    """A frame's planes come once to each block of its points, not to each point; blocks of any size count the same."""
    from lynceus.operators import planes

    rng = random.Random(6)
    rows = [(f, i, rng.random() * 4, rng.random() * 4, 1.0 if i % 2 else rng.random()) for f in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double")
    want = sorted(map(tuple, planes.dominant_planes(df).collect()))
    monkeypatch.setattr(planes, "BLOCK_ROWS", 64)
    monkeypatch.setattr(planes, "CHUNK", 10)
    got = planes.dominant_planes(df)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 2
    placed = planes.numbered(df)
    found = planes.candidate_planes(placed, planes.random_triples(df.groupBy("frame_id").count().withColumnRenamed("count", "n")))
    counts = {r["frame_id"]: r["counts"] for r in planes.near_counts(placed, found, 0.05).collect()}
    for r in found.collect():
        xyz = np.array([p[2:] for p in rows if p[0] == r["frame_id"]])
        assert counts[r["frame_id"]] == [int((abs(xyz @ [p["nx"], p["ny"], p["nz"]] + p["offset"]) <= 0.05).sum()) for p in r["planes"]]
