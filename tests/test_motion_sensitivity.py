"""Deskew and perturbed transforms against their definitions in numpy."""

import math

import numpy as np

from lynceus.operators import motion, projection, sensitivity


def test_deskew_undoes_rotation_and_travel(spark):
    points = spark.createDataFrame([(1, 3.0, 4.0, 1.0, 0.05), (1, -2.0, 0.5, 2.0, 0.0)], "frame_id int, x double, y double, z double, t_offset double")
    v, w = np.array([5.0, 1.0, -2.0]), np.array([0.1, -0.4, 0.7])
    rows = motion.deskew(points, tuple(v), tuple(w), 0.1).collect()
    for before, after in zip(points.collect(), rows):
        dt = 0.1 - before["t_offset"]
        k, angle = w / np.linalg.norm(w), np.linalg.norm(w) * dt
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        turn = np.eye(3) + math.sin(angle) * cross + (1 - math.cos(angle)) * cross @ cross
        expected = turn.T @ (np.array([before[c] for c in "xyz"]) - v * dt)
        assert np.allclose([after[c] for c in "xyz"], expected)
    still = motion.deskew(points, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)).collect()
    assert all(r["correction_m"] == 0 for r in still)


def test_candidates_are_rigid():
    found = sensitivity.candidates(projection.Rig(320, 240, 150.0, 150.0, 160.0, 120.0, (1, 0, 0, 0.2, 0, 1, 0, -0.1, 0, 0, 1, 0.1)))
    assert len(found) == 54
    for axis, sign, delta, *m in found:
        m = np.array(m).reshape(3, 4)
        assert np.allclose(m[:, :3] @ m[:, :3].T, np.eye(3)) and np.isclose(np.linalg.det(m[:, :3]), 1)
        if axis.startswith("t"):
            assert np.isclose(m["xyz".index(axis[1]), 3], (0.2, -0.1, 0.1)["xyz".index(axis[1])] + sign * delta)
        if axis == "yaw_deg":
            assert np.isclose(m[1, 0], sign * math.sin(math.radians(delta)))
