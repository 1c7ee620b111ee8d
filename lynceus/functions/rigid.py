"""Rotations and rigid transforms as columns: nine numbers of a matrix, row by row, and three of a shift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres in a unit; how far a rotation may be off; the longest plausible shift.
UNITS = {"m": 1.0, "cm": 0.01, "mm": 0.001}
TOLERANCE, MAX_SHIFT_M = 1e-3, 100.0
Matrix = list[Column]


def product(a: Matrix, b: Matrix) -> Matrix:
    return [sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)]


def transposed(a: Matrix) -> Matrix:
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def applied(a: Matrix, v: Sequence[Column]) -> list[Column]:
    return [a[3 * i] * v[0] + a[3 * i + 1] * v[1] + a[3 * i + 2] * v[2] for i in range(3)]


def from_angles(roll: Column, pitch: Column, yaw: Column, degrees: bool = True) -> Matrix:
    """Yaw after pitch after roll, about the moving axes z, y, x."""
    r, p, y = (F.radians(c) if degrees else c for c in (roll, pitch, yaw))
    zero, one = F.lit(0.0), F.lit(1.0)
    about_x = [one, zero, zero, zero, F.cos(r), -F.sin(r), zero, F.sin(r), F.cos(r)]
    about_y = [F.cos(p), zero, F.sin(p), zero, one, zero, -F.sin(p), zero, F.cos(p)]
    about_z = [F.cos(y), -F.sin(y), zero, F.sin(y), F.cos(y), zero, zero, zero, one]
    return product(about_z, product(about_y, about_x))


def from_quaternion(x: Column, y: Column, z: Column, w: Column) -> Matrix:
    """Of any length but zero, which is an error."""
    size = F.sqrt(x * x + y * y + z * z + w * w)
    size = F.when(size < 1e-12, F.raise_error(F.lit("a quaternion of length zero is no rotation")).cast("double")).otherwise(size)
    x, y, z, w = (c / size for c in (x, y, z, w))
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def determinant(a: Matrix) -> Column:
    return a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])


def orthogonality_error(a: Matrix) -> Column:
    """The largest entry of a times its transpose less the identity, in size."""
    return F.greatest(*[F.abs(c - (1.0 if i % 4 == 0 else 0.0)) for i, c in enumerate(product(a, transposed(a)))])


def is_rotation(a: Matrix, tolerance: float = TOLERANCE) -> Column:
    return (F.abs(determinant(a) - 1) < tolerance) & (orthogonality_error(a) < tolerance)


def inverted(a: Matrix, shift: Sequence[Column]) -> tuple[Matrix, list[Column]]:
    back = transposed(a)
    return back, [-c for c in applied(back, shift)]


def composed(a: Matrix, shift_a: Sequence[Column], b: Matrix, shift_b: Sequence[Column]) -> tuple[Matrix, list[Column]]:
    """First b, then a."""
    return product(a, b), [x + y for x, y in zip(applied(a, shift_b), shift_a)]


def normalised_extrinsics(raw: DataFrame, key: str = "rig") -> DataFrame:
    """key, m0..m11: the transform from LiDAR to camera, row by row, in metres.

    ``raw``: key, parent, child (lidar and camera, either way round), unit (m, cm, mm), rotation_format (rpy_deg,
    rpy_rad, quaternion, matrix3x3, matrix4x4), rotation and translation (arrays of doubles, matrices row by row).
    A 4 x 4 matrix holds its own translation. Anything else is an error.
    """
    e = lambda i: F.get("rotation", F.lit(i))
    forms = {
        "rpy_deg": (3, from_angles(e(0), e(1), e(2))), "rpy_rad": (3, from_angles(e(0), e(1), e(2), False)), "quaternion": (4, from_quaternion(e(0), e(1), e(2), e(3))),
        "matrix3x3": (9, [e(i) for i in range(9)]), "matrix4x4": (16, [e(4 * i + j) for i in range(3) for j in range(3)]),
    }
    form = F.col("rotation_format")
    unknown = lambda what: F.raise_error(F.concat(F.lit(f"unknown or malformed {what}: "), F.coalesce(F.col(what).cast("string"), F.lit("null"))))
    chain = F.when(F.lit(False), F.lit(None).cast("array<double>"))
    for name, (size, matrix) in forms.items():
        chain = chain.when((form == name) & (F.size("rotation") == size), F.array(*matrix))
    scale = F.element_at(F.create_map(*[F.lit(x) for item in UNITS.items() for x in item]), F.col("unit"))
    scale = F.coalesce(scale, unknown("unit").cast("double"))
    own = F.when(form == "matrix4x4", F.array(e(3), e(7), e(11))).otherwise(F.col("translation"))
    rows = raw.select(key, "parent", "child", chain.otherwise(unknown("rotation_format").cast("array<double>")).alias("r"), F.transform(own, lambda x: x * scale).alias("t"))
    r, t = [F.col("r")[i] for i in range(9)], [F.col("t")[i] for i in range(3)]
    forward, (back, back_t) = (r, t), inverted(r, t)
    row = lambda m, s: F.array(*[x for i in range(3) for x in (m[3 * i], m[3 * i + 1], m[3 * i + 2], s[i])])
    way = F.concat_ws(">", "parent", "child")
    both = F.when(way == "lidar>camera", row(*forward)).when(way == "camera>lidar", row(back, back_t)).otherwise(F.raise_error(F.concat(F.lit("not a LiDAR and a camera: "), way)).cast("array<double>"))
    return rows.select(key, both.alias("m")).select(key, *[F.col("m")[i].alias(f"m{i}") for i in range(12)])


def extrinsic_checks(transforms: DataFrame, key: str = "rig", tolerance: float = TOLERANCE, max_shift_m: float = MAX_SHIFT_M) -> DataFrame:
    """key, name, passed, value: four checks of each transform (m0..m11, and optionally bottom, an array of the last row)."""
    m = [F.col(f"m{4 * i + j}") for i in range(3) for j in range(3)]
    t = [F.col("m3"), F.col("m7"), F.col("m11")]
    finite = F.lit(True)
    for c in t:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    length = F.when(finite, F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2]))
    last = F.lit(True) if "bottom" not in transforms.columns else F.aggregate(F.zip_with("bottom", F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))), lambda a, b: F.abs(a - b)), F.lit(0.0), F.greatest) <= 1e-9
    item = lambda name, passed, value=None: F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), (F.lit(None) if value is None else value).cast("double").alias("value"))
    items = F.array(
        item("rotation_valid", is_rotation(m, tolerance), orthogonality_error(m)), item("translation_finite", finite),
        item("translation_magnitude_plausible", length <= max_shift_m, length), item("homogeneous_bottom_row_valid", last),
    )
    return transforms.select(key, F.explode(items).alias("i")).select(key, "i.*")
