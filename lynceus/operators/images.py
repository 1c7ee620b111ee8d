"""Edges of images as rows, and distances to them. An image is one row; numpy runs on one at a time inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Thresholds of the edge detector; steps of the distance transform.
LOW, HIGH = 50, 150
STRAIGHT, DIAGONAL, KNIGHT = 1.0, 1.4, 2.1969
EDGE_SCHEMA = "frame_id long, pixel_u int, pixel_v int, pixel_deg double, strength double"


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """8-bit grey of a packed image; three channels are blue, green, red."""
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return image[:, :, 0]
    weights = np.array([1868, 9617, 4899], np.int64)  # hundredths of a percent of 2**14
    return ((image[:, :, :3].astype(np.int64) @ weights + (1 << 13)) >> 14).astype(np.uint8)


def gradients(image: np.ndarray, border: str) -> tuple[np.ndarray, np.ndarray]:
    """Sobel's differences along x and y, as numbers of 64 bits; ``border``: edge or reflect."""
    p = np.pad(image.astype(np.float64), 1, mode=border)
    smooth_y, smooth_x = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]


def edge_mask(image: np.ndarray, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Canny's edges: ridges of the gradient above ``high``, and those above ``low`` that touch them."""
    gx, gy = gradients(image, "edge")
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    at = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    steep = np.abs(gy) / np.maximum(np.abs(gx), 1e-12)
    flat, upright, falling = steep < np.tan(np.pi / 8), steep > np.tan(3 * np.pi / 8), gx * gy > 0
    along_x = (size > at(0, -1)) & (size >= at(0, 1))
    along_y = (size > at(-1, 0)) & (size >= at(1, 0))
    down, up = (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1))
    ridge = np.where(flat, along_x, np.where(upright, along_y, np.where(falling, down, up))) & (size > low)
    return with_seeds(ridge, ridge & (size > high))


def with_seeds(mask: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The parts of ``mask`` (8 neighbours) that hold a seed: union-find over the runs of marked pixels in rows, in one pass however long a part winds."""
    h, w = mask.shape
    step = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]  # past the run
    if not len(row):
        return np.zeros_like(mask)
    # Runs of a row touch those of the next row whose ends reach them, corners included: neighbours in both orders.
    first = np.searchsorted(row, np.arange(h + 1))
    line = row * (w + 2)
    low = np.searchsorted(line + end, line + w + 2 + begin)
    high = np.searchsorted(line + begin, line + w + 2 + end, "right")
    low, high = np.maximum(low, first[row + 1]), np.minimum(high, first[np.minimum(row + 2, h)])
    span = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), span)
    b = np.repeat(low - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
    parent = np.arange(len(row))
    while True:  # roots are hooked to smaller roots, then paths are halved until all are flat
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        a, b = a[apart], b[apart]
    v, u = np.nonzero(seeds & mask)
    kept = np.zeros(len(row), bool)
    kept[parent[np.searchsorted(line + begin, v * (w + 2) + u, "right") - 1]] = True
    out = np.zeros((h, w + 1), np.int8)
    chosen = kept[parent]
    out[row[chosen], begin[chosen]] = 1
    out[row[chosen], end[chosen]] = -1
    return np.cumsum(out, axis=1)[:, :w].astype(bool)


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance of each pixel to the nearest marked one, steps of 5 x 5 pixels; infinite without any."""

    def sweep(d: np.ndarray) -> np.ndarray:
        h, w = d.shape
        x = np.arange(w)
        pad = lambda r: np.pad(r, 2, constant_values=np.inf)
        for y in range(h):
            row = d[y]
            if y:
                a = pad(d[y - 1])
                row = np.minimum.reduce([row, a[2:-2] + STRAIGHT, a[1:-3] + DIAGONAL, a[3:-1] + DIAGONAL, a[:-4] + KNIGHT, a[4:] + KNIGHT])
            if y > 1:
                b = pad(d[y - 2])
                row = np.minimum.reduce([row, b[1:-3] + KNIGHT, b[3:-1] + KNIGHT])
            row = np.minimum.accumulate(row - x) + x  # steps to the right, then to the left
            d[y] = (np.minimum.accumulate((row + x)[::-1]))[::-1] - x
        return d

    d = np.where(mask, 0.0, np.inf)
    return sweep(sweep(d)[::-1])[::-1]


def bilinear(values: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``values`` between the four pixels around each (u, v), held inside the image."""
    h, w = values.shape
    u, v = np.clip(u, 0, w - 1 - 1e-6), np.clip(v, 0, h - 1 - 1e-6)
    x, y = np.floor(u).astype(int), np.floor(v).astype(int)
    a, b = u - x, v - y
    return values[y, x] * (1 - a) * (1 - b) + values[y, x + 1] * a * (1 - b) + values[y + 1, x] * (1 - a) * b + values[y + 1, x + 1] * a * b


def _pixels(batches: Iterator[pa.RecordBatch], low: float, high: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            image = grey(row["data"], row["height"], row["width"], row["nchannels"])
            v, u = np.nonzero(edge_mask(image, low, high))
            gx, gy = (g[v, u] for g in gradients(image, "reflect"))
            turn = np.mod(np.degrees(np.arctan2(gy, gx)) + 90, 180)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(u), row["frame_id"], np.int64)), pa.array(u.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(turn), pa.array(np.hypot(gx, gy))],
                ["frame_id", "pixel_u", "pixel_v", "pixel_deg", "strength"],
            )


def edge_pixels(images: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """frame_id, pixel_u, pixel_v, pixel_deg (direction of the edge, 0..180), strength of each edge pixel.

    ``images``: frame_id, height, width, nchannels (1, or 3 and more: blue, green, red first), data. An image without edges has no rows.
    """
    rows = images.select(F.col("frame_id").cast("long").alias("frame_id"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.col("nchannels").cast("int").alias("nchannels"), "data")
    return rows.mapInArrow(lambda b: _pixels(b, low, high), EDGE_SCHEMA)


def edge_distances(images: DataFrame, spots: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """frame_id, point_id, error_px: the distance transform at each of ``spots`` (frame_id, point_id, u, v), between pixels.

    Images meet the spots of their own frame; spots on an image without edges have a null error, those without an image no row.
    """

    def task(image: pa.Table, points: pa.Table) -> pa.Table:
        ids, error = points.column("point_id"), np.full(points.num_rows, np.nan)
        if image.num_rows and points.num_rows:
            row = image.slice(0, 1).to_pylist()[0]
            mask = edge_mask(grey(row["data"], row["height"], row["width"], row["nchannels"]), low, high)
            if mask.any():
                error = bilinear(distance_to(mask), points.column("u").to_numpy(), points.column("v").to_numpy())
        keep = pa.array(np.full(points.num_rows, bool(image.num_rows)))
        return pa.table({"frame_id": points.column("frame_id"), "point_id": ids, "error_px": pa.array(error, from_pandas=True)}).filter(keep)

    kind = spots.schema["point_id"].dataType.simpleString()
    left = images.select(F.col("frame_id").cast("long").alias("frame_id"), "height", "width", "nchannels", "data").groupBy("frame_id")
    right = spots.select(F.col("frame_id").cast("long").alias("frame_id"), "point_id", "u", "v").groupBy("frame_id")
    return left.cogroup(right).applyInArrow(task, f"frame_id long, point_id {kind}, error_px double")
