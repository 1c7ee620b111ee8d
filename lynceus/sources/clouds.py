"""Point clouds as a data source: large binary PCD files are read in pieces, and folders are pruned by the times in file names."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .frames import CLOUD_TYPES, PCD_TYPES, parse_pcd, parse_ply

NAME = "cloud_points"
SCHEMA = "path string, t double, point_id long, x float, y float, z float, intensity float"
#: Bytes of a piece, of the part of a file that holds its header, and points of a batch.
SPLIT_BYTES, HEADER_BYTES, BATCH_POINTS = 64 << 20, 1 << 16, 100_000
_TESTS = {EqualTo: lambda t, v: t == v, GreaterThan: lambda t, v: t > v, GreaterThanOrEqual: lambda t, v: t >= v, LessThan: lambda t, v: t < v, LessThanOrEqual: lambda t, v: t <= v}


def time_of(path: str) -> float | None:
    """Seconds from a numeric file name without its ending, as ``frames.name_time``."""
    stem = os.path.splitext(path.rsplit("/", 1)[-1])[0]
    if not re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", stem):
        return None
    return t if math.isfinite(t := float(stem)) else None


@dataclass
class Piece(InputPartition):
    """Points ``first`` to ``first + count`` of a binary file, of ``size`` bytes each from ``data`` on; a whole file if ``size`` is 0."""

    path: str
    first: int = 0
    count: int = 0
    data: int = 0
    size: int = 0
    fields: tuple = ()


def pieces_of(path: str, head: bytes, split_bytes: int) -> list[Piece]:
    """A binary PCD file in pieces of about ``split_bytes``; any other file whole."""
    found = re.search(rb"^DATA[ \t]+(\w+)[^\n]*\n", head, re.M)
    if not path.lower().endswith(".pcd") or not found or found[1] != b"binary":
        return [Piece(path)]
    header = {w[0]: w[1:] for line in head[: found.start()].decode("ascii").splitlines() if (w := line.split()) and not w[0].startswith("#")}
    sizes, counts = [int(s) for s in header["SIZE"]], [int(c) for c in header["COUNT"]]
    fields = tuple(zip(header["FIELDS"], header["TYPE"], sizes, counts))
    if missing := {"x", "y", "z"} - set(header["FIELDS"]):
        raise ValueError(f"{path}: required fields are missing: {sorted(missing)}")
    if odd := [f for f, t, s, _ in fields if (t, s) not in PCD_TYPES]:
        raise ValueError(f"{path}: field type not supported: {odd[0]}")
    size, n = sum(s * c for s, c in zip(sizes, counts)), int(header["POINTS"][0])
    step = max(1, split_bytes // size)
    return [Piece(path, a, min(step, n - a), found.end(), size, fields) for a in range(0, n, step)]


class CloudReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        """Bounds of t decide which files are listed; everything else is left to Spark."""
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("t",):
                self.tests.append((_TESTS[type(f)], f.value))
            else:
                yield f

    def _listed(self) -> list[str]:
        store, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.path.lower().endswith(CLOUD_TYPES))
        times = [(p, time_of(p)) for p in found]
        return [p for p, t in times if all(t is not None and test(t, value) for test, value in self.tests)]

    def _open(self, path: str) -> pa.NativeFile:
        store = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder or self.folder.startswith("file:") else fs.LocalFileSystem()
        return store.open_input_file(path)

    def partitions(self) -> list[Piece]:
        out = []
        for path in self._listed():
            with self._open(path) as f:
                out += pieces_of(path, f.read_at(min(HEADER_BYTES, f.size()), 0), self.split_bytes)
        return out or [Piece("")]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with self._open(partition.path) as f:
            if not partition.size:
                content = f.read()
                whole = parse_ply(content) if partition.path.lower().endswith(".ply") else parse_pcd(content)
                for a in range(0, whole.shape[1], BATCH_POINTS):
                    yield self._batch(partition.path, a, whole[:, a : a + BATCH_POINTS])
                return
            layout = np.dtype([(n, PCD_TYPES[t, s]) if c == 1 else (n, PCD_TYPES[t, s], (c,)) for n, t, s, c in partition.fields])
            for a in range(partition.first, partition.first + partition.count, BATCH_POINTS):
                m = min(BATCH_POINTS, partition.first + partition.count - a)
                raw = f.read_at(m * partition.size, partition.data + a * partition.size)
                if len(raw) < m * partition.size:
                    raise ValueError(f"{partition.path}: the file ends before its last point")
                rows = np.frombuffer(raw, layout)
                four = [rows[c].astype(np.float32) if c in layout.names else np.full(m, np.nan, np.float32) for c in ("x", "y", "z", "intensity")]
                yield self._batch(partition.path, a, np.stack(four))

    @staticmethod
    def _batch(path: str, first: int, four: np.ndarray) -> pa.RecordBatch:
        m = four.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * m, pa.string()), pa.array([time_of(path)] * m, pa.float64()), pa.array(np.arange(first, first + m)), *[pa.array(c, pa.float32(), from_pandas=k == 3) for k, c in enumerate(four)]],
            ["path", "t", "point_id", "x", "y", "z", "intensity"],
        )


class CloudSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CloudReader:  # noqa: ANN001
        return CloudReader(self.options)


def cloud_pieces(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, t, point_id, x, y, z, intensity of a folder's point clouds: a large binary PCD file is read by several tasks, and
    filters on t (the time in the file's name; null for other names) leave files unread. A broken file is an error that names it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CloudSource)
    return spark.read.format(NAME).option("splitBytes", split_bytes).load(folder)
