"""Folders of images and of point clouds as tables of frames, and their decoded contents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: File types that are read, and types of PCD fields by letter and bytes.
IMAGE_TYPES, CLOUD_TYPES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff"), ("pcd", "ply")
PCD_TYPES = {("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4", ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4"}
POINT_SCHEMA = "path string, point_id long, x float, y float, z float, intensity float"


def name_time(path: Column) -> Column:
    """Seconds from a numeric file name without its ending; null for any other, nan and inf too."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    t = stem.try_cast("double")
    return F.when(~F.isnan(t) & (F.abs(t) != float("inf")), t)


def roster(files: DataFrame) -> DataFrame:
    """frame_index, path, t of the files (column path): in order of their times, or numbered by path if any name is not a number.

    ``renumbered`` says so. Files are counted and ordered as paths, not read; the rows of one folder are one stream.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    timed = files.select("path", folder.alias("folder"), name_time(F.col("path")).alias("t"))
    odd = F.count_if(F.col("t").isNull()).over(Window.partitionBy("folder")) > 0
    by_path = (F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1).cast("double")
    timed = timed.select("folder", "path", odd.alias("renumbered"), F.when(odd, by_path).otherwise(F.col("t")).alias("t"))
    at = F.row_number().over(Window.partitionBy("folder").orderBy("t", "path")) - 1
    return timed.select("folder", at.cast("long").alias("frame_index"), "path", "t", "renumbered")


def _files(spark: SparkSession, folder: str, types: tuple[str, ...], timestamp_source: str) -> DataFrame:
    if timestamp_source != "filename":
        raise NotImplementedError(f"times from {timestamp_source!r} are not read; use file names")
    glob = "*.{" + ",".join(x for t in types for x in (t, t.upper())) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def image_folder(spark: SparkSession, folder: str, timestamp_source: str = "filename") -> DataFrame:
    """folder, frame_index, path, t, renumbered of a folder's images; contents are read by ``decoded`` only. An empty folder is an error."""
    files = _files(spark, folder, IMAGE_TYPES, timestamp_source).select("path")
    if files.isEmpty():
        raise FileNotFoundError(f"no images in {folder!r} (looked for {IMAGE_TYPES})")
    return roster(files)


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, nchannels, data of a folder's images; an image that can't be read is an error."""
    image = spark.read.format("image").load(folder).select("image.*")
    broken = F.when(F.col("height") <= 0, F.raise_error(F.concat(F.lit("image can't be read: "), F.col("origin"))).cast("int")).otherwise(F.col("height"))
    return image.select(F.col("origin").alias("path"), broken.alias("height"), "width", F.col("nChannels").alias("nchannels"), "data")


def parse_pcd(content: bytes) -> np.ndarray:
    """x, y, z and intensity (NaN if absent) as 32-bit floats; ascii and binary data."""
    header: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in header:
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError("the header ends before DATA")
        words = content[at:end].decode("ascii").split()
        at = end + 1
        if words and not words[0].startswith("#"):
            header[words[0]] = words[1:]
    fields, kind, n = header["FIELDS"], header["DATA"][0], int(header["POINTS"][0])
    if missing := {"x", "y", "z"} - set(fields):
        raise ValueError(f"required fields are missing: {sorted(missing)}")
    wanted = ["x", "y", "z"] + (["intensity"] if "intensity" in fields else [])
    counts = [int(c) for c in header["COUNT"]]
    if kind == "ascii":
        rows = np.array([line.split() for line in content[at:].decode("ascii").splitlines() if line.strip()], np.float64)
        found = [rows[:, fields.index(w)] for w in wanted] if len(rows) else [np.empty(0)] * len(wanted)
    elif kind == "binary":
        types = [PCD_TYPES.get((t, int(s))) for t, s in zip(header["TYPE"], header["SIZE"])]
        if None in types:
            raise ValueError(f"field type not supported: {fields[types.index(None)]}")
        layout = np.dtype([(f, t) if c == 1 else (f, t, (c,)) for f, t, c in zip(fields, types, counts)])
        found = [np.frombuffer(content, layout, n, at)[w] for w in wanted]
    else:
        raise NotImplementedError(f"PCD data {kind!r}; ascii and binary are read")
    return _four(found)


def parse_ply(content: bytes) -> np.ndarray:
    """As parse_pcd, for the vertices of an ascii PLY file."""
    lines = content.decode("ascii", "replace").splitlines()
    if not lines or lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    end = [x.strip() for x in lines].index("end_header")
    form, n, names, inside = None, None, [], False
    for words in (x.split() for x in lines[1:end]):
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            n = int(words[2]) if inside else n
        elif words[:1] == ["property"] and inside:
            names.append(words[-1])
    if form != "ascii":
        raise NotImplementedError(f"PLY format {form!r}; ascii is read")
    if n is None or {"x", "y", "z"} - set(names):
        raise ValueError("no vertices with x, y, z")
    rows = np.array([x.split()[: len(names)] for x in lines[end + 1 : end + 1 + n]], np.float64).reshape(n, len(names))
    return _four([rows[:, names.index(c)] for c in ("x", "y", "z", "intensity") if c in names])


def _four(columns: list[np.ndarray]) -> np.ndarray:
    columns = [np.asarray(c, np.float32) for c in columns]
    return np.stack(columns if len(columns) == 4 else [*columns, np.full(len(columns[0]), np.nan, np.float32)])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            try:
                found = parse_ply(content) if path.lower().endswith(".ply") else parse_pcd(content)
            except (ValueError, KeyError) as e:
                raise ValueError(f"{path}: {e}") from e
            for a in range(0, found.shape[1], 100_000):
                part = found[:, a : a + 100_000]
                ids = pa.array(np.arange(a, a + part.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array([path] * part.shape[1], pa.string()), ids, *[pa.array(c, from_pandas=k == 3) for k, c in enumerate(part)]], ["path", "point_id", "x", "y", "z", "intensity"])


def cloud_folder(spark: SparkSession, folder: str, timestamp_source: str = "filename") -> DataFrame:
    """As image_folder, for PCD and PLY files."""
    files = _files(spark, folder, CLOUD_TYPES, timestamp_source).select("path")
    if files.isEmpty():
        raise FileNotFoundError(f"no point clouds in {folder!r} (looked for {CLOUD_TYPES})")
    return roster(files)


def cloud_points(spark: SparkSession, folder: str) -> DataFrame:
    """path, point_id (position in its file), x, y, z, intensity (null if the file has none); a broken file is an error that names it.

    A file is one row; its points leave in batches.
    """
    return _files(spark, folder, CLOUD_TYPES, "filename").select("path", "content").mapInArrow(_points, POINT_SCHEMA)


def spec_warnings(rigs: DataFrame, key: str = "rig") -> DataFrame:
    """key, warnings about what the sensor's specification lacks (columns as noise_floor.resolved_inputs takes)."""
    bare = F.col("h_res_deg").isNull() & F.col("v_res_deg").isNull() & ~F.coalesce((F.col("channels") > 0) & (F.col("vfov_deg") > 0), F.lit(False))
    return rigs.select(key, F.array_compact(F.array(F.when(bare, "no angular resolution in the sensor's specification"), F.when(F.col("range_acc_m").isNull(), "no range accuracy in the sensor's specification"))).alias("warnings"))


def previous_report(spark: SparkSession, path: str) -> DataFrame:
    """name, score, classification of an earlier report's overall result and categories, as report_diff takes them."""
    report = spark.read.json(path, multiLine=True)
    one = F.struct(F.lit("overall").alias("name"), F.col("quality_score.overall_score").cast("double").alias("score"), F.col("quality_score.overall_classification").alias("classification"))
    rest = F.transform("quality_score.categories", lambda c: F.struct(c["name"].alias("name"), c["score"].cast("double").alias("score"), c["classification"].alias("classification")))
    return report.select(F.explode(F.concat(F.array(one), rest)).alias("c")).select("c.*")
