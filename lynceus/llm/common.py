"""What several text operators share: text normalisation, written intermediate
tables, joins that stand hot keys, and distributed connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Pure ASCII texts take the faster ``lower``."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors must share. Only a local session, as in
    tests, gets one of its own where it is unset; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lynceus-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    It cuts lineage, and a lost executor costs no more than a reread. Each call
    writes to a folder of its own, so repeated calls never meet.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame | None) -> None:
    """Deletes the folder of a table that ``materialize`` wrote and nothing reads any more."""
    files = df.inputFiles() if df is not None else []
    if files:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(conf).delete(folder, True)


#: Bytes of texts in an Arrow batch, where the session sets no bound itself, and in a slice of one.
BATCH_BYTES = SLICE_BYTES = 4 << 20
#: Bytes of a row group of an intermediate table, which its writer holds in memory.
BLOCK_BYTES = 32 << 20


def row_slices(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows and some 4 MB of text, so that few texts are Python objects at a time. A longer text is a slice of its own."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        a, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > a and (i - a >= rows or total + n > SLICE_BYTES):
                yield batch.slice(a, i - a)
                a, total = i, 0
            total += n
        if batch.num_rows > a:
            yield batch.slice(a)
    give_back_memory()


def text_values(column) -> Iterator:  # noqa: ANN001
    """A column's texts as Python strings, one at a time."""
    return (x.as_py() for x in column)


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python in Arrow batches of at most 4 MB and are read 1,024 rows at a time, unless the session says otherwise:
    long texts would fill batches of 64 MB in the JVM's direct memory and in Python at once, and large arrays in its heap."""
    for name, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", 1024)):
        if name not in spark.conf.getAll:
            spark.conf.set(name, str(value))


def give_back_memory() -> None:
    """At a task's end: a Python worker waits for its next task without the memory of the last one."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df``, a written table, has at most ``rows`` rows; each task counts its own part."""
    return df.count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its row count is within the bound, else as it is,
    which leaves a shuffled join that AQE can split. It should be a written table, or cheap to count."""
    return F.broadcast(df) if small_enough(df, rows) else df


#: A node with at least 1/HUB_SHARE of all edges is a hub. An edge counts for its two ends, so there can be twice as many.
HUB_SHARE = 1000


def _join_lowest(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """``edges`` of n with the minimum m of their node a; the few hubs' minima are broadcast, so that no task gets a hub's edges."""
    hub = F.col("degree") * HUB_SHARE >= n
    hubs = low.where(hub).select("a", "m")
    rest = edges.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(low.where(~hub).select("a", "m"), "a")
    return edges.join(F.broadcast(hubs), "a").unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for each node of an undirected graph.

    ``edges``: columns a, b of one orderable type. Returns node, component.
    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    each step is one map-side combined minimum and one join, on a written table,
    until a round changes nothing. The node sets of hubs are never gathered, and
    their edges stay where they are.
    Empty input gives an empty result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    for _ in range(max_rounds):
        n = e.count()
        # Large star: every larger neighbour of a node points to the node's minimum.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select("a", F.least("a", "m").alias("m"), "degree")
        large = _join_lowest(both.where("b > a"), low, n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "edges")
        # Small star: a node and its smaller neighbours point to their minimum.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        small = (
            _join_lowest(large, low, n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct()
        )
        new = materialize(small, "edges")
        # Done once every node points at one minimum and no minimum points on.
        lone = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        onward = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        e = new
        if lone.isEmpty() and onward.isEmpty():
            break
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
