"""Exact percentiles of groups of any size and any spread, by counting ever finer cells.

``percentile`` keeps every distinct value of a group in one task. Here a value is placed by a whole number of 64 bits that
grows with it (sign, exponent, mantissa), so that an outlier of 1e9 takes none of the cells of the rest. Values are counted
by their leading bits, for all groups together; the cells that hold a wanted rank are cut by the next bits, as often as
it takes until each is small, and only what lies in those is sorted. No task holds more than a small cell's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import broadcast_within, written

#: Distinct values that one task sorts; bits of a cut; cells that are broadcast.
CELL_ROWS = 65_536
CUT_BITS = 12
BROADCAST_CELLS = 1_000_000


def ordered_bits(x: Column) -> Column:
    """A long that grows with the double: of two values the larger has the larger one, equal ones (0 and -0 too) the same; NaN is the largest.

    Scaling by powers of two is exact, so the mantissa's 52 bits are those of the double.
    """
    size = F.abs(x)
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022))
    # The logarithm can be rounded to the next whole number on either side.
    exponent = guess + F.when(size >= F.pow(F.lit(2.0), guess + 1), 1).when(size < F.pow(F.lit(2.0), guess), -1).otherwise(0)
    exponent = F.least(exponent, F.lit(1023))
    mantissa = ((size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)).cast("long")
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + mantissa
    small = (size / F.lit(5e-324)).cast("long")
    bits = F.when(F.isnan(x), F.lit((2047 << 52) + 1)).when(size == float("inf"), F.lit(2047 << 52)).when(size < 2.0**-1022, small).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def _ranks(shares: dict[str, float]) -> dict[str, Column]:
    return {name: share * (F.col("n") - 1) for name, share in shares.items()}


def _wanted(cells: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The cells (before, m values, n of the group) that hold a rank or its neighbour."""
    holds = [(F.floor(r) < F.col("before") + F.col("m")) & (F.ceil(r) >= F.col("before")) for r in _ranks(shares).values()]
    return cells.where(F.exists(F.array(*holds), lambda h: h))


def exact_percentiles(values: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key and one column for each of ``shares`` (name to 0..1), interpolated between neighbours as usual; nulls don't count.

    Groups of up to 65,536 values are sorted as they are. If there is a larger one, the values are written once and each
    cut of 12 bits reads those that lie in the cells left over: two cuts for most measurements, six at most. Values equal
    in all 64 bits are one row with a count.
    """
    v = values.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x")).where("x is not null")
    sizes = v.groupBy("k").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0]
    whole = largest is None or largest <= CELL_ROWS
    if whole:
        inside = v.groupBy("k", "x").agg(F.count("*").alias("c")).withColumns({"cell": F.lit(0), "before": F.lit(0), "n": F.sum("c").over(Window.partitionBy("k"))})
    else:
        v = written(v.withColumn("bits", ordered_bits(F.col("x"))))
        cells = written(sizes.select("k", F.lit(None).cast("long").alias("cell"), F.lit(0).cast("long").alias("before"), F.col("n").alias("m"), "n"))
        shift = 64
        while shift and cells.agg(F.max("m")).first()[0] > CELL_ROWS:
            parent, shift = _cell(shift), max(shift - CUT_BITS, 0)
            held = v.withColumn("cell", parent).join(_spread(cells).select(F.col("k").alias("of"), F.col("cell").alias("parent"), "before", "n"), F.col("k").eqNullSafe(F.col("of")) & F.col("cell").eqNullSafe(F.col("parent")))
            counts = held.groupBy("k", "parent", "before", "n", _cell(shift).alias("cell")).agg(F.count("*").alias("m"))
            run = F.sum("m").over(Window.partitionBy("k", "parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))  # 4,096 rows a cell at most
            counts = counts.withColumn("before", F.col("before") + F.coalesce(run, F.lit(0)))
            cells = written(_wanted(counts, shares).select("k", "cell", "before", "m", "n"))
        held = v.withColumn("cell", _cell(shift)).join(_spread(cells).select(F.col("k").alias("of"), F.col("cell").alias("own"), "before", "n"), F.col("k").eqNullSafe(F.col("of")) & F.col("cell").eqNullSafe(F.col("own")))
        inside = held.groupBy("k", "cell", "x", "before", "n").agg(F.count("*").alias("c"))
    run = F.sum("c").over(Window.partitionBy("k", "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    ranked = inside.withColumn("first", F.col("before") + F.coalesce(run, F.lit(0))).withColumn("last", F.col("first") + F.col("c") - 1)
    pick = lambda at: F.max(F.when((F.col("first") <= at) & (at <= F.col("last")), F.col("x")))
    # Between equal neighbours there is nothing to interpolate, which also keeps infinities.
    out = {}
    for name, r in _ranks(shares).items():
        low, high = pick(F.floor(r)), pick(F.ceil(r))
        out[name] = F.when(low == high, low).otherwise(low + (high - low) * F.max(r - F.floor(r)))
    return ranked.groupBy("k").agg(*[c.alias(name) for name, c in out.items()]).withColumnRenamed("k", key)


def _cell(shift: int) -> Column:
    """The bits above ``shift``; above all 64 there are none."""
    return F.shiftright("bits", shift) if shift < 64 else F.lit(None).cast("long")


def _spread(cells: DataFrame) -> DataFrame:
    return broadcast_within(cells, BROADCAST_CELLS)
