"""The report of a run as one nested row, strict JSON, and tables of its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Sections of a report, in order.
SECTIONS = (
    "metadata", "input_validation", "synchronization", "motion_deskew", "dynamic_filter", "m0_sanity_gate", "m2_edge_alignment", "m2_spatial_analysis", "m3_holdout_consistency",
    "m4_multiframe_consistency", "quality_score", "advanced", "root_cause_diagnosis", "quality_confidence_coverage", "warnings",
)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers of the plain columns become null."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    clean = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return df.withColumns({c: clean(c) for c in floating})


def section(df: DataFrame, name: str, key: str = "run", **constants: str) -> DataFrame:
    """key and a struct ``name`` of a table with one row a run."""
    body = [F.lit(v).alias(k) for k, v in constants.items()] + [F.col(c) for c in df.columns if c != key]
    return finite(df).select(key, F.struct(*body).alias(name))


def listed(df: DataFrame, name: str, order: list[str], key: str = "run") -> DataFrame:
    """key and an array ``name`` of the other columns' structs, in the order of ``order``; for tables with few rows a run."""
    rest = [c for c in df.columns if c != key]
    item = F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("s"))
    return finite(df).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"]).alias(name))


def report(runs: DataFrame, sections: dict[str, DataFrame], key: str = "run") -> DataFrame:
    """A row a run with a column for each of SECTIONS, null where a section was not computed. ``sections``: name to (key, name)."""
    if unknown := set(sections) - set(SECTIONS):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    out = runs.select(key)
    for name, df in sections.items():
        out = out.join(df, key, "left")
    absent = F.lit(None).cast("string")
    return out.select(key, *[F.col(s) if s in sections else absent.alias(s) for s in SECTIONS])


def as_json(reports: DataFrame, key: str = "run") -> DataFrame:
    """key, json: strict JSON, absent sections and figures as null. Non-finite numbers were made null in the sections."""
    body: Column = F.struct(*[c for c in reports.columns if c != key])
    return reports.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def write_json(reports: DataFrame, path: str, key: str = "run") -> None:
    """A JSON text a run, one a line, in a folder; the run is not repeated in it."""
    as_json(reports, key).select("json").write.mode("errorifexists").text(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
