"""Sections of a report with a declared schema: a run's row has the same columns and types whichever metrics were computed.

Each builder takes what the operators give, a row a run (column ``key``) or rows that are listed in the section, and returns
``key`` and the section as one struct. Fields that a table lacks are null, fields unknown to the schema an error, and numbers
that are not finite null, however deeply they lie. Lists hold blocks, categories, checks, axes and causes, which are few; a
recording's frames are listed only up to TRAJECTORY_FRAMES, and are a table of their own (``trajectory``) in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, NullType, StructType

from ..tables import written
from . import report

#: Frames of a recording that its report lists.
TRAJECTORY_FRAMES = 100_000

# Names and types of the report's fields.
_WARNINGS = "warnings: array<string>"
_STATS = "struct<label: string, mean_px: double, median_px: double, p95_px: double, std_px: double, valid_count: bigint, failure_count: bigint, total_count: bigint>"
_AXIS = "struct<score: double, classification: string, components: array<struct<name: string, value: double, detail: string>>>"
_PLANE = f"""struct<metric: string, classification: string, plane_found: boolean, inlier_ratio: double, num_inliers: bigint, num_boundary_points: bigint,
  mean_px: double, median_px: double, p95_px: double, floor_px: double, {_WARNINGS}>"""
_PERTURBATION = f"""struct<metric: string, classification: string, baseline_mean_px: double, is_local_minimum: boolean, improvement_margin_px: double,
  best_sample: struct<axis: string, direction: int, delta: double, mean_px: double>, num_samples: bigint, {_WARNINGS},
  axis_sensitivities: array<struct<axis: string, classification: string, small_delta_effect_px: double, large_delta_effect_px: double>>, timestamp_sensitivity_computed: boolean>"""
_DRIFT = f"""struct<metric: string, classification: string, slope_px_per_frame: double, r_value: double, p_value: double, is_statistically_significant: boolean,
  total_drift_px: double, floor_px: double, num_frames_used: bigint, {_WARNINGS}>"""
SCHEMAS = {
    "metadata": """struct<tool_version: string, generated_at: string, camera: struct<model: string, width: int, height: int, fx: double, fy: double, cx: double, cy: double, distortion_model: string>,
      lidar: struct<source_kind: string>, extrinsic: struct<parent: string, child: string, T_CL: array<array<double>>, baseline_m: double>,
      dataset: struct<num_synced_frames: bigint, sync_max_time_diff_ms: double, n_blocks_for_m3: int, min_frames_for_m4: int>>""",
    "input_validation": "struct<status: string, checks: array<struct<name: string, status: string, detail: string, value: double>>, reasons: array<string>>",
    "synchronization": """struct<num_camera_frames: bigint, num_lidar_frames: bigint, num_matched: bigint, num_camera_dropped: bigint, num_lidar_dropped: bigint, mean_time_diff_ms: double,
      max_time_diff_ms: double, estimated_offset_ms: double, offset_std_ms: double, drop_ratio: double, classification: string>""",
    "motion_deskew": "struct<num_points: bigint, scan_period_s: double, reference_time_s: double, mean_correction_m: double, max_correction_m: double, p95_correction_m: double>",
    "dynamic_filter": """struct<overall_mean_px: double, overall_classification: string, overall_num_edge_points: bigint, static_only_mean_px: double, static_only_classification: string,
      static_only_num_edge_points: bigint, dynamic_contamination_ratio: double, num_dynamic_points_removed: bigint>""",
    "m0_sanity_gate": f"""struct<passed: boolean, num_input_points: bigint, num_valid_points: bigint, fov_coverage_ratio: double, occlusion_violation_ratio: double,
      checks: array<struct<name: string, passed: boolean, detail: string, value: double>>, {_WARNINGS}>""",
    "m2_edge_alignment": f"""struct<metric: string, name: string, classification: string, mean_px: double, median_px: double, p95_px: double, max_px: double, num_edge_points: bigint,
      num_projected_points: bigint, representative_depth_m: double, floor_px: double, {_WARNINGS}, num_matched: bigint, num_unmatched: bigint, match_rate: double,
      mean_normalized_error: double, median_normalized_error: double, p95_normalized_error: double>""",
    "m2_spatial_analysis": f"struct<depth_bins: map<string, {_STATS}>, horizontal_regions: map<string, {_STATS}>, vertical_regions: map<string, {_STATS}>, depth_trend: string>",
    "m3_holdout_consistency": f"""struct<metric: string, name: string, classification: string, num_valid_blocks: bigint, mean_across_blocks_px: double, std_across_blocks_px: double, range_px: double,
      floor_px: double, blocks: array<struct<block_index: int, num_frames_total: bigint, num_frames_valid: bigint, mean_px: double, median_px: double, p95_px: double, classification: string,
      representative_depth_m: double, edge_density: double, num_points_avg: double, fov_coverage: double, dynamic_ratio: double>>,
      instability_diagnosis: struct<worst_block_index: int, worst_block_mean_px: double, candidates: array<struct<metric: string, worst_value: double, others_median: double, relative_diff: double, explanation: string>>>, {_WARNINGS}>""",
    "m4_multiframe_consistency": f"""struct<metric: string, name: string, classification: string, num_frames_total: bigint, num_valid_frames: bigint, num_failed_frames: bigint, num_outlier_frames: bigint,
      outlier_frame_indices: array<bigint>, mean_across_frames_px: double, std_across_frames_px: double, median_across_frames_px: double, p95_across_frames_px: double, max_across_frames_px: double,
      floor_px: double, outlier_method: string, mad_px: double, iqr_px: double, q1_px: double, q3_px: double, valid_ratio: double, failure_ratio: double, outlier_ratio: double,
      frame_trajectory: array<struct<frame_index: bigint, timestamp: double, mean_px: double, classification: string, is_outlier: boolean, robust_z_score: double>>, {_WARNINGS}>""",
    "quality_score": f"""struct<overall_score: double, overall_classification: string, num_valid_categories: bigint, weights_used: map<string, double>,
      categories: array<struct<name: string, metric: string, valid: boolean, score: double, classification: string, raw_value_px: double, floor_px: double, summary: map<string, double>>>, {_WARNINGS}>""",
    "advanced": f"struct<plane_consistency: {_PLANE}, perturbation: {_PERTURBATION}, temporal_drift: {_DRIFT}>",
    "root_cause_diagnosis": "struct<candidates: array<struct<cause: string, label: string, confidence: string, evidence: array<string>>>, confirmations: array<struct<label: string, detail: string>>>",
    "quality_confidence_coverage": f"struct<quality: struct<score: double, classification: string>, confidence: {_AXIS}, coverage: {_AXIS}>",
    "warnings": "array<string>",
}
#: The metric of a category of the quality score.
METRICS = {"geometry": "M2", "generalization": "M3", "stability": "M4"}


def schema(name: str) -> DataType:
    return DataType.fromDDL(SCHEMAS[name])


def shaped(value: Column, have: DataType, want: DataType) -> Column:
    """``value`` as ``want``: fields by name, absent ones null (warnings: an empty list), numbers that are not finite null, at any depth."""
    if isinstance(have, NullType):
        return F.lit(None).cast(want)
    if isinstance(want, StructType):
        own = {f.name: f.dataType for f in have.fields}
        if unknown := sorted(set(own) - set(want.names)):
            raise ValueError(f"fields that the report does not have: {unknown}")
        absent = lambda f: F.array().cast(f.dataType) if f.name == "warnings" else F.lit(None).cast(f.dataType)
        body = F.struct(*[(shaped(value[f.name], own[f.name], f.dataType) if f.name in own else absent(f)).alias(f.name) for f in want.fields])
        return F.when(value.isNotNull(), body)
    if isinstance(want, ArrayType):
        return F.transform(value, lambda x: shaped(x, have.elementType, want.elementType))
    if isinstance(want, MapType):
        return F.transform_values(value, lambda k, v: shaped(v, have.valueType, want.valueType))
    if isinstance(want, DoubleType) and isinstance(have, (DoubleType, FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value).cast(want)
    return value.cast(want)


def _typed(rows: DataFrame, name: str, want: DataType, key: str, parts: dict[str, DataFrame], figures: dict[str, Column]) -> DataFrame:
    rows = rows.select(key, F.struct(*[c.alias(f) for f, c in figures.items()]).alias("_own"))
    for part in parts.values():
        rows = rows.join(part, key, "left")
    one = rows.select(key, F.struct(*[F.col("_own")[f].alias(f) for f in figures], *parts).alias(name))
    return one.select(key, shaped(F.col(name), one.schema[name].dataType, want).alias(name))


def section(rows: DataFrame, name: str, key: str = "run", parts: dict[str, DataFrame] | None = None, /, **figures: Column) -> DataFrame:
    """key and the section ``name`` from a table with one row a run: ``figures`` are its fields, ``parts`` tables of key and a field of their name."""
    return _typed(rows, name, schema(name), key, parts or {}, figures)


def _listed(rows: DataFrame, field: str, order: list[str], key: str, /, **figures: Column) -> DataFrame:
    """key and an array of structs, in the order of columns of ``rows``; for tables with few rows a run."""
    item = F.struct(F.struct(*order).alias("o"), F.struct(*[c.alias(f) for f, c in figures.items()]).alias("s"))
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"]).alias(field))


def _cols(**names: str) -> dict[str, Column]:
    return {field: F.col(c) for field, c in names.items()}


def _same(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def validation(status: DataFrame, checks: DataFrame, key: str = "run") -> DataFrame:
    """``status``: key, status, reasons; ``checks``: key, name, status, value and, if there, detail."""
    detail = F.col("detail") if "detail" in checks.columns else F.lit(None)
    return section(status, "input_validation", key, {"checks": _listed(checks, "checks", ["name"], key, **_same("name", "status", "value"), detail=detail)}, **_same("status", "reasons"))


def synchronization(summary: DataFrame, key: str = "run") -> DataFrame:
    """``summary``: what ``sync.sync_summary`` gives, with its classification."""
    ms = lambda c: F.col(c) * 1000
    return section(
        summary, "synchronization", key, **_cols(num_camera_frames="camera_frames", num_lidar_frames="lidar_frames", num_matched="matched", num_camera_dropped="camera_dropped", num_lidar_dropped="lidar_dropped"),
        mean_time_diff_ms=ms("mean_abs_s"), max_time_diff_ms=ms("max_abs_s"), estimated_offset_ms=ms("offset_s"), offset_std_ms=ms("std_s"), **_same("drop_ratio", "classification"),
    )


def deskew(summary: DataFrame, scan_period_s: float, reference_s: float = 0.0, key: str = "run") -> DataFrame:
    """``summary``: n, mean_m, max_m, p95_m of the scan that stands for a run."""
    return section(summary, "motion_deskew", key, **_cols(num_points="n", mean_correction_m="mean_m", max_correction_m="max_m", p95_correction_m="p95_m"), scan_period_s=F.lit(scan_period_s), reference_time_s=F.lit(reference_s))


def dynamic_filter(comparison: DataFrame, key: str = "run") -> DataFrame:
    """``comparison``: what ``frame_metrics.static_against_all`` gives."""
    return section(
        comparison, "dynamic_filter", key, **_cols(overall_mean_px="overall_mean_px", overall_classification="overall_class", overall_num_edge_points="overall_edge_points", static_only_mean_px="static_mean_px",
        static_only_classification="static_class", static_only_num_edge_points="static_edge_points", dynamic_contamination_ratio="contamination", num_dynamic_points_removed="removed"),
    )


def sanity_gate(checks: DataFrame, counts: DataFrame | None = None, key: str = "run") -> DataFrame:
    """``checks``: key, name, passed, value of the gate; ``counts``: key, num_input_points, num_valid_points. A check that failed is a warning."""
    figure = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.concat(F.lit("check failed: "), F.col("name")))))
    one = checks.groupBy(key).agg(F.bool_and("passed").alias("passed"), figure("fov_coverage_sufficient").alias("fov"), figure("occlusion_plausible").alias("hidden"), failed.alias("warnings"))
    detail = F.col("detail") if "detail" in checks.columns else F.lit(None)
    fields = {**_same("passed", "warnings"), **_cols(fov_coverage_ratio="fov", occlusion_violation_ratio="hidden")}
    if counts is not None:
        one, fields = one.join(counts, key, "left"), fields | _same("num_input_points", "num_valid_points")
    return section(one, "m0_sanity_gate", key, {"checks": _listed(checks, "checks", ["name"], key, **_same("name", "passed", "value"), detail=detail)}, **fields)


def edge_alignment(metrics: DataFrame, key: str = "run") -> DataFrame:
    """``metrics``: what ``frame_metrics.frame_metrics`` gives for the frame that stands for a run. Why it failed is a warning."""
    return section(
        metrics, "m2_edge_alignment", key, metric=F.lit("M2"), name=F.lit("Edge Alignment (Projection Consistency)"),
        **_same("classification", "mean_px", "median_px", "p95_px", "max_px", "num_edge_points", "representative_depth_m", "floor_px", "num_matched", "match_rate"),
        **_cols(num_projected_points="num_projected", mean_normalized_error="mean_normalized", median_normalized_error="median_normalized", p95_normalized_error="p95_normalized"),
        num_unmatched=F.when(F.col("match_rate").isNotNull(), F.col("num_edge_points") - F.col("num_matched")), warnings=F.array_compact(F.array("fail_reason")),
    )


def spatial(depth: DataFrame, horizontal: DataFrame, vertical: DataFrame, trend: DataFrame, key: str = "run") -> DataFrame:
    """The first three: key, label and what ``spatial.error_stats`` gives; ``trend``: key, trend."""

    def by_label(rows: DataFrame, field: str) -> DataFrame:
        body = F.struct("label", "mean_px", "median_px", "p95_px", "std_px", F.col("valid").alias("valid_count"), F.col("failed").alias("failure_count"), (F.col("valid") + F.col("failed")).alias("total_count"))
        return rows.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", body.alias("s"))))).alias(field))

    parts = {"depth_bins": by_label(depth, "depth_bins"), "horizontal_regions": by_label(horizontal, "horizontal_regions"), "vertical_regions": by_label(vertical, "vertical_regions")}
    return section(trend, "m2_spatial_analysis", key, parts, depth_trend=F.col("trend"))


def holdout(overall: DataFrame, blocks: DataFrame, diagnosis: DataFrame | None = None, key: str = "run") -> DataFrame:
    """What ``stability.holdout_overall``, ``pooled_blocks`` and ``instability`` give, each with the key. Excluded and failed blocks are warnings."""
    own = _listed(
        blocks, "blocks", ["block"], key, **_cols(block_index="block", num_frames_total="frames", num_frames_valid="valid_frames", representative_depth_m="depth_m", num_points_avg="points_avg"),
        **_same("mean_px", "median_px", "p95_px", "classification", "edge_density", "fov_coverage", "dynamic_ratio"),
    )
    left_out = F.when(F.col("classification").isin("EXCLUDED", "FAIL"), F.format_string("block %d: %s, %d of %d frames valid", "block", "classification", "valid_frames", "frames"))
    parts = {"blocks": own, "warnings": blocks.groupBy(key).agg(F.array_sort(F.collect_list(left_out)).alias("warnings"))}
    if diagnosis is not None:
        causes = _listed(diagnosis, "candidates", ["rank"], key, **_same("metric", "worst_value", "others_median", "relative_diff", "explanation"))
        worst = diagnosis.groupBy(key).agg(F.min("worst_block").alias("block")).join(blocks.select(key, "block", "mean_px"), [key, "block"])
        body = F.struct(F.col("block").alias("worst_block_index"), F.col("mean_px").alias("worst_block_mean_px"), "candidates")
        parts["instability_diagnosis"] = worst.join(causes, key).select(key, body.alias("instability_diagnosis"))
    return section(
        overall, "m3_holdout_consistency", key, parts, metric=F.lit("M3"), name=F.lit("Hold-out Consistency (Generalization)"), **_same("classification", "range_px", "floor_px"),
        **_cols(num_valid_blocks="valid_blocks", mean_across_blocks_px="mean_px", std_across_blocks_px="std_px"),
    )


def trajectory(frames: DataFrame, key: str = "run") -> DataFrame:
    """key, frame_index, timestamp, mean_px, classification, is_outlier, robust_z_score: a row a frame, for a table beside the report. ``frames``: all frames, valid ones as ``stability.outliers`` marks them."""
    at = F.col("timestamp") if "timestamp" in frames.columns else F.lit(None).cast("double")
    return frames.select(key, "frame_index", at.alias("timestamp"), "mean_px", "classification", F.coalesce("is_outlier", F.lit(False)).alias("is_outlier"), F.col("z").alias("robust_z_score"))


def multiframe(summary: DataFrame, frames: DataFrame, rule: str = "hampel", most: int = TRAJECTORY_FRAMES, key: str = "run") -> DataFrame:
    """What ``stability.multiframe`` gives, with the key, and ``frames`` as ``trajectory`` takes them.

    A run of more than ``most`` frames has null for its trajectory and its outliers' indices, and a warning that names
    the table: a list of them would be one row without bound.
    """
    own = trajectory(frames, key)
    short = written(own.groupBy(key).agg(F.count("*").alias("n")).select(key, (F.col("n") <= most).alias("short")))
    few = own.join(F.broadcast(short.where("short").select(key)), key, "left_semi")  # a row a run
    path = _listed(few, "frame_trajectory", ["frame_index"], key, **_same("frame_index", "timestamp", "mean_px", "classification", "is_outlier", "robust_z_score"))
    marked = few.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("is_outlier"), F.col("frame_index")))).alias("outlier_frame_indices"))
    said = short.select(key, F.when(F.col("short"), F.array().cast("array<string>")).otherwise(F.array(F.lit(f"more than {most} frames: they are in the table of the trajectory"))).alias("warnings"))
    return section(
        summary, "m4_multiframe_consistency", key, {"frame_trajectory": path, "outlier_frame_indices": marked, "warnings": said}, metric=F.lit("M4"), name=F.lit("Multi-frame Consistency (Stability)"),
        outlier_method=F.lit(rule), **_same("classification", "floor_px", "valid_ratio", "failure_ratio", "outlier_ratio"),
        **_cols(num_frames_total="frames", num_valid_frames="valid_frames", num_failed_frames="failed_frames", num_outlier_frames="outlier_frames", mean_across_frames_px="mean_px", std_across_frames_px="std_px",
        median_across_frames_px="median", p95_across_frames_px="p95_px", max_across_frames_px="max_px", mad_px="mad", iqr_px="iqr", q1_px="q1", q3_px="q3"),
    )


def quality(scores: DataFrame, categories: DataFrame, weights: dict[str, float] | None = None, key: str = "run") -> DataFrame:
    """What ``decisions.quality`` and ``category_scores`` give; ``categories`` may hold value_px, floor_px and summary too."""
    metric = F.element_at(F.create_map(*[F.lit(x) for item in METRICS.items() for x in item]), F.col("name"))
    order = F.array_position(F.array(*map(F.lit, METRICS)), F.col("name"))
    extra = {field: F.col(c) for field, c in (("raw_value_px", "value_px"), ("floor_px", "floor_px"), ("summary", "summary")) if c in categories.columns}
    own = _listed(categories.withColumn("_order", order), "categories", ["_order"], key, metric=metric, **_same("name", "valid", "score", "classification"), **extra)
    used = weights or dict.fromkeys(METRICS, 1 / len(METRICS))
    shares = F.create_map(*[F.lit(x) for k, w in used.items() for x in (k, float(w))])
    return section(scores, "quality_score", key, {"categories": own}, **_cols(overall_score="score", overall_classification="classification", num_valid_categories="valid_categories"), weights_used=shares)


def plane(metric: DataFrame, key: str = "run") -> DataFrame:
    """``metric``: what ``planes.plane_metric`` gives for the scan that stands for a run."""
    want = schema("advanced")["plane_consistency"].dataType
    fields = {**_same("classification", "plane_found", "inlier_ratio", "mean_px", "median_px", "p95_px", "floor_px"), **_cols(num_inliers="inliers", num_boundary_points="outline_points")}
    return _typed(metric, "plane_consistency", want, key, {}, {"metric": F.lit("Plane Consistency"), **fields})


def perturbation(minimum: DataFrame, baseline: DataFrame, samples: DataFrame, axes: DataFrame, key: str = "run") -> DataFrame:
    """What ``decisions.local_minimum`` gives, its baseline (key, baseline_px), the samples and ``sensitivity.axis_sensitivity`` with the key. Failed samples are a warning."""
    want = schema("advanced")["perturbation"].dataType
    each = _listed(axes, "axis_sensitivities", ["axis"], key, **_same("axis", "classification"), **_cols(small_delta_effect_px="small_px", large_delta_effect_px="large_px"))
    counted = samples.groupBy(key).agg(F.count("*").alias("_samples"), F.coalesce(F.bool_or(F.col("axis") == "timestamp"), F.lit(False)).alias("_timed"))
    best = F.when(F.col("axis").isNotNull(), F.struct("axis", "direction", "delta", F.col("best_px").alias("mean_px")))
    lost = F.when(F.col("invalid") > 0, F.array(F.format_string("%d samples failed", "invalid"))).otherwise(F.array().cast("array<string>"))
    fields = {
        "metric": F.lit("Perturbation Sensitivity"), "classification": F.col("classification"), "baseline_mean_px": F.col("baseline_px"), "is_local_minimum": F.col("classification") == "AT_LOCAL_MINIMUM",
        "improvement_margin_px": F.col("margin_px"), "best_sample": best, "num_samples": F.coalesce("_samples", F.lit(0)), "warnings": lost, "timestamp_sensitivity_computed": F.coalesce("_timed", F.lit(False)),
    }
    return _typed(minimum.join(baseline.select(key, "baseline_px"), key, "left").join(counted, key, "left"), "perturbation", want, key, {"axis_sensitivities": each}, fields)


def drift(fit: DataFrame, key: str = "run") -> DataFrame:
    """What ``stability.drift`` gives, with the key."""
    want = schema("advanced")["temporal_drift"].dataType
    fields = {**_same("classification", "p_value", "floor_px"), **_cols(slope_px_per_frame="slope", r_value="r", is_statistically_significant="significant", total_drift_px="drift_px", num_frames_used="n")}
    return _typed(fit, "temporal_drift", want, key, {}, {"metric": F.lit("Temporal Drift"), **fields})


def advanced(*metrics: DataFrame, key: str = "run") -> DataFrame:
    """The section of what ``plane``, ``perturbation`` and ``drift`` gave, any of them."""
    if not metrics:
        raise ValueError("no metric for the section")
    rows = metrics[0]
    for more in metrics[1:]:
        rows = rows.join(more, key, "full_outer")
    return section(rows, "advanced", key, **_same(*[c for c in rows.columns if c != key]))


def root_causes(causes: DataFrame, confirmed: DataFrame, key: str = "run") -> DataFrame:
    """What ``decisions.root_causes`` and ``confirmations`` give."""
    found = _listed(causes, "candidates", ["rank"], key, **_same("cause", "label", "confidence", "evidence"))
    fine = _listed(confirmed, "confirmations", ["label"], key, **_same("label", "detail"))
    every = found.select(key).union(fine.select(key)).distinct()
    rows = every.join(found, key, "left").join(fine, key, "left")
    return section(rows, "root_cause_diagnosis", key, candidates=F.coalesce("candidates", F.array()), confirmations=F.coalesce("confirmations", F.array()))


def quality_confidence_coverage(bundled: DataFrame, components: DataFrame | None = None, key: str = "run") -> DataFrame:
    """What ``decisions.bundle`` gives; ``components``: key, axis (confidence or coverage), name, value and, if there, detail."""
    axis = lambda name: F.struct(F.col(f"{name}_score").alias("score"), F.col(f"{name}_class").alias("classification"), *([F.col(f"_{name}").alias("components")] if components is not None else []))
    if components is not None:
        detail = F.col("detail") if "detail" in components.columns else F.lit(None).cast("string")
        for name in ("confidence", "coverage"):
            bundled = bundled.join(_listed(components.where(F.col("axis") == name), f"_{name}", ["name"], key, **_same("name", "value"), detail=detail), key, "left")
    score = F.struct(F.col("quality_score").alias("score"), F.col("quality_class").alias("classification"))
    return section(bundled, "quality_confidence_coverage", key, quality=score, confidence=axis("confidence"), coverage=axis("coverage"))


def whole_report(runs: DataFrame, sections: dict[str, DataFrame], key: str = "run") -> DataFrame:
    """key and a column for each section of a report, of its declared type also where nothing was computed. ``sections``: name to (key, name), as the builders give them; other types are an error."""
    if unknown := set(sections) - set(report.SECTIONS):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    out = runs.select(key).distinct()
    for name, rows in sections.items():
        if rows.schema[name].dataType.simpleString() != schema(name).simpleString():
            raise ValueError(f"{name} is not of its declared type")
        out = out.join(rows.select(key, name), key, "left")
    blank = lambda name: F.array().cast(schema(name)) if name == "warnings" else F.lit(None).cast(schema(name))
    return out.select(key, *[(F.coalesce(name, blank(name)) if name in sections else blank(name)).alias(name) for name in report.SECTIONS])
