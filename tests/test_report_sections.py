"""Typed report sections, the bundle of scores, and picks of frames in long streams."""

import json

import pytest
from pyspark.sql import functions as F

from lynceus.operators import decisions, stability, views
from lynceus.plans import report, sections

NAN, INF = float("nan"), float("inf")
FRAME = {"num_projected": 9, "num_edge_points": 5, "num_matched": 3, "representative_depth_m": 4.0, "floor_px": INF, "mean_px": NAN, "median_px": 1.0, "p95_px": 2.0, "max_px": 3.0, "mean_normalized": 1.0,
         "median_normalized": 1.0, "p95_normalized": 1.0, "match_rate": 0.6, "classification": "GOOD", "fail_reason": None}


def of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def every_section(spark):
    """One table for each builder, of run 1."""
    kinds = {int: "bigint", float: "double", str: "string", type(None): "string"}
    m2 = of(spark, [(1, *FRAME.values())], "run int, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in FRAME.items()))
    blocks = of(spark, [(1, b, 40, 40 - b, 1.0 + b, 1.0, 2.0, 3.0, 4.0, 5.0, NAN, None, k) for b, k in ((2, "GOOD"), (1, "FAIL"))],
                "run int, block int, frames long, valid_frames long, mean_px double, median_px double, p95_px double, depth_m double, edge_density double, points_avg double, fov_coverage double, dynamic_ratio double, classification string")
    overall = of(spark, [(1, 1, 2.0, NAN, None, 0.5, "FAIL")], "run int, valid_blocks long, mean_px double, std_px double, range_px double, floor_px double, classification string")
    diagnosis = of(spark, [(1, 1, 2, "depth_m", 3.0, 1.0, 2.0, "Long-range scenes")], "run int, rank int, worst_block int, metric string, worst_value double, others_median double, relative_diff double, explanation string")
    frames = of(spark, [(1, i, 1.0 if i < 39 else 9.0, 0.5, "GOOD") for i in range(40)], "run int, frame_index long, mean_px double, floor_px double, classification string")
    m4 = stability.multiframe(frames.drop("run")).select(F.lit(1).alias("run"), "*")
    stats = of(spark, [(1, x, 1.0, NAN, 2.0, 0.0, 4, 1) for x in ("0-10m", "10-20m")], "run int, label string, mean_px double, median_px double, p95_px double, std_px double, valid long, failed long")
    cats = of(spark, [(1, n, True, 90.0, "GOOD") for n in ("stability", "geometry", "generalization")], "run int, name string, valid boolean, score double, classification string")
    gate = of(spark, [(1, "fov_coverage_sufficient", False, 0.1), (1, "occlusion_plausible", True, 0.2)], "run int, name string, passed boolean, value double")
    least = of(spark, [(1, "tx", 1, 0.5, 2.0, 0.5, 1, "NOT_AT_LOCAL_MINIMUM")], "run int, axis string, direction int, delta double, best_px double, margin_px double, invalid long, classification string")
    scores = of(spark, [(1, 62.5, "WARNING", None, "FAIL", 81.0, "GOOD")], "run int, quality_score double, quality_class string, confidence_score double, confidence_class string, coverage_score double, coverage_class string")
    parts = of(spark, [(1, "confidence", "b", 0.5), (1, "confidence", "a", INF)], "run int, axis string, name string, value double")
    return {
        "metadata": sections.section(of(spark, [(1, 320)], "run int, width int"), "metadata", camera=F.struct("width", F.lit(NAN).alias("fx")), extrinsic=F.struct(F.array(F.array(F.lit(1.0), F.lit(NAN))).alias("T_CL"))),
        "input_validation": sections.validation(of(spark, [(1, "INPUT_WARNING", 2, ["b"])], "run int, status string, checks long, reasons array<string>"), of(spark, [(1, "b", "WARNING", NAN), (1, "a", "VALID", 1.0)], "run int, name string, status string, value double")),
        "synchronization": sections.synchronization(of(spark, [(1, 9, 8, 7, 2, 1, 0.01, 0.02, -0.005, NAN, 0.2, "WARNING")],
            "run int, camera_frames long, lidar_frames long, matched long, camera_dropped long, lidar_dropped long, mean_abs_s double, max_abs_s double, offset_s double, std_s double, drop_ratio double, classification string")),
        "motion_deskew": sections.deskew(of(spark, [(1, 5, 0.1, 0.2, 0.15)], "run int, n long, mean_m double, max_m double, p95_m double"), 0.1),
        "dynamic_filter": sections.dynamic_filter(of(spark, [(1, 1.0, "BAD", 5, NAN, "FAIL", 3, 0.4, 2)], "run int, overall_mean_px double, overall_class string, overall_edge_points long, static_mean_px double, static_class string, static_edge_points long, contamination double, removed long")),
        "m0_sanity_gate": sections.sanity_gate(gate, of(spark, [(1, 10, 8)], "run int, num_input_points long, num_valid_points long")),
        "m2_edge_alignment": sections.edge_alignment(m2),
        "m2_spatial_analysis": sections.spatial(stats, stats, stats, of(spark, [(1, "stable")], "run int, trend string")),
        "m3_holdout_consistency": sections.holdout(overall, blocks, diagnosis),
        "m4_multiframe_consistency": sections.multiframe(m4, stability.outliers(frames)),
        "quality_score": sections.quality(decisions.quality(cats), cats),
        "advanced": sections.advanced(
            sections.plane(of(spark, [(1, True, 0.5, 50, 31, 1.0, 1.0, 2.0, NAN, "GOOD")], "run int, plane_found boolean, inlier_ratio double, inliers long, outline_points long, mean_px double, median_px double, p95_px double, floor_px double, classification string")),
            sections.perturbation(least, of(spark, [(1, 2.5)], "run int, baseline_px double"), of(spark, [(1, "tx"), (1, "timestamp")], "run int, axis string"), of(spark, [(1, "tx", 0.1, 0.2, "LOW")], "run int, axis string, small_px double, large_px double, classification string")),
            sections.drift(of(spark, [(1, 40, 0.1, 0.9, 3.0, 0.01, 4.0, INF, True, "BAD")], "run int, n long, slope double, r double, t_stat double, p_value double, drift_px double, floor_px double, significant boolean, classification string"))),
        "root_cause_diagnosis": sections.root_causes(of(spark, [(1, 2, "B", "b", "LOW", ["x"]), (1, 1, "A", "a", "HIGH", ["y", "z"])], "run int, rank int, cause string, label string, confidence string, evidence array<string>"), of(spark, [], "run int, label string, detail string")),
        "quality_confidence_coverage": sections.quality_confidence_coverage(scores, parts),
        "warnings": of(spark, [(1, ["late"])], "run int, warnings array<string>"),
    }


def test_all_sections_are_strict_json_of_one_schema(spark):
    found = every_section(spark)
    assert list(found) == list(report.SECTIONS) == list(sections.SCHEMAS)
    runs = spark.createDataFrame([(1,), (2,)], "run int")
    whole = sections.whole_report(runs, found)
    bare = sections.whole_report(runs, {"m2_edge_alignment": found["m2_edge_alignment"]})
    kinds = lambda df: [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    assert kinds(whole) == kinds(bare) == kinds(sections.whole_report(runs, {}))
    texts = {r["run"]: json.loads(r["json"], parse_constant=lambda x: pytest.fail(x)) for r in report.as_json(whole).collect()}
    one, two = texts[1], texts[2]
    assert all(one[name] for name in report.SECTIONS)
    assert two == {name: [] if name == "warnings" else None for name in report.SECTIONS}
    assert one["metadata"]["camera"]["fx"] is None and one["metadata"]["camera"]["width"] == 320 and one["metadata"]["extrinsic"]["T_CL"] == [[1.0, None]]
    assert [c["name"] for c in one["input_validation"]["checks"]] == ["a", "b"] and one["input_validation"]["checks"][1]["value"] is None
    assert one["synchronization"]["estimated_offset_ms"] == -5.0 and one["synchronization"]["offset_std_ms"] is None
    assert one["m0_sanity_gate"]["passed"] is False and one["m0_sanity_gate"]["warnings"] == ["check failed: fov_coverage_sufficient"] and one["m0_sanity_gate"]["occlusion_violation_ratio"] == 0.2
    assert one["m2_edge_alignment"]["mean_px"] is None and one["m2_edge_alignment"]["num_unmatched"] == 2 and one["m2_edge_alignment"]["warnings"] == []
    assert list(one["m2_spatial_analysis"]["depth_bins"]) == ["0-10m", "10-20m"] and one["m2_spatial_analysis"]["depth_bins"]["0-10m"]["total_count"] == 5 and one["m2_spatial_analysis"]["depth_bins"]["0-10m"]["median_px"] is None
    m3 = one["m3_holdout_consistency"]
    assert [b["block_index"] for b in m3["blocks"]] == [1, 2] and m3["blocks"][0]["fov_coverage"] is None and m3["warnings"] == ["block 1: FAIL, 39 of 40 frames valid"]
    assert m3["instability_diagnosis"]["worst_block_index"] == 2 and m3["instability_diagnosis"]["worst_block_mean_px"] == 3.0 and m3["std_across_blocks_px"] is None
    m4 = one["m4_multiframe_consistency"]
    assert m4["outlier_frame_indices"] == [39] and len(m4["frame_trajectory"]) == 40 and m4["frame_trajectory"][39]["is_outlier"] and m4["warnings"] == []
    assert [c["metric"] for c in one["quality_score"]["categories"]] == ["M2", "M3", "M4"] and abs(sum(one["quality_score"]["weights_used"].values()) - 1) < 1e-9
    assert one["advanced"]["plane_consistency"]["num_boundary_points"] == 31 and one["advanced"]["temporal_drift"]["floor_px"] is None
    assert one["advanced"]["perturbation"]["best_sample"] == {"axis": "tx", "direction": 1, "delta": 0.5, "mean_px": 2.0} and one["advanced"]["perturbation"]["timestamp_sensitivity_computed"]
    assert [c["cause"] for c in one["root_cause_diagnosis"]["candidates"]] == ["A", "B"] and one["root_cause_diagnosis"]["confirmations"] == []
    assert [c["value"] for c in one["quality_confidence_coverage"]["confidence"]["components"]] == [None, 0.5] and one["quality_confidence_coverage"]["confidence"]["score"] is None


def test_long_runs_list_no_frames(spark):
    frames = of(spark, [(1, i, 1.0, 0.5, "GOOD") for i in range(40)], "run int, frame_index long, mean_px double, floor_px double, classification string")
    m4 = stability.multiframe(frames.drop("run")).select(F.lit(1).alias("run"), "*")
    row = sections.multiframe(m4, stability.outliers(frames), most=39).first()[1]
    assert row["frame_trajectory"] is None and row["outlier_frame_indices"] is None and len(row["warnings"]) == 1 and row["num_frames_total"] == 40
    assert sections.trajectory(stability.outliers(frames)).count() == 40


def test_unknown_fields_and_types_are_errors(spark):
    rows = of(spark, [(1, 1.0)], "run int, x double")
    with pytest.raises(ValueError, match="does not have"):
        sections.section(rows, "motion_deskew", speed=F.col("x"))
    with pytest.raises(ValueError, match="unknown"):
        sections.whole_report(rows, {"speed": rows})
    with pytest.raises(ValueError, match="declared"):
        sections.whole_report(rows, {"warnings": rows.withColumn("warnings", F.lit("late"))})


def test_bundle_says_what_is_missing(spark):
    score = lambda rows: of(spark, rows, "run int, score double, classification string")
    rows = {r["run"]: r["summary"] for r in decisions.bundle(score([(1, 80.0, "GOOD"), (2, None, "FAIL")]), score([(1, 49.6, "BAD")]), score([(1, None, "FAIL")])).collect()}
    assert rows == {1: "Quality: 80/100 (GOOD)  Confidence: 50/100 (BAD)  Coverage: N/A (FAIL)", 2: "Quality: N/A (FAIL)  Confidence: N/A (FAIL)  Coverage: N/A (FAIL)"}


def test_picks_of_long_streams(spark, monkeypatch):
    """Streams cut into pieces give what a window over each gives."""
    frames = of(spark, [(rig, i * 7 % 101 + rig) for rig, n in ((1, 101), (2, 12), (3, 1)) for i in range(n)], "rig int, frame_index long").repartition(5)

    def picks():
        found = [views.spread_frames(frames, 12), views.headline_frame(frames), views.frames_around(frames, 3)]
        assert [f.columns for f in found] == [["rig", "frame_index"]] * 2 + [["rig", "frame_index", "around"]]
        return [sorted(map(tuple, f.collect())) for f in found]

    whole = picks()
    assert len(whole[0]) == 12 + 12 + 1 and len(whole[1]) == 3 and (3, 3, []) in whole[2]
    monkeypatch.setattr(views, "STREAM_FRAMES", 10)
    assert picks() == whole
