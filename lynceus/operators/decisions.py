"""What follows from the metrics: scores, confidence, coverage, sensitivity verdicts and ranked causes. Facts are few rows a run.

Facts carry a key (``run``), so many recordings are judged in one job. A missing figure is null, and a rule whose
inputs are null does not fire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .noise_floor import named, score, score_class, severity

#: Fixed values.
CATEGORIES = ("geometry", "generalization", "stability")
SYNC_SCORES = {"GOOD": 1.0, "WARNING": 0.6, "BAD": 0.2, "FAIL": 0.0}
INPUT_SCORES = {"INPUT_VALID": 1.0, "INPUT_WARNING": 0.5, "INPUT_INVALID": 0.0}
MINIMUM_TOLERANCE_PX = MONOTONIC_TOLERANCE_PX = 0.05
ASYMMETRY, CONTAMINATION = 2.0, (0.05, 0.15, 0.30)
AXIS_NAMES = {"roll_deg": "Roll", "pitch_deg": "Pitch", "yaw_deg": "Yaw", "tx": "Tx", "ty": "Ty", "tz": "Tz", "timestamp": "Timestamp sync"}


def _map(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), key)


def category_scores(facts: DataFrame, key: str = "run") -> DataFrame:
    """key, name, valid, score, classification of M2, M3 and M4. ``facts``: key, name, class, value_px, floor_px.

    Geometry is scored by 2 and 5 floors, both others by 1 and 3; a metric that failed has no score.
    """
    valid = F.col("class") != "FAIL"
    by = lambda *bounds: score(F.when(valid, F.col("value_px")), F.col("floor_px"), *bounds)
    out = facts.withColumn("score", F.when(F.col("name") == "geometry", by(2.0, 5.0)).otherwise(by(1.0, 3.0)))
    return out.select(key, "name", valid.alias("valid"), "score", F.when(valid, score_class(F.col("score"))).otherwise("FAIL").alias("classification"))


def quality(categories: DataFrame, weights: dict[str, float] | None = None, key: str = "run") -> DataFrame:
    """key, valid_categories, score, classification: the weighted mean of what could be measured, at best WARNING if something could not."""
    weights = weights or dict.fromkeys(CATEGORIES, 1 / len(CATEGORIES))
    if set(weights) != set(CATEGORIES) or any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError(f"weights must be non-negative, not all zero, and name {CATEGORIES}")
    weight = F.when(F.col("valid"), _map({k: float(v) for k, v in weights.items()}, F.col("name")))
    one = categories.withColumn("w", weight).groupBy(key).agg(
        F.count("*").alias("all"), F.count_if("valid").alias("valid_categories"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("score")).alias("s")
    )
    one = one.withColumn("score", F.when(F.col("w") > 1e-9, F.col("s") / F.col("w")))
    plain = score_class(F.col("score"))
    return one.select(key, "valid_categories", "score", F.when((plain == "GOOD") & (F.col("valid_categories") < F.col("all")), "WARNING").otherwise(plain).alias("classification"))


def _mean_of(parts: DataFrame, key: str) -> DataFrame:
    one = parts.where("value is not null").groupBy(key).agg((100 * F.avg("value")).alias("score"), F.count("*").alias("parts"))
    out = parts.select(key).distinct().join(one, key, "left")
    return out.select(key, "score", F.coalesce("parts", F.lit(0).cast("long")).alias("parts"), score_class(F.col("score")).alias("classification"))


def confidence(facts: DataFrame, key: str = "run") -> DataFrame:
    """key, score, parts, classification. ``facts``: sync_class, input_status, match_rate, valid_blocks, n_blocks, valid_ratio; nulls are not held against a run."""
    checked = F.when(F.col("input_status").isNotNull(), F.coalesce(_map(INPUT_SCORES, F.col("input_status")), F.lit(0.5)))
    synced = F.when(F.col("sync_class").isNotNull(), F.coalesce(_map(SYNC_SCORES, F.col("sync_class")), F.lit(0.0)))
    blocks = F.when(F.col("n_blocks") > 0, F.least(F.lit(1.0), F.col("valid_blocks") / F.col("n_blocks")))
    return _mean_of(facts.select(key, F.explode(F.array(synced, checked, F.col("match_rate"), blocks, F.col("valid_ratio"))).alias("value")), key)


def coverage(depth: DataFrame, regions: DataFrame, blocks: DataFrame, key: str = "run") -> DataFrame:
    """key, score, parts, classification from the filled shares of depth bins and image regions and the mean field of view.

    ``depth``: key, label, n; ``regions``: key, axis (h or v), label, n; ``blocks``: key, classification,
    fov_coverage. Both axes name their middle CENTER, which counts once, as the vertical one.
    """
    filled = lambda df: df.groupBy(key).agg(F.avg((F.col("n") > 0).cast("double")).alias("value"))
    five = regions.groupBy(key, "label").agg(F.max_by("n", "axis").alias("n"))
    seen = blocks.where("classification in ('GOOD', 'WARNING', 'BAD')").groupBy(key).agg(F.least(F.lit(1.0), F.avg("fov_coverage")).alias("value"))
    return _mean_of(filled(depth).unionByName(filled(five)).unionByName(seen), key)


def bundle(quality_rows: DataFrame, confidence_rows: DataFrame, coverage_rows: DataFrame, key: str = "run") -> DataFrame:
    """The three side by side with one line of summary."""
    part = lambda df, name: df.select(key, F.col("score").alias(f"{name}_score"), F.col("classification").alias(f"{name}_class"))
    both = part(quality_rows, "quality").join(part(confidence_rows, "confidence"), key, "left").join(part(coverage_rows, "coverage"), key, "left")
    text = lambda name: F.concat(F.lit(f"{name.capitalize()}: "), F.when(F.col(f"{name}_score").isNotNull(), F.format_string("%.0f/100", f"{name}_score")).otherwise("N/A"), F.lit(" ("), F.coalesce(f"{name}_class", F.lit("FAIL")), F.lit(")"))
    return both.withColumn("summary", F.concat_ws("  ", text("quality"), text("confidence"), text("coverage")))


def local_minimum(samples: DataFrame, baseline: DataFrame, tolerance_px: float = MINIMUM_TOLERANCE_PX, key: str = "run") -> DataFrame:
    """key, best axis, direction, delta and mean, margin, invalid and classification; FAIL without baseline or samples.

    ``samples``: key, position (order of evaluation), axis, direction, delta, mean_px (null: failed); of equal means the first.
    ``baseline``: key, baseline_px (null: failed).
    """
    best = samples.where("mean_px is not null").groupBy(key).agg(F.min_by(F.struct("axis", "direction", "delta", "mean_px"), F.struct("mean_px", "position")).alias("b"))
    lost = samples.groupBy(key).agg(F.count_if(F.col("mean_px").isNull()).alias("invalid"))
    out = baseline.join(best, key, "left").join(lost, key, "left").withColumn("margin_px", F.col("baseline_px") - F.col("b.mean_px"))
    kind = F.when(F.col("margin_px").isNull(), "FAIL").when(F.col("margin_px") <= tolerance_px, "AT_LOCAL_MINIMUM").otherwise("NOT_AT_LOCAL_MINIMUM")
    return out.select(key, "b.axis", "b.direction", "b.delta", F.col("b.mean_px").alias("best_px"), "margin_px", F.coalesce("invalid", F.lit(0).cast("long")).alias("invalid"), kind.alias("classification"))


def monotonic_axes(samples: DataFrame, tolerance_px: float = MONOTONIC_TOLERANCE_PX, keys: tuple[str, ...] = ("axis",)) -> DataFrame:
    """keys, valid, is_monotonic: whether the error never falls by over the tolerance as delta grows; needs two valid samples."""
    before = F.lag("mean_px").over(Window.partitionBy(*keys).orderBy("delta"))
    steps = samples.where("mean_px is not null").withColumn("step", F.col("mean_px") - before)
    falls = steps.groupBy(*keys).agg(F.count("*").alias("valid"), F.coalesce(F.min("step") >= -tolerance_px, F.lit(False)).alias("is_monotonic"))
    out = samples.select(*keys).distinct().join(falls, list(keys), "left")
    return out.withColumns({"valid": F.coalesce("valid", F.lit(0).cast("long")), "is_monotonic": F.coalesce("is_monotonic", F.lit(False))})


def _by_sensitivity(axis: str) -> Column:
    found = F.element_at("axes", axis)
    return F.when(found.isin("HIGH", "MEDIUM"), found).otherwise("LOW")


def _asymmetry(low: str, high: str, center: str) -> tuple[Column, Column]:
    """Whether one side is twice as bad as the other and the middle, and by how much over the other."""
    a, b, c = (F.when(F.col(x) > 0, F.col(x)) for x in (low, high, center))
    every = a.isNotNull() & b.isNotNull() & c.isNotNull()
    worse, other = F.greatest(a, b), F.least(a, b)
    return every & (worse >= ASYMMETRY * other) & (worse >= ASYMMETRY * c), worse / other


def root_causes(facts: DataFrame, key: str = "run") -> DataFrame:
    """key, rank, cause, label, confidence, evidence of what the facts point to: by confidence, then strength, then order of the rules.

    ``facts``, a row a run: sync_class, offset_ms, std_ms, drop_ratio; left_px, right_px, h_center_px, top_px, bottom_px,
    v_center_px; depth_trend, near_px, far_px; contamination, overall_class, overall_px, static_class, static_px; m3_class,
    worst_block, worst_px, worst_metric, worst_diff, worst_text; axes (map of axis to HIGH, MEDIUM or LOW).
    """
    text = F.format_string
    tilted, by_side = _asymmetry("left_px", "right_px", "h_center_px")
    pitched, by_height = _asymmetry("top_px", "bottom_px", "v_center_px")
    nearer = F.col("depth_trend") == "decreases_with_depth"
    late = F.col("sync_class").isin("WARNING", "BAD")
    diff = F.abs("worst_diff")
    dirty = (F.col("contamination") >= CONTAMINATION[0]) & F.col("static_class").isin("GOOD", "WARNING")
    shaky = F.col("m3_class").isin("WARNING", "BAD") & F.col("worst_metric").isNotNull()

    def cause(fires: Column, code: str, label: Column, level: Column, strength: Column, evidence: Column) -> Column:
        return F.when(fires, F.struct(F.lit(code).alias("cause"), label.alias("label"), level.alias("confidence"), strength.cast("double").alias("strength"), F.array_compact(evidence).alias("evidence")))

    def swing(axis: str, name: str) -> Column:
        found = F.element_at("axes", axis)
        return F.when(found.isNotNull(), F.concat(F.lit(f"{name} perturbation sensitivity is "), found, F.lit("."))).otherwise(f"{name} perturbation sensitivity was not measured.")

    def side(low: str, high: str, center: str, names: tuple[str, str]) -> Column:
        worse, other = F.greatest(low, high), F.least(low, high)
        named_side = F.when(F.col(high) >= F.col(low), names[1]).otherwise(names[0])
        return text("%s error (%.2f px) is %.1f times the opposite side (%.2f px) and %.1f times the center (%.2f px).", named_side, worse, F.try_divide(worse, other), other, F.try_divide(worse, F.col(center)), F.col(center))

    rules = [
        cause(late, "TEMPORAL_OFFSET", F.lit("Timestamp offset"), F.when(F.col("sync_class") == "BAD", "HIGH").otherwise("MEDIUM"), F.abs("offset_ms"),
              F.array(text("Synchronization is %s (offset %+.1f ms, deviation %.1f ms, %.1f%% dropped).", "sync_class", "offset_ms", "std_ms", F.col("drop_ratio") * 100))),
        cause(tilted, "YAW_MISALIGNMENT", F.lit("Yaw misalignment"), _by_sensitivity("yaw_deg"), by_side,
              F.array(side("left_px", "right_px", "h_center_px", ("LEFT", "RIGHT")), swing("yaw_deg", "Yaw"))),
        cause(pitched, "PITCH_MISALIGNMENT", F.lit("Pitch misalignment"), _by_sensitivity("pitch_deg"), by_height,
              F.array(side("top_px", "bottom_px", "v_center_px", ("TOP", "BOTTOM")), swing("pitch_deg", "Pitch"))),
        cause(nearer, "TX_MISALIGNMENT", F.lit("Tx misalignment"), _by_sensitivity("tx"), F.lit(1.0),
              F.array(F.lit("Error falls with depth, as a shift along the baseline makes it."),
                      F.when(F.col("near_px").isNotNull() & F.col("far_px").isNotNull(), text("Near error %.2f px, far error %.2f px.", "near_px", "far_px")), swing("tx", "Tx"))),
        cause(dirty, "DYNAMIC_CONTAMINATION", F.lit("Dynamic object contamination"),
              F.when(F.col("contamination") >= CONTAMINATION[2], "HIGH").when(F.col("contamination") >= CONTAMINATION[1], "MEDIUM").otherwise("LOW"), F.col("contamination"),
              F.array(text("%.0f%% of edge points are dynamic.", F.col("contamination") * 100), text("All points: %s (%.2f px), static ones: %s (%.2f px).", "overall_class", "overall_px", "static_class", "static_px"))),
        cause(shaky, "SCENE_DEPENDENT_INSTABILITY", F.col("worst_text"), F.when(diff >= 1.0, "HIGH").otherwise("MEDIUM"), diff,
              F.array(text("Block %s has the highest error (%.2f px); its %s differs by %+.0f%%.", F.col("worst_block").cast("string"), "worst_px", "worst_metric", F.col("worst_diff") * 100))),
    ]
    claimed = F.array_compact(F.array(F.when(late, "timestamp"), F.when(tilted, "yaw_deg"), F.when(pitched, "pitch_deg"), F.when(nearer, "tx")))
    left_over = F.filter(F.array_sort(F.map_keys(F.coalesce("axes", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))), lambda a: F.element_at("axes", a).isin("HIGH", "MEDIUM") & ~F.array_contains(claimed, a))
    name = lambda a: F.coalesce(_map(AXIS_NAMES, a), a)
    loose = F.transform(left_over, lambda a: F.struct(
        F.concat(F.lit("UNEXPLAINED_SENSITIVITY_"), F.upper(a)).alias("cause"), F.concat(name(a), F.lit(" sensitivity ("), F.lower(F.element_at("axes", a)), F.lit(", unconfirmed)")).alias("label"),
        F.lit("LOW").alias("confidence"), F.lit(0.0).alias("strength"),
        F.array(F.concat(name(a), F.lit(" perturbation sensitivity is "), F.element_at("axes", a), F.lit(", without a pattern that confirms it."))).alias("evidence"),
    ))
    found = facts.select(key, F.posexplode(F.concat(F.array_compact(F.array(*rules)), loose)).alias("position", "c")).select(key, "position", "c.*")
    level = F.when(F.col("confidence") == "HIGH", 3).when(F.col("confidence") == "MEDIUM", 2).otherwise(1)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(level.desc(), F.col("strength").desc_nulls_last(), "position"))
    return found.select(key, rank.alias("rank"), "cause", "label", "confidence", "evidence")


def confirmations(facts: DataFrame, key: str = "run") -> DataFrame:
    """key, label, detail of what was checked and is fine; inputs as root_causes."""
    ok = lambda fires, label, detail: F.when(fires, F.struct(F.lit(label).alias("label"), detail.alias("detail")))
    calm = (F.size(F.map_keys("axes")) > 0) & F.forall(F.map_values("axes"), lambda c: c == "LOW")
    rules = [
        ok(F.col("sync_class") == "GOOD", "Timestamp sync", F.format_string("No significant clock offset (%+.1f ms).", "offset_ms")),
        ok(F.col("contamination") < CONTAMINATION[0], "Dynamic object contamination", F.format_string("Only %.0f%% of edge points are dynamic.", F.col("contamination") * 100)),
        ok(F.col("m3_class") == "GOOD", "Block-to-block consistency (M3)", F.lit("No scene-dependent instability across time blocks.")),
        ok(calm, "Calibration parameter sensitivity", F.format_string("All %d axes show LOW sensitivity.", F.size(F.map_keys("axes")))),
    ]
    return facts.select(key, F.explode(F.array_compact(F.array(*rules))).alias("c")).select(key, "c.*")


def diagnosis_cases(causes: DataFrame, expected: DataFrame, key: str = "run") -> DataFrame:
    """key, expected, actual (the top cause, null without any), passed."""
    top = causes.where("rank = 1").select(key, F.col("cause").alias("actual"))
    return expected.join(top, key, "left").select(key, "expected", "actual", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)).alias("passed"))


def label_counts(rows: DataFrame, keys: tuple[str, ...] = (), label: str = "label", labels: tuple[str, ...] = ("static", "dynamic", "unknown")) -> DataFrame:
    """A column of counts for each label."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(label) == x).alias(f"n_{x}") for x in labels])


def worst_of(*kinds: Column) -> Column:
    """The worst of several classes."""
    return named(F.greatest(*[severity(k) for k in kinds]))
