"""Queries of hold-out, multi-frame and decision operators over the driver's tables, with their SQL. A run is a month of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .driver_queries import _FLOOR, _FRAMES, _PTS, _ROBUST, FLOOR, PLAIN, _placed, _table, frames
from .operators import decisions, stability, views
from .plans import report, sections
from .registry import ORACLES, query, rounded
from .tables import written

_DAYS = """days AS (SELECT date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS frame_id, count(*) AS edge_n, avg(o_custkey) AS proj_n, avg(o_totalprice) / 1e4 AS depth_m, min(o_orderkey) % 7 AS odd FROM orders GROUP BY 1),
fr AS (SELECT frame_id, CASE WHEN odd = 0 THEN 'FAIL' ELSE 'GOOD' END AS kind, depth_m, edge_n, proj_n, ntile(5) OVER (ORDER BY frame_id) AS block FROM days),
po AS (SELECT date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS frame_id, o_totalprice % 320 AS u, o_custkey % 240 AS v, o_totalprice / 1e5 AS e FROM orders)"""
_POOLED = f"""{_DAYS}, ok AS (SELECT * FROM fr WHERE kind <> 'FAIL'), n1 AS (SELECT block, count(*) AS frames, count_if(kind <> 'FAIL')::BIGINT AS valid_frames FROM fr GROUP BY 1),
s1 AS (SELECT block, quantile_cont(depth_m, 0.5) AS depth_m, avg(edge_n) AS edge_density, avg(proj_n) AS points_avg FROM ok GROUP BY 1),
e1 AS (SELECT block, avg(e) AS mean_px, quantile_cont(e, 0.5) AS median_px, quantile_cont(e, 0.95) AS p95_px, (max(u) - min(u)) * (max(v) - min(v)) / (320 * 240) AS fov FROM po JOIN ok USING (frame_id) GROUP BY 1),
pb AS (SELECT *, {_FLOOR.format('depth_m')} AS floor_px, CASE WHEN mean_px < 2 * {_FLOOR.format('depth_m')} THEN 'GOOD' WHEN mean_px < 5 * {_FLOOR.format('depth_m')} THEN 'WARNING' ELSE 'BAD' END AS classification FROM n1 JOIN s1 USING (block) JOIN e1 USING (block))"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long").alias("frame_id")
    days = orders.groupBy(day).agg(F.count("*").alias("num_edge_points"), F.avg("o_custkey").alias("num_projected"), (F.avg("o_totalprice") / 1e4).alias("representative_depth_m"), (F.min("o_orderkey") % 7).alias("odd"))
    days = days.withColumns({"classification": F.when(F.col("odd") == 0, "FAIL").otherwise("GOOD"), "frame_index": F.col("frame_id")})
    errors = orders.select(day, (F.col("o_totalprice") % 320).alias("u"), (F.col("o_custkey") % 240).alias("v"), (F.col("o_totalprice") / 1e5).alias("error_px"))
    return stability.pooled_blocks(stability.time_blocks(days, 5), errors, FLOOR, 320, 240)


@query(f"""WITH {_POOLED} SELECT block::INT AS block, frames, valid_frames, round(mean_px, 4) AS mean_px, round(median_px, 4) AS median_px, round(p95_px, 4) AS p95_px, round(depth_m, 4) AS depth_m, round(edge_density, 4) AS edge_density,
  round(points_avg, 3) AS points_avg, round(fov, 4) AS fov_coverage, round(floor_px, 4) AS floor_px, classification FROM pb""")
def m3_pooled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("mean_px", "median_px", "p95_px", "depth_m", "edge_density", "fov_coverage", "floor_px")
    return _blocks(spark, sf_dir).select("block", "frames", "valid_frames", *rounded(*names, digits=4), *rounded("points_avg", digits=3), "classification")


@query(f"""WITH {_POOLED}, o AS (SELECT count(*) AS valid_blocks, avg(mean_px) AS m, stddev_samp(mean_px) AS s, max(mean_px) - min(mean_px) AS g, quantile_cont(floor_px, 0.5) AS f FROM pb)
SELECT valid_blocks, round(m, 4) AS mean_px, round(s, 4) AS std_px, round(g, 4) AS range_px, round(f, 4) AS floor_px,
  CASE WHEN valid_blocks < 3 THEN 'FAIL' WHEN s < f THEN 'GOOD' WHEN s < 3 * f THEN 'WARNING' ELSE 'BAD' END AS classification FROM o""")
def m3_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.holdout_overall(_blocks(spark, sf_dir)).select("valid_blocks", *rounded("mean_px", "std_px", "range_px", "floor_px", digits=4), "classification")


@query(f"""WITH {_POOLED}, w AS (SELECT block FROM pb ORDER BY mean_px DESC, block LIMIT 1), l AS (SELECT block, i, metric, value FROM (
  SELECT block, 0 AS i, 'depth_m' AS metric, depth_m AS value FROM pb UNION ALL SELECT block, 1, 'edge_density', edge_density FROM pb UNION ALL SELECT block, 2, 'points_avg', points_avg FROM pb UNION ALL SELECT block, 3, 'fov_coverage', fov FROM pb)),
d AS (SELECT i, metric, max(value) FILTER (block = (SELECT block FROM w)) AS a, quantile_cont(value, 0.5) FILTER (block <> (SELECT block FROM w)) AS b FROM l GROUP BY 1, 2),
x AS (SELECT *, (a - b) / abs(b) AS r FROM d WHERE abs(b) >= 1e-9)
SELECT row_number() OVER (ORDER BY abs(r) DESC, i)::INT AS rank, (SELECT block FROM w)::INT AS worst_block, metric, round(a, 4) AS worst_value, round(b, 4) AS others_median, round(r, 5) AS relative_diff,
  CASE WHEN r > 0 THEN ['Long-range scenes', 'Dense edge structure', 'Dense point cloud', 'Wide FOV coverage'][i + 1] ELSE ['Short-range scenes', 'Sparse edge structure', 'Sparse point cloud', 'Narrow FOV coverage'][i + 1] END AS explanation FROM x WHERE abs(r) >= 0.001""")
def m3_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a threshold of 0.1 %, since the blocks of these orders are alike."""
    found = stability.instability(_blocks(spark, sf_dir), threshold=0.001)
    return found.select("rank", "worst_block", "metric", *rounded("worst_value", "others_median", digits=4), *rounded("relative_diff"), "explanation")


@query(f"""WITH {_ROBUST.replace("FROM orders GROUP BY 1", "FROM orders GROUP BY 1 HAVING frame_index % 7 <> 0")}, o AS (SELECT frame_index, mean_px, abs(mean_px - median) > CASE WHEN mad > 1e-6 THEN 3 * mad ELSE greatest(0.05, 0.05 * abs(median)) END AS out FROM frames, s),
a AS (SELECT count(*) AS n, avg(mean_px) AS m, stddev_samp(mean_px) AS sd, max(mean_px) AS mx, quantile_cont(mean_px, 0.95) AS p95, count_if(out) AS k FROM o), f AS (SELECT quantile_cont(floor_px, 0.5) AS fl FROM frames), every AS (SELECT count(DISTINCT o_orderdate::DATE) AS e FROM orders)
SELECT e AS frames, a.n AS valid_frames, e - a.n AS failed_frames, k::BIGINT AS outlier_frames, round(m, 5) AS mean_px, round(sd, 5) AS std_px, round(p95, 5) AS p95_px, round(mx, 5) AS max_px, round(median, 5) AS median, round(mad, 5) AS mad, round(fl, 5) AS floor_px,
  round(a.n / e, 6) AS valid_ratio, round(k / a.n, 6) AS outlier_ratio, CASE WHEN sd < fl THEN 'GOOD' WHEN sd < 3 * fl THEN 'WARNING' ELSE 'BAD' END AS classification FROM a, f, s, every""")
def m4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh day failed."""
    one = stability.multiframe(frames(spark, sf_dir).withColumn("classification", F.when(F.col("frame_index") % 7 == 0, "FAIL").otherwise("GOOD")))
    return one.select("frames", "valid_frames", "failed_frames", "outlier_frames", *rounded("mean_px", "std_px", "p95_px", "max_px", "median", "mad", "floor_px"), *rounded("valid_ratio", "outlier_ratio", digits=6), "classification")


# Facts of a run, from the customers of a nation: every rule fires for some and not for others.
_FACTS = """f AS (SELECT c_nationkey AS run, count(*) AS n, avg(c_acctbal) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1),
facts AS (SELECT run, ['GOOD', 'WARNING', 'BAD', 'FAIL'][run % 4 + 1] AS sync_class, round(a / 100, 2) AS offset_ms, CASE WHEN run % 2 = 0 THEN 6.0 ELSE 1.0 END AS left_px, CASE WHEN run % 3 = 0 THEN 12.5 ELSE 2.0 END AS right_px, 1.5 AS h_center_px,
  CASE WHEN run % 5 = 0 THEN 9.0 ELSE 3.0 END AS top_px, 4.0 AS bottom_px, CASE WHEN run % 7 <> 0 THEN 2.0 END AS v_center_px, CASE run % 3 WHEN 0 THEN 'decreases_with_depth' WHEN 1 THEN 'stable' END AS depth_trend,
  run % 8 / 20.0 AS contamination, ['GOOD', 'WARNING', 'BAD'][run % 3 + 1] AS static_class, ['GOOD', 'WARNING', 'BAD', 'FAIL'][run % 4 + 1] AS m3_class, CASE WHEN run % 3 <> 1 THEN 'depth_m' END AS worst_metric, run % 5 * 0.4 - 0.9 AS worst_diff,
  ['LOW', 'MEDIUM', 'HIGH'][run % 3 + 1] AS yaw, ['LOW', 'MEDIUM', 'HIGH'][run % 2 + 1] AS tz FROM f)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("run")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), r % n + 1)
    classes = ("GOOD", "WARNING", "BAD", "FAIL")
    axes = F.create_map(F.lit("yaw_deg"), pick(("LOW", "MEDIUM", "HIGH"), 3), F.lit("tz"), pick(("LOW", "MEDIUM"), 2))
    runs = _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("run")).agg(F.avg("c_acctbal").alias("a"))
    cols = {
        "sync_class": pick(classes, 4), "offset_ms": F.round(F.col("a") / 100, 2), "std_ms": F.lit(1.0), "drop_ratio": F.lit(0.1),
        "left_px": F.when(r % 2 == 0, 6.0).otherwise(1.0), "right_px": F.when(r % 3 == 0, 12.5).otherwise(2.0), "h_center_px": F.lit(1.5),
        "top_px": F.when(r % 5 == 0, 9.0).otherwise(3.0), "bottom_px": F.lit(4.0), "v_center_px": F.when(r % 7 != 0, 2.0),
        "depth_trend": F.when(r % 3 == 0, "decreases_with_depth").when(r % 3 == 1, "stable"), "near_px": F.lit(3.0), "far_px": F.lit(1.0),
        "contamination": r % 8 / 20.0, "overall_class": F.lit("BAD"), "overall_px": F.lit(3.0), "static_class": pick(classes[:3], 3), "static_px": F.lit(1.0),
        "m3_class": pick(classes, 4), "worst_block": F.lit(2), "worst_px": F.lit(4.0), "worst_metric": F.when(r % 3 != 1, "depth_m"), "worst_diff": (r % 5).cast("double") * 0.4 - 0.9,
        "worst_text": F.lit("Short-range scenes"), "axes": axes,
    }
    return runs.select("run", *[c.alias(n) for n, c in cols.items()])


_CAUSES = f"""{_FACTS}, c(run, cause, level, strength, pos) AS (
  SELECT run, 'TEMPORAL_OFFSET', CASE sync_class WHEN 'BAD' THEN 3 ELSE 2 END, abs(offset_ms), 0 FROM facts WHERE sync_class IN ('WARNING', 'BAD')
  UNION ALL SELECT run, 'YAW_MISALIGNMENT', CASE yaw WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END, greatest(left_px, right_px) / least(left_px, right_px), 1 FROM facts WHERE greatest(left_px, right_px) >= 2 * least(left_px, right_px) AND greatest(left_px, right_px) >= 2 * h_center_px
  UNION ALL SELECT run, 'PITCH_MISALIGNMENT', 1, greatest(top_px, bottom_px) / least(top_px, bottom_px), 2 FROM facts WHERE v_center_px IS NOT NULL AND greatest(top_px, bottom_px) >= 2 * least(top_px, bottom_px) AND greatest(top_px, bottom_px) >= 2 * v_center_px
  UNION ALL SELECT run, 'TX_MISALIGNMENT', 1, 1.0, 3 FROM facts WHERE depth_trend = 'decreases_with_depth'
  UNION ALL SELECT run, 'DYNAMIC_CONTAMINATION', CASE WHEN contamination >= 0.3 THEN 3 WHEN contamination >= 0.15 THEN 2 ELSE 1 END, contamination, 4 FROM facts WHERE contamination >= 0.05 AND static_class IN ('GOOD', 'WARNING')
  UNION ALL SELECT run, 'SCENE_DEPENDENT_INSTABILITY', CASE WHEN abs(worst_diff) >= 1 THEN 3 ELSE 2 END, abs(worst_diff), 5 FROM facts WHERE m3_class IN ('WARNING', 'BAD') AND worst_metric IS NOT NULL
  UNION ALL SELECT run, 'UNEXPLAINED_SENSITIVITY_TZ', 1, 0, 6 FROM facts WHERE tz <> 'LOW'
  UNION ALL SELECT run, 'UNEXPLAINED_SENSITIVITY_YAW_DEG', 1, 0, 7 FROM facts WHERE yaw <> 'LOW' AND NOT (greatest(left_px, right_px) >= 2 * least(left_px, right_px) AND greatest(left_px, right_px) >= 2 * h_center_px)),
rk AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY level DESC, strength DESC, pos)::INT AS rank, cause, ['LOW', 'MEDIUM', 'HIGH'][level] AS confidence FROM c)"""


@query(f"WITH {_CAUSES} SELECT * FROM rk")
def root_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.root_causes(_facts(spark, sf_dir)).select("run", "rank", "cause", "confidence")


@query(f"""WITH {_FACTS} SELECT run, 'Timestamp sync' AS label FROM facts WHERE sync_class = 'GOOD' UNION ALL SELECT run, 'Dynamic object contamination' FROM facts WHERE contamination < 0.05
UNION ALL SELECT run, 'Block-to-block consistency (M3)' FROM facts WHERE m3_class = 'GOOD' UNION ALL SELECT run, 'Calibration parameter sensitivity' FROM facts WHERE yaw = 'LOW' AND tz = 'LOW'""")
def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.confirmations(_facts(spark, sf_dir)).select("run", "label")


@query(f"WITH {_CAUSES} SELECT facts.run, coalesce(cause = 'TEMPORAL_OFFSET', false) AS passed FROM facts LEFT JOIN rk ON rk.run = facts.run AND rank = 1")
def diagnosis_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a late clock is the first cause; its strength in ms outranks the other causes of like confidence."""
    facts = _facts(spark, sf_dir)
    cases = decisions.diagnosis_cases(decisions.root_causes(facts), facts.select("run", F.lit("TEMPORAL_OFFSET").alias("expected")))
    return cases.select("run", "passed")


# Category values of a run from the orders of a customer's priority.
_CATS = """ct AS (SELECT o_custkey % 50 AS run, ['geometry', 'generalization', 'stability'][o_orderkey % 3 + 1] AS name, avg(o_totalprice) / 1e5 AS v, min(o_totalprice) / 1e5 + 0.3 AS fl, count(*) % 5 = 0 AS bad FROM orders GROUP BY 1, 2),
sc AS (SELECT *, CASE WHEN NOT bad THEN 100 / (1 + (v / fl / CASE name WHEN 'geometry' THEN 5 ELSE 3 END) ** (ln(0.25) / ln(CASE name WHEN 'geometry' THEN 0.4 ELSE 1.0 / 3 END))) END AS score FROM ct)"""
_LABEL = "CASE WHEN {0} IS NULL THEN 'FAIL' WHEN {0} >= 80 THEN 'GOOD' WHEN {0} >= 50 THEN 'WARNING' ELSE 'BAD' END"


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, decisions.CATEGORIES)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("name")
    rows = _table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("run"), name)
    rows = rows.agg((F.avg("o_totalprice") / 1e5).alias("value_px"), (F.min("o_totalprice") / 1e5 + 0.3).alias("floor_px"), F.when(F.count("*") % 5 == 0, "FAIL").otherwise("GOOD").alias("class"))
    return decisions.category_scores(rows)


@query(f"WITH {_CATS} SELECT run, name, NOT bad AS valid, round(score, 4) AS score, {_LABEL.format('score')} AS classification FROM sc")
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _categories(spark, sf_dir).select("run", "name", "valid", *rounded("score", digits=4), "classification")


@query(f"""WITH {_CATS}, q AS (SELECT run, count(*) AS n, count(score) AS k, avg(score) AS s FROM sc GROUP BY 1)
SELECT run, k AS valid_categories, round(s, 4) AS score, CASE WHEN k < n AND s >= 80 THEN 'WARNING' ELSE {_LABEL.format('s')} END AS classification FROM q""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.quality(_categories(spark, sf_dir)).select("run", "valid_categories", *rounded("score", digits=4), "classification")


_CONF = """cf AS (SELECT c_custkey AS run, CASE WHEN c_custkey % 7 <> 0 THEN ['GOOD', 'WARNING', 'BAD', 'FAIL'][c_custkey % 4 + 1] END AS sc, CASE WHEN c_custkey % 5 <> 0 THEN ['INPUT_VALID', 'INPUT_WARNING', 'INPUT_INVALID', 'OTHER'][c_custkey % 4 + 1] END AS st,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 100 / 100.0 END AS mr, c_custkey % 6 AS vb, CASE WHEN c_custkey % 11 <> 0 THEN 4 END AS nb, CASE WHEN c_custkey % 2 = 0 THEN 0.75 END AS vr FROM customer),
cs AS (SELECT run, [CASE sc WHEN 'GOOD' THEN 1.0 WHEN 'WARNING' THEN 0.6 WHEN 'BAD' THEN 0.2 WHEN 'FAIL' THEN 0.0 END, CASE st WHEN 'INPUT_VALID' THEN 1.0 WHEN 'INPUT_WARNING' THEN 0.5 WHEN 'INPUT_INVALID' THEN 0.0 WHEN 'OTHER' THEN 0.5 END, mr, CASE WHEN nb > 0 THEN least(1.0, vb / nb) END, vr]::DOUBLE[] AS p FROM cf),
cn AS (SELECT run, list_filter(p, lambda x: x IS NOT NULL) AS p FROM cs), co AS (SELECT run, CASE WHEN len(p) > 0 THEN 100 * list_avg(p) END AS s, len(p) AS n FROM cn)"""


@query(f"WITH {_CONF} SELECT run, round(s, 4) AS score, n AS parts, {_LABEL.format('round(s, 8)')} AS classification FROM co")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % 4 + 1).cast("int"))
    facts = _table(spark, sf_dir, "customer").select(
        k.alias("run"), F.when(k % 7 != 0, pick(("GOOD", "WARNING", "BAD", "FAIL"))).alias("sync_class"), F.when(k % 5 != 0, pick(("INPUT_VALID", "INPUT_WARNING", "INPUT_INVALID", "OTHER"))).alias("input_status"),
        F.when(k % 3 != 0, k % 100 / 100.0).alias("match_rate"), (k % 6).alias("valid_blocks"), F.when(k % 11 != 0, 4).alias("n_blocks"), F.when(k % 2 == 0, 0.75).alias("valid_ratio"),
    )
    out = decisions.confidence(facts)
    return out.select("run", F.round("score", 4).alias("score"), "parts", "classification")


_COVER = """cd AS (SELECT c_nationkey AS run, ['0-10m', '10-20m', '20-30m', '30-50m', '50m+'][i + 1] AS label, count_if(c_custkey % 5 = i AND c_custkey % 3 > 0 AND c_nationkey % 5 >= i) AS n FROM customer, (SELECT unnest(range(5)) AS i) GROUP BY 1, 2),
cr AS (SELECT c_nationkey AS run, a AS axis, CASE WHEN i = 1 THEN 'CENTER' WHEN a = 'h' THEN ['LEFT', '', 'RIGHT'][i + 1] ELSE ['TOP', '', 'BOTTOM'][i + 1] END AS label, count_if(c_nationkey % 3 >= i AND (a = 'h' OR c_nationkey % 2 = 0)) AS n FROM customer, (SELECT unnest(range(3)) AS i), (SELECT unnest(['h', 'v']) AS a) GROUP BY 1, 2, i),
cb AS (SELECT c_nationkey AS run, ['GOOD', 'BAD', 'FAIL', 'EXCLUDED'][c_custkey % 4 + 1] AS classification, avg(c_acctbal) / 1e4 AS fov FROM customer GROUP BY 1, 2),
cp AS (SELECT run, avg((n > 0)::INT) AS v FROM cd GROUP BY 1 UNION ALL SELECT run, avg((n > 0)::INT) FROM (SELECT run, label, arg_max(n, axis) AS n FROM cr GROUP BY 1, 2) GROUP BY 1
  UNION ALL SELECT run, least(1, avg(fov)) FROM cb WHERE classification IN ('GOOD', 'BAD', 'WARNING') GROUP BY 1)"""


@query(f"WITH {_COVER} SELECT run, round(100 * avg(v), 4) AS score, count(*) AS parts, {_LABEL.format('round(100 * avg(v), 8)')} AS classification FROM cp GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    each = lambda df, m: df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    i, names = F.col("i"), ("0-10m", "10-20m", "20-30m", "30-50m", "50m+")
    depth = each(c, 5).groupBy(n.alias("run"), F.element_at(F.array(*map(F.lit, names)), i + 1).alias("label")).agg(F.count_if((k % 5 == i) & (k % 3 > 0) & (n % 5 >= i)).alias("n"))
    side = F.when(i == 1, "CENTER").when(F.col("axis") == "h", F.when(i == 0, "LEFT").otherwise("RIGHT")).otherwise(F.when(i == 0, "TOP").otherwise("BOTTOM"))
    regions = each(c, 3).withColumn("axis", F.explode(F.array(F.lit("h"), F.lit("v")))).groupBy(n.alias("run"), "axis", side.alias("label")).agg(F.count_if((n % 3 >= i) & ((F.col("axis") == "h") | (n % 2 == 0))).alias("n"))
    kind = F.element_at(F.array(*map(F.lit, ("GOOD", "BAD", "FAIL", "EXCLUDED"))), (k % 4 + 1).cast("int")).alias("classification")
    blocks = c.groupBy(n.alias("run"), kind).agg((F.avg("c_acctbal") / 1e4).alias("fov_coverage"))
    return decisions.coverage(depth, regions, blocks).select("run", *rounded("score", digits=4), "parts", "classification")


_SAMPLES = """sm AS (SELECT l_suppkey % 10 AS run, ['tx', 'ty', 'yaw_deg'][l_linenumber % 3 + 1] AS axis, l_quantity AS delta, CASE WHEN count(*) % 7 > 0 THEN avg(l_extendedprice) / 1e4 + l_quantity * 0.05 END AS m FROM lineitem GROUP BY 1, 2, 3),
so AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY axis, delta) AS position FROM sm)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = F.element_at(F.array(*map(F.lit, ("tx", "ty", "yaw_deg"))), F.col("l_linenumber") % 3 + 1).alias("axis")
    rows = _table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("run"), axis, F.col("l_quantity").alias("delta"))
    rows = rows.agg(F.when(F.count("*") % 7 > 0, F.avg("l_extendedprice") / 1e4 + F.col("l_quantity") * 0.05).alias("mean_px"))
    return rows.withColumns({"direction": F.lit(1), "position": F.struct("axis", "delta")})


@query(f"""WITH {_SAMPLES}, b AS (SELECT run, arg_min(axis, (m, axis, delta)) AS axis, arg_min(delta, (m, axis, delta)) AS delta, min(m) AS best FROM so WHERE m IS NOT NULL GROUP BY 1), c AS (SELECT run, count_if(m IS NULL)::BIGINT AS invalid FROM so GROUP BY 1)
SELECT run, axis, delta, round(best, 4) AS best_px, round(2.6 - best, 4) AS margin_px, invalid, CASE WHEN best IS NULL THEN 'FAIL' WHEN 2.6 - best <= 0.05 THEN 'AT_LOCAL_MINIMUM' ELSE 'NOT_AT_LOCAL_MINIMUM' END AS classification FROM c LEFT JOIN b USING (run)""")
def local_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    out = decisions.local_minimum(samples, samples.select("run").distinct().withColumn("baseline_px", F.lit(2.6)))
    return out.select("run", "axis", "delta", *rounded("best_px", "margin_px", digits=4), "invalid", "classification")


@query(f"""WITH {_SAMPLES}, st AS (SELECT run, axis, m - lag(m) OVER (PARTITION BY run, axis ORDER BY delta) AS step FROM so WHERE m IS NOT NULL), g AS (SELECT run, axis, count(*) AS n, min(step) AS lo FROM st GROUP BY 1, 2)
SELECT run, axis, coalesce(n, 0) AS valid, coalesce(lo >= -0.5, false) AS is_monotonic FROM (SELECT DISTINCT run, axis FROM so) LEFT JOIN g USING (run, axis)""")
def monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.monotonic_axes(_samples(spark, sf_dir), 0.5, ("run", "axis"))


@query(f"""WITH {_PTS}, s AS (SELECT min(error) AS a, max(error) AS b FROM pts), c AS (SELECT least(floor((error - a) / (b - a) * 40), 39)::INT AS bin, count(*) AS n FROM pts, s GROUP BY 1)
SELECT i::INT AS bin, round(a + (b - a) * i / 40, 5) AS lo, round(a + (b - a) * (i + 1) / 40, 5) AS hi, coalesce(n, 0) AS n FROM s, (SELECT unnest(range(40)) AS i) LEFT JOIN c ON bin = i""")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _table(spark, sf_dir, "lineitem").select((F.col("l_tax") * 100).alias("error"))
    return views.histogram(errors, "error").select("bin", *rounded("lo", "hi"), "n")


@query(f"""WITH {_PTS}, d AS (SELECT frame_id, least(200, greatest(1, quantile_cont(depth, 0.75))) AS z FROM proj GROUP BY 1), c AS (SELECT * FROM (VALUES (0, 0.0, 0.0, 0.0), (1, -160.0 / 150, -120.0 / 150, 1.0), (2, 160.0 / 150, -120.0 / 150, 1.0), (3, 160.0 / 150, 120.0 / 150, 1.0), (4, -160.0 / 150, 120.0 / 150, 1.0)) v(corner, a, b, k))
SELECT frame_id, corner::INT AS corner, round(a * z - 0.2, 5) AS x, round(b * z + 0.1, 5) AS y, round(k * z - 0.1, 5) AS z FROM d, c""")
def frustum_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frustum(views.view_depth(_placed(spark, sf_dir)), PLAIN).select("frame_id", "corner", *rounded("x", "y", "z"))


@query(f"""WITH {_PTS} SELECT frame_id, floor(least(greatest((depth - 1) / 49, 0), 1) * 255)::INT AS colour, count(*) AS n FROM proj GROUP BY 1, 2""")
def depth_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).groupBy("frame_id", views.depth_colour(F.col("depth")).alias("colour")).agg(F.count("*").alias("n"))


@query(f"""WITH {_PTS}, s AS (SELECT min(depth) AS a, max(depth) AS b FROM proj), d AS (SELECT a + (b - a) * i / 199 AS z FROM s, (SELECT unnest(range(200)) AS i)) SELECT round(z, 6) AS depth_m, round({_FLOOR.format('z')}, 5) AS floor_px FROM d""")
def floor_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.floor_curve(_placed(spark, sf_dir), FLOOR).select(*rounded("depth_m", digits=6), *rounded("floor_px"))


@query(f"""WITH {_FRAMES}, r AS (SELECT frame_index, row_number() OVER (ORDER BY frame_index) - 1 AS pos, count(*) OVER () AS n FROM frames)
SELECT frame_index, list_contains(list_transform(range(least(12, n)), lambda i: round_even(CASE WHEN least(12, n) > 1 THEN i * (n - 1) / (least(12, n) - 1) ELSE 0 END, 0)::BIGINT), pos) AS sampled, pos = floor(n / 2) AS headline FROM r""")
def frame_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select(F.lit(0).alias("rig"), "frame_index")
    some, head = views.spread_frames(rows, 12).select("frame_index", F.lit(True).alias("s")), views.headline_frame(rows).select("frame_index", F.lit(True).alias("h"))
    out = rows.join(some, "frame_index", "left").join(head, "frame_index", "left")
    return out.select("frame_index", F.col("s").isNotNull().alias("sampled"), F.col("h").isNotNull().alias("headline"))


@query(f"""WITH {_FRAMES}, r AS (SELECT frame_index, row_number() OVER (ORDER BY frame_index) AS pos FROM frames)
SELECT a.frame_index, string_agg(b.frame_index, ',' ORDER BY b.frame_index) AS around FROM r a JOIN r b ON b.pos BETWEEN a.pos - 5 AND a.pos + 5 AND b.pos <> a.pos GROUP BY 1""")
def frame_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select(F.lit(0).alias("rig"), "frame_index")
    return views.frames_around(rows).select("frame_index", F.array_join(F.array_sort("around"), ",").alias("around"))


@query()
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each run with what the facts above give; no SQL, since its text is JSON."""
    facts = _facts(spark, sf_dir)
    causes = report.listed(decisions.root_causes(facts).withColumn("position", F.col("rank")), "candidates", ["position"])
    diagnosis = causes.join(report.listed(decisions.confirmations(facts), "confirmations", ["label"]), "run", "full_outer")
    scores = decisions.quality(_categories(spark, sf_dir))
    sections = {
        "synchronization": report.section(facts.select("run", F.col("sync_class").alias("classification"), "offset_ms", "std_ms", "drop_ratio"), "synchronization"),
        "quality_score": report.section(scores, "quality_score"), "root_cause_diagnosis": report.section(diagnosis, "root_cause_diagnosis"),
    }
    return report.as_json(report.report(facts.select("run"), sections))


_PATHS = {
    "m3_class": "$.m3_holdout_consistency.classification", "m3_blocks": "$.m3_holdout_consistency.num_valid_blocks", "m3_mean": "$.m3_holdout_consistency.mean_across_blocks_px",
    "m3_first": "$.m3_holdout_consistency.blocks[0].mean_px", "m3_last": "$.m3_holdout_consistency.blocks[4].median_px", "m3_cause": "$.m3_holdout_consistency.instability_diagnosis.candidates[0].metric",
    "m3_dynamic": "$.m3_holdout_consistency.blocks[0].dynamic_ratio", "m4_class": "$.m4_multiframe_consistency.classification", "m4_outliers": "$.m4_multiframe_consistency.num_outlier_frames",
    "m4_mad": "$.m4_multiframe_consistency.mad_px", "m4_failed": "$.m4_multiframe_consistency.num_failed_frames", "m4_first": "$.m4_multiframe_consistency.frame_trajectory[0].frame_index",
    "drift_class": "$.advanced.temporal_drift.classification", "drift_r": "$.advanced.temporal_drift.r_value", "plane": "$.advanced.plane_consistency", "sync": "$.synchronization",
}


@query(f"""WITH o3 AS ({ORACLES["m3_overall"]}), b3 AS ({ORACLES["m3_pooled_blocks"]}), d3 AS ({ORACLES["m3_diagnosis"]}), o4 AS ({ORACLES["m4_summary"]}), dr AS ({ORACLES["temporal_drift"]})
SELECT 'm3_class' AS field, classification AS said, NULL::DOUBLE AS figure FROM o3 UNION ALL SELECT 'm3_blocks', NULL, valid_blocks FROM o3 UNION ALL SELECT 'm3_mean', NULL, mean_px FROM o3
UNION ALL SELECT 'm3_first', NULL, mean_px FROM b3 WHERE block = 1 UNION ALL SELECT 'm3_last', NULL, median_px FROM b3 WHERE block = 5 UNION ALL SELECT 'm3_cause', max(metric), NULL FROM d3 WHERE rank = 1 UNION ALL SELECT 'm3_dynamic', NULL, NULL
UNION ALL SELECT 'm4_class', classification, NULL FROM o4 UNION ALL SELECT 'm4_outliers', NULL, outlier_frames FROM o4 UNION ALL SELECT 'm4_mad', NULL, round(mad, 4) FROM o4 UNION ALL SELECT 'm4_failed', NULL, failed_frames FROM o4
UNION ALL SELECT 'm4_first', NULL, min(date_diff('day', DATE '1990-01-01', o_orderdate::DATE)) FROM orders
UNION ALL SELECT 'drift_class', classification, NULL FROM dr UNION ALL SELECT 'drift_r', NULL, round(r, 4) FROM dr UNION ALL SELECT 'plane', NULL, NULL UNION ALL SELECT 'sync', NULL, NULL""")
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of one run with its hold-out, multi-frame and drift sections, read back from its JSON by paths."""
    run = F.lit(1).alias("run")
    keyed = lambda df: df.select(run, "*")
    blocks = written(_blocks(spark, sf_dir))
    third = sections.holdout(keyed(stability.holdout_overall(blocks)), keyed(blocks), keyed(stability.instability(blocks, threshold=0.001)))
    every = frames(spark, sf_dir).withColumn("classification", F.when(F.col("frame_index") % 7 == 0, "FAIL").otherwise("GOOD"))
    marked = stability.outliers(every.where("classification <> 'FAIL'"))
    failed = every.where("classification = 'FAIL'").withColumns({"z": F.lit(None).cast("double"), "is_outlier": F.lit(False)})
    fourth = sections.multiframe(keyed(stability.multiframe(every)), keyed(marked.unionByName(failed)))
    bad = F.col("frame_index") % 5 == 0
    fit = stability.drift(frames(spark, sf_dir).withColumn("classification", F.when(bad, "FAIL").otherwise("GOOD")))
    found = {"m3_holdout_consistency": third, "m4_multiframe_consistency": fourth, "advanced": sections.advanced(sections.drift(keyed(fit)))}
    texts = report.as_json(sections.whole_report(spark.range(1).select(run), found))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.get_json_object("json", p).alias("v")) for n, p in _PATHS.items()]))
    figure = F.expr("try_cast(v AS double)")
    return texts.select(each.alias("e")).select("e.*").select("field", F.when(figure.isNull(), F.col("v")).alias("said"), F.round(figure, 4).alias("figure"))


@query(f"""WITH rc AS ({ORACLES["root_cause"]}), q AS ({ORACLES["quality_score"]}), runs AS (SELECT DISTINCT c_nationkey AS run FROM customer), n AS (SELECT run, count(*) AS causes, max(cause) FILTER (rank = 1) AS top_cause, max(confidence) FILTER (rank = 1) AS confidence FROM rc GROUP BY 1)
SELECT run, coalesce(causes, 0)::INT AS causes, top_cause, confidence, score, classification, valid_categories::BIGINT AS valid_categories FROM runs LEFT JOIN n USING (run) LEFT JOIN q USING (run)""")
def report_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each run with its causes and scores, read back from its JSON."""
    facts, cats = _facts(spark, sf_dir), _categories(spark, sf_dir)
    found = {"root_cause_diagnosis": sections.root_causes(decisions.root_causes(facts), decisions.confirmations(facts)), "quality_score": sections.quality(decisions.quality(cats), cats)}
    at = lambda path: F.get_json_object("json", f"$.{path}")
    texts = report.as_json(sections.whole_report(facts.select("run"), found))
    return texts.select(
        "run", F.coalesce(F.json_array_length(at("root_cause_diagnosis.candidates")), F.lit(0)).alias("causes"), at("root_cause_diagnosis.candidates[0].cause").alias("top_cause"),
        at("root_cause_diagnosis.candidates[0].confidence").alias("confidence"), F.round(at("quality_score.overall_score").cast("double"), 4).alias("score"),
        at("quality_score.overall_classification").alias("classification"), at("quality_score.num_valid_categories").cast("long").alias("valid_categories"),
    )


@query(f"""WITH q AS ({ORACLES["quality_score"]}), cf AS ({ORACLES["confidence"]}), cv AS ({ORACLES["coverage"]}),
t AS (SELECT run, q.score AS quality_score, q.classification AS quality_class, cf.score AS confidence_score, cf.classification AS confidence_class, cv.score AS coverage_score, cv.classification AS coverage_class FROM q LEFT JOIN cf USING (run) LEFT JOIN cv USING (run))
SELECT *, {" || '  ' || ".join(f"'{n.capitalize()}: ' || coalesce(floor({n}_score + 0.5)::INT || '/100', 'N/A') || ' (' || coalesce({n}_class, 'FAIL') || ')'" for n in ("quality", "confidence", "coverage"))} AS summary FROM t""")
def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the runs that have all, some or only one of the three."""
    parts = decisions.quality(_categories(spark, sf_dir)), confidence(spark, sf_dir), coverage(spark, sf_dir)
    names = [f"{n}_score" for n in ("quality", "confidence", "coverage")]
    out = decisions.bundle(*parts)
    return out.select("run", *rounded(*names, digits=4), "quality_class", "confidence_class", "coverage_class", "summary")
