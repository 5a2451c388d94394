"""Queries: fit, calibrate, score."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.functions import vectors as V
from gridsift.operators import moments as M
from gridsift.operators.describe import describe
from gridsift.plans.views import (HEIGHT, SQL_MODEL, SQL_RAW, SQL_SCORED, SQL_UNITS, WIDTH, features,
                                  fitted, r, rounded, scored, units)

QUERIES, ORACLE = {}, {}


def unit_descriptors(spark, sf):
    u = units(spark, sf)
    return rounded(u.select("category", "image", "cell", F.posexplode("u").alias("channel", "v")))


QUERIES["unit_descriptors"] = unit_descriptors
ORACLE["unit_descriptors"] = f"""WITH {SQL_UNITS}
SELECT category, image, cell, CAST(ch - 1 AS INTEGER) AS channel, {r('v')} AS v FROM long"""


def position_moments(spark, sf):
    model = M.position_model(units(spark, sf).where("split = 'fit'"))
    each = F.posexplode(F.arrays_zip("mean", "std_sample", "std")).alias("channel", "m")
    return rounded(model.select("category", "cell", "n", each).select("category", "cell", "n", "channel", "m.*"))


QUERIES["position_moments"] = position_moments
ORACLE["position_moments"] = f"""WITH {SQL_MODEL}
SELECT category, cell, n, CAST(ch - 1 AS INTEGER) AS channel, {r('mean')} AS mean, {r('std_sample')} AS std_sample,
  {r('std')} AS std FROM model"""


def raw_maps(spark, sf):
    u = units(spark, sf)
    model = M.position_model(u.where("split = 'fit'"))
    return rounded(M.raw_maps(u, model).select("category", "image", "cell", "raw"))


QUERIES["raw_maps"] = raw_maps
ORACLE["raw_maps"] = f"WITH {SQL_RAW} SELECT category, image, cell, {r('raw')} AS raw FROM raw"


def position_calibration(spark, sf):
    _, _, calibration = fitted(spark, sf)
    return rounded(M.parameter_report(calibration, HEIGHT, WIDTH))


QUERIES["position_calibration"] = position_calibration
ORACLE["position_calibration"] = f"""WITH {SQL_SCORED}
SELECT category, cell, CAST(cell // 4 AS INTEGER) AS "row", CAST(cell % 4 AS INTEGER) AS col, n, {r('alpha')} AS mu,
  {r('beta_sample')} AS sigma_sample, {r('beta')} AS sigma, beta_sample < 1e-6 AS floored FROM calibration"""


def calibration_summary(spark, sf):
    _, _, calibration = fitted(spark, sf)
    report = M.parameter_report(calibration, HEIGHT, WIDTH)
    return rounded(describe(report, ["category"], ["mu", "sigma_sample", "sigma"], [.05, .5, .95]))


QUERIES["calibration_summary"] = calibration_summary
ORACLE["calibration_summary"] = f"""WITH {SQL_SCORED},
  f AS (SELECT category, 'mu' AS field, alpha AS v FROM calibration
        UNION ALL SELECT category, 'sigma_sample', beta_sample FROM calibration
        UNION ALL SELECT category, 'sigma', beta FROM calibration)
SELECT category, field, count(*) AS n, {r('min(v)')} AS "min", {r('max(v)')} AS "max", {r('avg(v)')} AS mean,
  {r('quantile_cont(v, .05)')} AS p05, {r('quantile_cont(v, .5)')} AS p50, {r('quantile_cont(v, .95)')} AS p95
FROM f GROUP BY ALL"""


def anomaly_maps(spark, sf):
    return rounded(scored(spark, sf).select("category", "image", "cell", "raw", "z"))


QUERIES["anomaly_maps"] = anomaly_maps
ORACLE["anomaly_maps"] = f"WITH {SQL_SCORED} SELECT category, image, cell, {r('raw')} AS raw, {r('z')} AS z FROM maps"


def image_scores(spark, sf):
    return rounded(M.image_scores(scored(spark, sf), ["category", "image", "defect", "split"]))


QUERIES["image_scores"] = image_scores
ORACLE["image_scores"] = f"WITH {SQL_SCORED} SELECT category, image, defect, split, {r('score')} AS score FROM scores"


def uncalibrated_scores(spark, sf):
    u, model, _ = fitted(spark, sf)
    maps = M.calibrated(M.raw_maps(u, model), M.uncalibrated(model))
    return rounded(M.image_scores(maps))


QUERIES["uncalibrated_scores"] = uncalibrated_scores
ORACLE["uncalibrated_scores"] = f"""WITH {SQL_SCORED}
SELECT category, image, {r('raw_score')} AS score FROM scores"""


def map_summaries(spark, sf):
    return rounded(M.map_summary(scored(spark, sf)))


QUERIES["map_summaries"] = map_summaries
ORACLE["map_summaries"] = f"""WITH {SQL_SCORED}
SELECT category, image, count(*) AS cells, {r('min(z)')} AS "min", {r('avg(z)')} AS mean, {r('max(z)')} AS "max",
  first(cell ORDER BY z DESC, cell) AS argmax FROM maps GROUP BY ALL"""


def top_cells(spark, sf):
    return rounded(M.top_cells(scored(spark, sf), 5))


QUERIES["top_cells"] = top_cells
ORACLE["top_cells"] = f"""WITH {SQL_SCORED},
  n AS (SELECT *, row_number() OVER (PARTITION BY category, image ORDER BY z DESC, cell) AS k FROM maps)
SELECT category, image, CAST(k AS INTEGER) AS place, cell, {r('z')} AS z FROM n WHERE k <= 5"""


def visual_thresholds(spark, sf):
    maps = scored(spark, sf)
    return rounded(M.visual_thresholds(maps.where("split = 'calibration'")))


QUERIES["visual_thresholds"] = visual_thresholds
SQL_VISUAL = SQL_SCORED + """,
  q AS (SELECT category, count(*) AS n, quantile_disc(raw, .5) AS lower, quantile_disc(raw, .99) AS up
        FROM maps WHERE split = 'calibration' GROUP BY ALL),
  thresholds AS (SELECT category, n, lower, CASE WHEN up - lower < 1e-6 THEN lower + 1e-6 ELSE up END AS upper FROM q)"""
ORACLE["visual_thresholds"] = f"""WITH {SQL_VISUAL}
SELECT category, n, {r('lower')} AS lower, {r('upper')} AS upper FROM thresholds"""


def visual_maps(spark, sf):
    from gridsift.session import kept
    maps = scored(spark, sf)
    thresholds = kept(M.visual_thresholds(maps.where("split = 'calibration'")), "thresholds")
    shown = maps.where("split = 'test'").join(thresholds, "category").select(
        "category", "image", "cell", M.visual_score(F.col("raw"), F.col("lower"), F.col("upper")).alias("visual"),
        F.least(F.greatest(1 - F.col("raw"), F.lit(0.0)), F.lit(1.0)).alias("visual_uncalibrated"))
    return rounded(shown)


QUERIES["visual_maps"] = visual_maps
ORACLE["visual_maps"] = f"""WITH {SQL_VISUAL}
SELECT category, image, cell, {r('least(greatest((raw - lower) / (upper - lower), 0), 1)')} AS visual,
  {r('least(greatest(1 - raw, 0), 1)')} AS visual_uncalibrated
FROM maps JOIN thresholds USING (category) WHERE split = 'test'"""


def descriptor_guards(spark, sf):
    f = features(spark, sf)
    checked = f.select("category", "split", V.all_finite(F.col("x")).alias("finite"),
                       (F.size("x") == 8).alias("length"), V.norm("x").alias("norm"),
                       V.is_unit(V.unit("x")).alias("unit"))
    return rounded(checked.groupBy("category", "split").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("finite")).alias("not_finite"),
        F.count_if(~F.col("length")).alias("wrong_length"), F.count_if(F.col("norm") < V.NORM_GUARD).alias("tiny"),
        F.count_if(~F.col("unit")).alias("not_unit"), F.min("norm").alias("min_norm"), F.max("norm").alias("max_norm")))


QUERIES["descriptor_guards"] = descriptor_guards
ORACLE["descriptor_guards"] = f"""WITH {SQL_UNITS}
SELECT category, split, count(*) AS cells, count_if(len(list_filter(x, lambda v: NOT isfinite(v))) > 0) AS not_finite,
  count_if(len(x) <> 8) AS wrong_length, count_if(nrm < 1e-6) AS tiny,
  count_if(abs(list_sum(list_transform(x, lambda v: (v / nrm) * (v / nrm))) - 1) > 2e-12) AS not_unit,
  {r('min(nrm)')} AS min_norm, {r('max(nrm)')} AS max_norm FROM normed GROUP BY ALL"""


def model_state_bytes(spark, sf):
    _, model, calibration = fitted(spark, sf)
    return M.state_bytes(model, calibration)


QUERIES["model_state_bytes"] = model_state_bytes
ORACLE["model_state_bytes"] = f"""WITH {SQL_SCORED},
  l AS (SELECT category, CAST(count(*) * 16 AS BIGINT) AS b, count(DISTINCT cell) AS cells FROM model GROUP BY ALL),
  k AS (SELECT category, CAST(count(*) * 16 AS BIGINT) AS b FROM calibration GROUP BY ALL)
SELECT category, cells, l.b AS local_bytes, k.b AS calibration_bytes, l.b + k.b AS total_bytes FROM l JOIN k USING (category)"""
