"""Queries: variant comparisons, ranked reports, pose against score, kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.functions.grid import column_of, row_of
from gridsift.operators import correspondence as C
from gridsift.operators import evaluate as E
from gridsift.operators import imaging as I
from gridsift.operators import moments as M
from gridsift.operators import reports as R
from gridsift.operators.describe import describe
from gridsift.operators.paired import acceptance, pearson
from gridsift.plans import evaluation as EV
from gridsift.plans import imaging as IM
from gridsift.plans import operations as OP
from gridsift.plans import studies as ST
from gridsift.plans.views import HEIGHT, SQL_SCORED, WIDTH, fitted, image_table, r, rounded, scored
from gridsift.session import kept

QUERIES, ORACLE = {}, {}


def variant_maps(spark, sf):
    return ST.nuisance_maps(spark, sf, split="test", levels=(1.0,), families=("BRIGHTNESS",))[0]


SQL_VARIANTS = ST.sql_nuisance("test", (1.0,)) + """,
  vm AS (SELECT variant, category, image, cell, raw, z FROM nz WHERE family = 'BRIGHTNESS' AND level = 1),
  rel AS (SELECT a.category, a.image, CASE WHEN stddev_pop(a.z) > 0 AND stddev_pop(b.z) > 0 THEN corr(a.z, b.z) END AS correlation,
      first(a.cell ORDER BY a.z DESC, a.cell) AS ca, first(a.cell ORDER BY b.z DESC, a.cell) AS cb, max(b.z) - max(a.z) AS score_delta
    FROM vm a JOIN vm b USING (category, image, cell) WHERE a.variant = 'identity' AND b.variant = 'canonical' GROUP BY ALL),
  rels AS (SELECT category, image, correlation, sqrt((ca % 4 - cb % 4) ** 2 + (ca // 4 - cb // 4) ** 2) AS hotspot_distance, score_delta FROM rel)"""


def relationships(spark, sf):
    maps = variant_maps(spark, sf)
    return R.map_relationships(maps.where("variant = 'identity'"), maps.where("variant = 'canonical'"), ["category", "image", "defect"], WIDTH)


def map_relationships(spark, sf):
    return rounded(relationships(spark, sf).drop("defect"), 5)


QUERIES["map_relationships"] = map_relationships
ORACLE["map_relationships"] = f"""WITH {SQL_VARIANTS} SELECT category, image, {r('correlation', 5)} AS correlation, {r('hotspot_distance', 5)} AS hotspot_distance,
  {r('score_delta', 5)} AS score_delta FROM rels"""


def map_relationship_summary(spark, sf):
    rows = kept(relationships(spark, sf), "relationships")
    return rounded(describe(rows, ["category", "defect"], ["correlation", "hotspot_distance", "score_delta"], [.05, .5, .95]), 5)


QUERIES["map_relationship_summary"] = map_relationship_summary
ORACLE["map_relationship_summary"] = f"""WITH {SQL_VARIANTS},
  f AS (SELECT category, CASE WHEN label < 6 THEN 'good' ELSE 'd' || label END AS defect, unnest([{{'k': 'correlation', 'v': correlation}},
      {{'k': 'hotspot_distance', 'v': hotspot_distance}}, {{'k': 'score_delta', 'v': score_delta}}]) AS s FROM rels JOIN embeddings ON vec_id = image)
SELECT category, defect, s.k AS field, count(*) AS n, {r('min(s.v)', 5)} AS "min", {r('max(s.v)', 5)} AS "max", {r('avg(s.v)', 5)} AS mean, {r('quantile_cont(s.v, .05)', 5)} AS p05,
  {r('quantile_cont(s.v, .5)', 5)} AS p50, {r('quantile_cont(s.v, .95)', 5)} AS p95 FROM f WHERE s.v IS NOT NULL GROUP BY ALL"""


def variant_deltas(spark, sf):
    """Image AUROC of the plain grid, the identity and the canonical variant, and the steps between them."""
    plain = image_table(scored(spark, sf)).where("split = 'test'").select(F.lit("historical").alias("variant"), "category", "anomaly", "score")
    both = variant_maps(spark, sf).groupBy("variant", "category", "image", "anomaly").agg(F.max("z").alias("score")).drop("image")
    auc = E.auroc(plain.unionByName(both), ["variant", "category"])
    return rounded(R.variant_deltas(auc, ["category"], "variant", ["historical", "identity", "canonical"], "auroc"))


QUERIES["variant_deltas"] = variant_deltas
ORACLE["variant_deltas"] = f"""WITH {SQL_VARIANTS}, {SQL_SCORED.replace("raw AS (", "raw0 AS (").replace("FROM raw ", "FROM raw0 ").replace("raw JOIN", "raw0 JOIN")},
  s AS (SELECT 'historical' AS variant, category, image, anomaly, score AS s FROM scores WHERE split = 'test'
    UNION ALL SELECT variant, category, image, label >= 6, max(z) FROM vm JOIN embeddings ON vec_id = image GROUP BY ALL),
  a AS (SELECT p.variant, p.category, avg(CASE WHEN p.s > g.s THEN 1.0 WHEN p.s = g.s THEN .5 ELSE 0 END) AS auc FROM s p JOIN s g USING (variant, category) WHERE p.anomaly AND NOT g.anomaly GROUP BY ALL),
  w AS (SELECT category, max(auc) FILTER (variant = 'historical') AS historical, max(auc) FILTER (variant = 'identity') AS identity, max(auc) FILTER (variant = 'canonical') AS canonical FROM a GROUP BY ALL)
SELECT category, {r('historical')} AS historical, {r('identity')} AS identity, {r('canonical')} AS canonical, {r('identity - historical')} AS historical_to_identity,
  {r('canonical - identity')} AS identity_to_canonical FROM w"""


def smallest_sigma(spark, sf):
    """The cells with the smallest calibration deviation of each category."""
    _, _, calibration = fitted(spark, sf)
    report = M.parameter_report(calibration, HEIGHT, WIDTH)
    return rounded(R.ranked_rows(report, ["category"], [F.col("sigma").asc(), F.col("cell").asc()], 10).select("category", "place", "cell", "mu", "sigma"))


QUERIES["smallest_sigma"] = smallest_sigma
ORACLE["smallest_sigma"] = f"""WITH {SQL_SCORED}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY beta, cell) AS INTEGER) AS place FROM calibration)
SELECT category, place, cell, {r('alpha')} AS mu, {r('beta')} AS sigma FROM k WHERE place <= 10"""


def frequent_peaks(spark, sf):
    """The cells that are most often the peak of a good test image."""
    peaks = M.map_summary(scored(spark, sf).where("split = 'test' AND NOT anomaly")).groupBy("category", F.col("argmax").alias("cell")).agg(
        F.count(F.lit(1)).alias("images"))
    return R.ranked_rows(peaks, ["category"], [F.col("images").desc(), F.col("cell").asc()], 10).select(
        "category", "place", "cell", row_of(F.col("cell"), WIDTH).alias("row"), column_of(F.col("cell"), WIDTH).alias("col"), "images")


QUERIES["frequent_peaks"] = frequent_peaks
ORACLE["frequent_peaks"] = f"""WITH {SQL_SCORED}, p AS (SELECT category, image, first(cell ORDER BY z DESC, cell) AS cell FROM maps WHERE split = 'test' AND NOT anomaly GROUP BY ALL),
  n AS (SELECT category, cell, count(*) AS images FROM p GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY images DESC, cell) AS INTEGER) AS place FROM n)
SELECT category, place, cell, CAST(cell // 4 AS INTEGER) AS "row", CAST(cell % 4 AS INTEGER) AS col, images FROM k WHERE place <= 10"""


def timing_fixture(spark, sf):
    """The first good test image of each category, in name order."""
    t = image_table(scored(spark, sf)).where("split = 'test'")
    return t.groupBy("category").agg(F.min(F.when(F.col("defect") == "good", F.col("image"))).alias("fixture"),
                                     F.count_if("anomaly").alias("anomalies"))


QUERIES["timing_fixture"] = timing_fixture
ORACLE["timing_fixture"] = f"""WITH {SQL_SCORED} SELECT category, min(image) FILTER (defect = 'good') AS fixture, count_if(anomaly) AS anomalies
FROM scores WHERE split = 'test' GROUP BY ALL"""


def component_peaks(spark, sf):
    """Peak of every annotated rectangle and its percentile in the map."""
    arrays = EV.test_arrays(spark, sf).join(EV.masks(spark, sf), ["category", "image"])
    return rounded(R.component_peaks(arrays, ["category", "image"], HEIGHT, WIDTH, EV.OUT_HEIGHT, EV.OUT_WIDTH))


QUERIES["component_peaks"] = component_peaks
ORACLE["component_peaks"] = f"""WITH {EV.sql_pixels()},
  p AS (SELECT category, image, region, max(score) AS peak, count(*) AS area FROM pixels WHERE region > 0 GROUP BY ALL)
SELECT p.category, p.image, CAST(p.region AS INTEGER) AS region, {r('p.peak')} AS peak, area, {r('avg(CAST(x.score <= p.peak AS INT))')} AS percentile
FROM p JOIN pixels x ON x.category = p.category AND x.image = p.image GROUP BY p.category, p.image, p.region, p.peak, area"""


def winner_origins(spark, sf):
    """How often the winner of a changed image keeps the baseline's cell, per condition, and the response of each field."""
    recs, maps, _ = ST.records(spark, sf)
    baseline = recs.where("level = 1.0").select("variant", "category", "image", "family", F.col("max_cell").alias("_cell"))
    moved = recs.join(baseline, ["variant", "category", "image", "family"]).withColumn(
        "origin", F.when(F.col("max_cell") == F.col("_cell"), "same").otherwise("moved"))
    return moved.groupBy("family", "level", "variant").pivot("origin", ["same", "moved"]).agg(F.count(F.lit(1))).na.fill(0, ["same", "moved"])


QUERIES["winner_origins"] = winner_origins
ORACLE["winner_origins"] = f"""WITH {ST.sql_nuisance()}, j AS (SELECT a.family, a.level, a.variant, a.max_cell = b.max_cell AS s FROM rec a JOIN rec b
   ON a.variant = b.variant AND a.category = b.category AND a.image = b.image AND a.family = b.family AND b.level = 1)
SELECT family, level, variant, count_if(s) AS same, count_if(NOT s) AS moved FROM j GROUP BY ALL"""


def group_counts(spark, sf):
    """Boolean and state fields of every pose counted per category and split."""
    p = OP.poses(spark, sf).drop("image", "defect")
    return R.summarised(p, ["category", "split"], counted=["state"])[1]


QUERIES["group_counts"] = group_counts
ORACLE["group_counts"] = f"""WITH {OP.SQL_POSES}, f AS (SELECT category, split, unnest([{{'k': 'anomaly', 'v': CAST(anomaly AS VARCHAR)}}, {{'k': 'border', 'v': CAST(border AS VARCHAR)}},
   {{'k': 'state', 'v': state}}]) AS s FROM poses) SELECT category, split, s.k AS field, s.v AS value, count(*) AS n FROM f GROUP BY ALL"""


def group_summaries(spark, sf):
    """Every numeric field of every pose summarised per category and split."""
    p = OP.poses(spark, sf).drop("image", "defect")
    return rounded(R.summarised(p, ["category", "split"])[0], 5)


QUERIES["group_summaries"] = group_summaries
_numeric = ("cx", "cy", "angle", "area", "anisotropy", "polarity", "h4", "clipped_fraction")
ORACLE["group_summaries"] = f"""WITH {OP.SQL_POSES}, f AS (SELECT category, split, unnest([{", ".join(f"{{'k': '{c}', 'v': {c}}}" for c in _numeric)}]) AS s FROM poses)
SELECT category, split, s.k AS field, count(*) AS n, {r('min(s.v)', 5)} AS "min", {r('max(s.v)', 5)} AS "max", {r('avg(s.v)', 5)} AS mean, {r('quantile_cont(s.v, .05)', 5)} AS p05,
  {r('quantile_cont(s.v, .5)', 5)} AS p50, {r('quantile_cont(s.v, .95)', 5)} AS p95 FROM f GROUP BY ALL"""


def pose_score_correlation(spark, sf):
    """Correlation of the score of good test images with where their object lies."""
    p = OP.poses(spark, sf).where("split = 'test' AND NOT anomaly").select("category", "image", "cx", "cy", "area", "anisotropy")
    j = image_table(scored(spark, sf)).join(p, ["category", "image"]).withColumn(
        "centre_distance", F.hypot(F.col("cx") - 349.5, F.col("cy") - 349.5))
    return rounded(j.groupBy("category").agg(F.count(F.lit(1)).alias("n"), *[
        pearson(c, "score").alias(c) for c in ("centre_distance", "cx", "cy", "area", "anisotropy")]))


QUERIES["pose_score_correlation"] = pose_score_correlation
ORACLE["pose_score_correlation"] = f"""WITH {SQL_SCORED}, {OP.SQL_POSES},
  j AS (SELECT s.category, s.score, sqrt((cx - 349.5) ** 2 + (cy - 349.5) ** 2) AS d, cx, cy, area, anisotropy FROM scores s JOIN poses p ON p.category = s.category AND p.image = s.image
    WHERE s.split = 'test' AND NOT s.anomaly)
SELECT category, count(*) AS n, {r('corr(d, score)')} AS centre_distance, {r('corr(cx, score)')} AS cx, {r('corr(cy, score)')} AS cy, {r('corr(area, score)')} AS area,
  {r('corr(anisotropy, score)')} AS anisotropy FROM j GROUP BY ALL"""


# Sampling kernels as candidates: the turned image on 4x4 samples is a 2x2 grid of 4 channels.

def kernel_pilot(spark, sf):
    """Coherence of the FIT features under the three kernels, and whether each passes the gates."""
    rows = kept(IM.posed(spark, sf).where("split = 'fit'").select("category", "image", "pixels", "transform"), "posed")
    out = None
    for kernel in ("bilinear", "bicubic", "tent"):
        s = I.canonical_samples(rows, ["category", "image"], IM.SIDE, 4, kernel).withColumn("kernel", F.lit(kernel))
        out = s if out is None else out.unionByName(s)
    at = lambda r_, c: F.array(*[F.element_at("values", 4 * (2 * r_ + i) + 2 * c + j + 1) for i in (0, 1) for j in (0, 1)])
    cells = F.array(*[at(r_, c) for r_ in (0, 1) for c in (0, 1)])
    units = M.units(out.select("kernel", "category", "image", F.posexplode(cells).alias("cell", "x")))
    moments = M.channel_moments(units, ["kernel", "category", "cell"]).withColumn("_k", F.col("category"))
    named = moments.withColumn("category", F.concat_ws("/", "kernel", "_k"))
    coherent = C.coherence(named).groupBy("category").agg(F.avg("cosine_mean").alias("cosine_mean"), F.avg("dispersion").alias("dispersion"))
    split = F.split("category", "/")
    table = coherent.select(split[0].alias("kernel"), split[1].alias("category"), "cosine_mean", "dispersion")
    return rounded(acceptance(table, {"coherent": ("cosine_mean", ">=", 0.9), "tight": ("dispersion", "<=", 0.05)}))


QUERIES["kernel_pilot"] = kernel_pilot
_kernels = IM.ORACLE["canonical_samples"].rsplit("SELECT kernel", 1)[0]
ORACLE["kernel_pilot"] = f"""{_kernels},
  x AS (SELECT kernel, category, image, i // 4 // 2 * 2 + i % 4 // 2 AS cell, i // 4 % 2 * 2 + i % 4 % 2 AS ch, least(greatest(v, 0), 255) AS v FROM every JOIN embeddings ON vec_id = image WHERE label < 2),
  u AS (SELECT kernel, category, image, cell, ch, v / sqrt(sum(v * v) OVER (PARTITION BY kernel, image, cell)) AS u FROM x),
  m AS (SELECT kernel, category, cell, ch, count(*) AS n, avg(u) AS m FROM u GROUP BY ALL),
  c AS (SELECT kernel, category, cell, (any_value(n) * sum(m * m) - 1) / (any_value(n) - 1) AS cm, 1 - sum(m * m) AS dp FROM m GROUP BY ALL),
  t AS (SELECT kernel, category, avg(cm) AS cm, avg(dp) AS dp FROM c GROUP BY ALL)
SELECT kernel, category, {r('cm')} AS cosine_mean, {r('dp')} AS dispersion, cm >= .9 AS coherent, dp <= .05 AS tight, cm >= .9 AND dp <= .05 AS qualifies FROM t"""


def framing_states(spark, sf):
    """How many silhouettes of each split fit their frame, violate its margin or are clipped."""
    from gridsift.operators import regions as RG
    points = OP.silhouette_points(spark, sf)
    contract = kept(RG.framing(RG.envelope(RG.extents(points.where("split = 'fit'"), ["category", "image"], "radius"), ["category"]), OP.SIZE, OP.MARGIN), "framing")
    framed = RG.framed(points, contract, ["category", "split", "image"], ["category"], OP.SIZE, "radius")
    state = OP.poses(spark, sf).select("image", F.when(F.col("state") == "SEGMENTATION_FAILURE", "FAILED").otherwise("OK").alias("status"))
    return framed.join(state, "image").withColumn("frame", R.frame_state(F.col("status"), F.col("support_outside"), F.col("clearance"))).groupBy(
        "category", "split", "frame").agg(F.count(F.lit(1)).alias("images"))


QUERIES["framing_states"] = framing_states
ORACLE["framing_states"] = f"""WITH {OP.SQL_FRAMED}, {OP.SQL_POSES}
SELECT fm.category, fm.split, CASE WHEN state = 'SEGMENTATION_FAILURE' THEN 'NOT_AVAILABLE' WHEN support_outside > 0 THEN 'CLIPPED' WHEN clearance < 4 THEN 'MARGIN_VIOLATION' ELSE 'SAFE' END AS frame,
  count(*) AS images FROM fm JOIN poses USING (image) GROUP BY ALL"""


def pulled_masks(spark, sf):
    """Silhouette pixels seen on the 8x8 frame of the turned image."""
    rows = IM.masks(spark, sf).select("category", "image", "mask").join(IM.posed(spark, sf).select("image", "transform"), "image")
    seen = I.pulled(rows, ["category", "image"], IM.SIDE, IM.SIDE)
    return seen.select("category", "image", F.posexplode("mask").alias("px", "inside")).where("inside").drop("inside")


QUERIES["pulled_masks"] = pulled_masks
ORACLE["pulled_masks"] = f"""WITH RECURSIVE {IM.SQL_MASK},
  tr AS (SELECT vec_id AS image, cos(a) AS co, sin(a) AS si, 3.5::DOUBLE - (cos(a) * 3.5::DOUBLE - sin(a) * 3.5::DOUBLE) AS tx, 3.5::DOUBLE - (sin(a) * 3.5::DOUBLE + cos(a) * 3.5::DOUBLE) AS ty
    FROM (SELECT vec_id, atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)) AS a FROM embeddings)),
  f AS (SELECT image, px, floor(co * (px % 8 - tx) + si * (px // 8 - ty) + .5) AS sx, floor(-si * (px % 8 - tx) + co * (px // 8 - ty) + .5) AS sy FROM tr, (SELECT unnest(range(64)) AS px))
SELECT mk.category, f.image, CAST(f.px AS INTEGER) AS px FROM f JOIN mk ON mk.image = f.image AND mk.x = f.sx AND mk.y = f.sy"""


def warped_images(spark, sf):
    """Every image turned by its own rigid transform."""
    out = I.warped(IM.posed(spark, sf), ["category", "image"], IM.SIDE, IM.SIDE)
    return out.select("category", "image", F.posexplode("pixels").alias("px", "v"))


QUERIES["warped_images"] = warped_images
ORACLE["warped_images"] = f"""WITH {IM.SQL_TURN},
  s AS (SELECT category, image, p, i, co * (i % 8 - tx) + si * (i // 8 - ty) AS x, -si * (i % 8 - tx) + co * (i // 8 - ty) AS y FROM pix JOIN tr USING (image), (SELECT unnest(range(64)) AS i)),
  t AS (SELECT category, image, i, p, CAST(floor(x) AS INT) + a AS tx, CAST(floor(y) AS INT) + b AS ty, (CASE a WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END)
     * (CASE b WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) AS w FROM s, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
  v AS (SELECT category, image, i, sum(w * p[least(greatest(ty, 0), 7) * 8 + least(greatest(tx, 0), 7) + 1]) / sum(w) AS v FROM t GROUP BY ALL)
SELECT category, image, CAST(i AS INTEGER) AS px, CAST(floor(v + .5) AS INTEGER) AS v FROM v"""
