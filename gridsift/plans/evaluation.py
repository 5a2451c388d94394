"""Queries: image and pixel quality, per defect, by support, macro averages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.functions.grid import cell_groups
from gridsift.operators import evaluate as E
from gridsift.operators import moments as M
from gridsift.operators.describe import describe
from gridsift.operators.ordered import numbered
from gridsift.operators.paired import pearson
from gridsift.plans.views import (HEIGHT, SQL_SCORED, WIDTH, image_table, images, r, rounded, scored, table)
from gridsift.session import kept

QUERIES, ORACLE = {}, {}

OUT_HEIGHT, OUT_WIDTH = 6, 12

# Good test images against all anomalies, under both scores.
SQL_LONG = SQL_SCORED + """,
  test AS (SELECT category, image, defect, anomaly, 'z' AS method, score FROM scores WHERE split = 'test'
           UNION ALL SELECT category, image, defect, anomaly, 'raw', raw_score FROM scores WHERE split = 'test'),
  steps AS (SELECT method, category, score, count_if(anomaly) AS tp, count_if(NOT anomaly) AS fp FROM test GROUP BY ALL),
  sweep AS (SELECT *, sum(tp) OVER (PARTITION BY method, category ORDER BY score DESC) AS tps FROM steps),
  auc AS (SELECT method, category, CAST(sum(tp) AS BIGINT) AS positives, CAST(sum(fp) AS BIGINT) AS negatives,
            sum(fp * (2 * tps - tp) / 2.0) / (CAST(sum(tp) AS DOUBLE) * sum(fp)) AS auroc FROM sweep GROUP BY ALL)"""


def test_scores(spark, sf):
    t = image_table(scored(spark, sf)).where("split = 'test'")
    both = F.explode(F.array(F.struct(F.lit("z").alias("method"), F.col("score")),
                             F.struct(F.lit("raw").alias("method"), F.col("raw_score").alias("score")))).alias("m")
    return t.select("category", "image", "defect", "anomaly", both).select(
        "category", "image", "defect", "anomaly", "m.method", "m.score")


def image_auroc(spark, sf):
    return rounded(E.auroc(test_scores(spark, sf), ["method", "category"]))


QUERIES["image_auroc"] = image_auroc
ORACLE["image_auroc"] = f"WITH {SQL_LONG} SELECT method, category, positives, negatives, {r('auroc')} AS auroc FROM auc"


def image_auroc_by_defect(spark, sf):
    return rounded(E.auroc_by_defect(test_scores(spark, sf), ["method", "category"]))


QUERIES["image_auroc_by_defect"] = image_auroc_by_defect
ORACLE["image_auroc_by_defect"] = f"""WITH {SQL_LONG}
SELECT p.method, p.category, p.defect, count(DISTINCT p.image) AS positives, count(DISTINCT g.image) AS negatives,
  {r('avg(CASE WHEN p.score > g.score THEN 1.0 WHEN p.score = g.score THEN 0.5 ELSE 0.0 END)')} AS auroc
FROM test p JOIN test g USING (method, category) WHERE p.anomaly AND NOT g.anomaly GROUP BY ALL"""


def label_auroc(spark, sf):
    """Text length as a score for document quality: labels with a numeric score are a ranking too."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    rows = rows.select("lang", F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("anomaly"))
    return rounded(E.auroc(rows, ["lang"]))


QUERIES["label_auroc"] = label_auroc
ORACLE["label_auroc"] = f"""WITH t AS (SELECT lang, n_chars AS s, quality = 1 AS p FROM labels JOIN documents USING (doc_id)),
  steps AS (SELECT lang, s, count_if(p) AS tp, count_if(NOT p) AS fp FROM t GROUP BY ALL),
  sweep AS (SELECT *, sum(tp) OVER (PARTITION BY lang ORDER BY s DESC) AS tps FROM steps)
SELECT lang, CAST(sum(tp) AS BIGINT) AS positives, CAST(sum(fp) AS BIGINT) AS negatives,
  {r('sum(fp * (2 * tps - tp) / 2.0) / nullif(CAST(sum(tp) AS DOUBLE) * sum(fp), 0)')} AS auroc FROM sweep GROUP BY ALL"""


# Pixels: maps of the test images on 6x12 pixels; every anomaly has a 2x3 rectangle placed by its id,
# two of the four defects a second one. Scores are compared at 9 decimals in both engines.

def masks(spark, sf):
    row, col = F.floor(F.col("px") / OUT_WIDTH), F.pmod(F.col("px"), F.lit(OUT_WIDTH))
    y0, x0 = F.pmod(F.col("image"), F.lit(2)), F.pmod(F.col("image"), F.lit(5))
    first = row.between(y0, y0 + 1) & col.between(x0, x0 + 2)
    second = F.col("defect").isin("d6", "d9") & row.between(4, 5) & col.between(8, 9 + y0)
    px = images(spark, sf).where("anomaly").select(
        "category", "image", "defect", F.explode(F.sequence(F.lit(0), F.lit(OUT_HEIGHT * OUT_WIDTH - 1))).alias("px"))
    labels = px.select("category", "image", "px", F.when(first, 1).when(second, 2).otherwise(0).alias("region"))
    ordered = F.array_sort(F.collect_list(F.struct("px", "region")))
    return labels.groupBy("category", "image").agg(F.transform(ordered, lambda p: p["region"]).alias("regions"))


def test_arrays(spark, sf):
    return E.map_arrays(scored(spark, sf).where("split = 'test'"), ["category", "image", "defect"])


def pixels(spark, sf, support=None, arrays=None):
    arrays = test_arrays(spark, sf) if arrays is None else arrays
    return E.labelled_pixels(arrays, masks(spark, sf), ["category", "image"], HEIGHT, WIDTH, OUT_HEIGHT, OUT_WIDTH, support)


SQL_UP = SQL_SCORED + """,
  px AS (SELECT unnest(range(72)) AS px),
  src AS (SELECT px, px // 12 AS y, px % 12 AS x,
           least(greatest((px // 12 + 0.5::DOUBLE) * (2::DOUBLE / 6) - 0.5::DOUBLE, 0), 1) AS sy,
           least(greatest((px % 12 + 0.5::DOUBLE) * (4::DOUBLE / 12) - 0.5::DOUBLE, 0), 3) AS sx FROM px),
  grid AS (SELECT px, y, x, floor(sy)::INT AS y0, least(floor(sy) + 1, 1)::INT AS y1, sy - floor(sy) AS fy,
             floor(sx)::INT AS x0, least(floor(sx) + 1, 3)::INT AS x1, sx - floor(sx) AS fx FROM src),
  marr AS (SELECT category, image, defect, list(z ORDER BY cell) AS m FROM maps WHERE split = 'test' GROUP BY ALL),
  up AS (SELECT category, image, defect, px, y, x,
           (m[y0 * 4 + x0 + 1] * (1 - fx) + m[y0 * 4 + x1 + 1] * fx) * (1 - fy)
         + (m[y1 * 4 + x0 + 1] * (1 - fx) + m[y1 * 4 + x1 + 1] * fx) * fy AS score FROM marr, grid)"""


def sql_pixels(support="TRUE"):
    return SQL_UP + f""",
  lab AS (SELECT *, CASE WHEN defect = 'good' THEN 0
            WHEN y BETWEEN image % 2 AND image % 2 + 1 AND x BETWEEN image % 5 AND image % 5 + 2 THEN 1
            WHEN defect IN ('d6', 'd9') AND y BETWEEN 4 AND 5 AND x BETWEEN 8 AND 9 + image % 2 THEN 2 ELSE 0 END AS region
          FROM up WHERE {support}),
  area AS (SELECT image, region, count(*) AS a FROM lab WHERE region > 0 GROUP BY ALL),
  pixels AS (SELECT lab.*, coalesce(1.0::DOUBLE / a, 0) AS w FROM lab LEFT JOIN area USING (image, region))"""


def sql_metrics(keys, source):
    return f""",
  st AS (SELECT {keys}, score, count_if(region > 0) AS tp, count_if(region = 0) AS fp, sum(w) AS w FROM {source} GROUP BY ALL),
  run AS (SELECT *, sum(tp) OVER o AS tps, sum(fp) OVER o AS fps, sum(w) OVER o AS ws,
            sum(tp) OVER p AS tpt, sum(fp) OVER p AS fpt, sum(w) OVER p AS wt
          FROM st WINDOW o AS (PARTITION BY {keys} ORDER BY score DESC), p AS (PARTITION BY {keys})),
  seg AS (SELECT *, fps::DOUBLE / fpt AS x1, (fps - fp)::DOUBLE / fpt AS x0, ws / wt AS y1, (ws - w) / wt AS y0 FROM run),
  metrics AS (SELECT {keys}, CAST(round(max(wt)) AS BIGINT) AS regions, CAST(max(tpt) AS BIGINT) AS positive_pixels,
     CAST(max(fpt) AS BIGINT) AS negative_pixels,
     sum(fp * (2 * tps - tp) / 2.0::DOUBLE) / (max(tpt)::DOUBLE * max(fpt)) AS pixel_auroc,
     sum(CASE WHEN fp > 0 AND x0 < .3 THEN (least(x1, .3::DOUBLE) - x0)
       * (y0 + y0 + (y1 - y0) * ((least(x1, .3::DOUBLE) - x0) / (x1 - x0))) / 2 ELSE 0 END) / .3::DOUBLE AS aupro030
     FROM seg GROUP BY ALL)"""


def pixel_metrics(spark, sf):
    return rounded(E.localisation(pixels(spark, sf), ["category"]))


QUERIES["pixel_metrics"] = pixel_metrics
ORACLE["pixel_metrics"] = f"""WITH {sql_pixels()} {sql_metrics('category', 'pixels')}
SELECT category, regions, positive_pixels, negative_pixels, {r('pixel_auroc')} AS pixel_auroc, {r('aupro030')} AS aupro030
FROM metrics"""


def upsampled_maps(spark, sf):
    arrays = E.map_arrays(scored(spark, sf).where("split = 'test'"), ["category", "image"])
    return rounded(E.upsampled(arrays, HEIGHT, WIDTH, OUT_HEIGHT, OUT_WIDTH))


QUERIES["upsampled_maps"] = upsampled_maps
ORACLE["upsampled_maps"] = f"WITH {SQL_UP} SELECT category, image, CAST(px AS INTEGER) AS px, {r('score')} AS score FROM up"


def pro_curve(spark, sf):
    return rounded(E.pro_curve(pixels(spark, sf), ["category"]))


QUERIES["pro_curve"] = pro_curve
ORACLE["pro_curve"] = f"""WITH {sql_pixels()} {sql_metrics('category', 'pixels')},
  pts AS (SELECT CAST(unnest(range(301)) AS INTEGER) AS sample)
SELECT category, sample, {r('sample * .001::DOUBLE')} AS fpr,
  {r('y0 + (y1 - y0) * ((sample * .001::DOUBLE - x0) / (x1 - x0))')} AS pro
FROM seg JOIN pts ON fp > 0 AND sample * .001::DOUBLE >= x0 AND sample * .001::DOUBLE < x1"""


def pixel_metrics_by_defect(spark, sf):
    return rounded(E.localisation_by_defect(pixels(spark, sf), ["category"]))


QUERIES["pixel_metrics_by_defect"] = pixel_metrics_by_defect
ORACLE["pixel_metrics_by_defect"] = f"""WITH {sql_pixels()},
  kinds AS (SELECT DISTINCT category, defect FROM pixels WHERE defect <> 'good'),
  spread AS (SELECT category, defect, score, region, w FROM pixels WHERE defect <> 'good'
             UNION ALL SELECT p.category, k.defect, score, region, w FROM pixels p JOIN kinds k USING (category)
             WHERE p.defect = 'good') {sql_metrics('category, defect', 'spread')}
SELECT category, defect, regions, positive_pixels, negative_pixels, {r('pixel_auroc')} AS pixel_auroc,
  {r('aupro030')} AS aupro030 FROM metrics"""


def nominal_inner(px):
    """Pixels whose nominal cell is an inner column (the 2-row grid has no inner rows)."""
    return F.floor(F.pmod(px, F.lit(OUT_WIDTH)) / F.lit(OUT_WIDTH / WIDTH)).between(1, WIDTH - 2)


def strict_inner(px):
    """Pixels whose interpolation takes nothing from the first and last column."""
    at = (F.pmod(px, F.lit(OUT_WIDTH)) + 0.5) * F.lit(WIDTH / OUT_WIDTH) - 0.5
    return (at >= 1) & (at <= WIDTH - 2)


def pixel_metrics_by_support(spark, sf):
    out = kept(E.localisation_by_support(test_arrays(spark, sf), masks(spark, sf), ["category", "image"], HEIGHT, WIDTH, OUT_HEIGHT, OUT_WIDTH,
                                         {"full": None, "nominal": nominal_inner, "strict": strict_inner}, ["category"]), "by-support")
    full = out.where("support = 'full'").select("category", F.col("aupro030").alias("_full"))
    delta = F.abs(F.col("aupro030") - F.col("_full"))
    joined = out.join(full, "category").withColumn(
        "change", F.when(delta < 0.005, "MARGINAL").when(delta < 0.02, "MODERATE").otherwise("LARGE"))
    return rounded(joined.drop("_full"))


QUERIES["pixel_metrics_by_support"] = pixel_metrics_by_support
_supports = {"full": "TRUE", "nominal": "x // 3 BETWEEN 1 AND 2",
             "strict": "(x + 0.5) / 3 - 0.5 >= 1 AND (x + 0.5) / 3 - 0.5 <= 2"}
ORACLE["pixel_metrics_by_support"] = "WITH " + ", ".join(
    f"s_{n} AS (WITH {sql_pixels(s)} {sql_metrics('category', 'pixels')} SELECT '{n}' AS support, * FROM metrics)"
    for n, s in _supports.items()) + f""",
  a AS (SELECT * FROM s_full UNION ALL SELECT * FROM s_nominal UNION ALL SELECT * FROM s_strict)
SELECT a.category, a.regions, a.positive_pixels, a.negative_pixels, {r('a.pixel_auroc')} AS pixel_auroc,
  {r('a.aupro030')} AS aupro030, a.support, CASE WHEN abs(a.aupro030 - f.aupro030) < .005 THEN 'MARGINAL'
    WHEN abs(a.aupro030 - f.aupro030) < .02 THEN 'MODERATE' ELSE 'LARGE' END AS change
FROM a JOIN s_full f USING (category)"""


def method_results(spark, sf):
    """Image AUROC of all expected methods; one of them was never run."""
    metrics = E.auroc(test_scores(spark, sf), ["method", "category"]).select(
        "method", "category", F.col("auroc").alias("image_auroc"), F.lit(None).cast("string").alias("reason"))
    categories = images(spark, sf).select("category").distinct()
    return E.expected_results(categories, ["raw", "z", "other"], metrics, ["image_auroc"])


def expected_results(spark, sf):
    return rounded(method_results(spark, sf))


QUERIES["expected_results"] = expected_results
SQL_RESULTS = SQL_LONG + """,
  expected AS (SELECT m.method, c.category FROM (SELECT unnest(['raw', 'z', 'other']) AS method) m,
                 (SELECT DISTINCT category FROM scores) c),
  results AS (SELECT method, category, CASE WHEN auroc IS NULL THEN 'missing' ELSE 'verified' END AS status,
                auroc AS image_auroc, CASE WHEN auroc IS NULL THEN 'not measured' END AS reason
              FROM expected LEFT JOIN auc USING (method, category))"""
ORACLE["expected_results"] = f"""WITH {SQL_RESULTS}
SELECT method, category, status, {r('image_auroc')} AS image_auroc, reason FROM results"""


def macro_auroc(spark, sf):
    return rounded(E.macro(method_results(spark, sf), ["method"], ["image_auroc"]))


QUERIES["macro_auroc"] = macro_auroc
ORACLE["macro_auroc"] = f"""WITH {SQL_RESULTS}
SELECT method, count_if(status = 'verified') AS verified, count(*) AS expected, {r('avg(image_auroc)')} AS image_auroc
FROM results GROUP BY ALL"""


def macro_auroc_by_group(spark, sf):
    m = E.auroc(test_scores(spark, sf), ["method", "category"]).withColumn(
        "kind", F.when(F.col("category") == "c0", "texture").otherwise("object"))
    return rounded(E.macro_groups(m, ["method"], "kind", ["auroc"]))


QUERIES["macro_auroc_by_group"] = macro_auroc_by_group
ORACLE["macro_auroc_by_group"] = f"""WITH {SQL_LONG},
  g AS (SELECT method, unnest(['all', CASE category WHEN 'c0' THEN 'texture' ELSE 'object' END]) AS grp, auroc FROM auc)
SELECT method, grp, count(*) AS categories, {r('avg(auroc)')} AS auroc FROM g GROUP BY ALL"""


def macro_by_flag_and_nation(spark, sf):
    """Return flag as method, nation as category: every nation weighs the same whatever its order count."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_suppkey", "l_discount", "l_quantity")
    su = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    na = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    rows = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(na, F.col("s_nationkey") == F.col("n_nationkey"))
    per = rows.groupBy(F.col("l_returnflag").alias("method"), F.col("n_nationkey").alias("category"),
                       F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("kind")).agg(
        F.avg("l_discount").alias("discount"), F.avg("l_quantity").alias("quantity"))
    return rounded(E.macro_groups(per, ["method"], "kind", ["discount", "quantity"]))


QUERIES["macro_by_flag_and_nation"] = macro_by_flag_and_nation
ORACLE["macro_by_flag_and_nation"] = f"""WITH per AS (
  SELECT l_returnflag AS method, n_nationkey AS category, 'r' || n_regionkey AS kind, avg(l_discount) AS discount,
    avg(l_quantity) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
  g AS (SELECT method, unnest(['all', kind]) AS grp, discount, quantity FROM per)
SELECT method, grp, count(*) AS categories, {r('avg(discount)')} AS discount, {r('avg(quantity)')} AS quantity
FROM g GROUP BY ALL"""


# Diagnostics on the good images -----------------------------------------------------------------------------------

def good_ranking(spark, sf):
    """Places of the good test images by raw and by calibrated score, and the shift between them."""
    good = kept(image_table(scored(spark, sf)).where("split = 'test' AND NOT anomaly"), "good")
    by_raw = numbered(good, ["category"], [("raw_score", "desc"), ("image", "asc")], "rank_raw")
    both = numbered(by_raw, ["category"], [("score", "desc"), ("image", "asc")], "rank_z")
    return rounded(both.select("category", "image", "raw_score", "score", "rank_raw", "rank_z",
                               (F.col("rank_raw") - F.col("rank_z")).alias("rank_shift")))


QUERIES["good_ranking"] = good_ranking
ORACLE["good_ranking"] = f"""WITH {SQL_SCORED},
  k AS (SELECT category, image, raw_score, score,
    row_number() OVER (PARTITION BY category ORDER BY raw_score DESC, image) AS rank_raw,
    row_number() OVER (PARTITION BY category ORDER BY score DESC, image) AS rank_z
  FROM scores WHERE split = 'test' AND NOT anomaly)
SELECT category, image, {r('raw_score')} AS raw_score, {r('score')} AS score, rank_raw, rank_z,
  rank_raw - rank_z AS rank_shift FROM k"""


def cell_profile(spark, sf):
    """Mean, median and largest z per cell over the good test images, and how often the cell is the peak."""
    maps = kept(scored(spark, sf).where("split = 'test' AND NOT anomaly"), "maps")
    stats = describe(maps, ["category", "cell"], ["z"], [.5]).select("category", "cell", "n", "mean", F.col("p50").alias("median"), "max")
    peaks = M.map_summary(maps).groupBy("category", F.col("argmax").alias("cell")).agg(F.count(F.lit(1)).alias("peaks"))
    return rounded(stats.join(peaks, ["category", "cell"], "left").withColumn("peaks", F.coalesce("peaks", F.lit(0).cast("long"))))


QUERIES["cell_profile"] = cell_profile
ORACLE["cell_profile"] = f"""WITH {SQL_SCORED},
  g AS (SELECT * FROM maps WHERE split = 'test' AND NOT anomaly),
  p AS (SELECT category, image, first(cell ORDER BY z DESC, cell) AS cell FROM g GROUP BY ALL),
  k AS (SELECT category, cell, count(*) AS peaks FROM p GROUP BY ALL)
SELECT category, cell, count(*) AS n, {r('avg(z)')} AS mean, {r('median(z)')} AS median, {r('max(z)')} AS "max",
  coalesce(max(peaks), 0) AS peaks FROM g LEFT JOIN k USING (category, cell) GROUP BY ALL"""


def group_profile(spark, sf):
    """Calibrated scores of spatial groups of cells; a cell is in several groups."""
    maps = scored(spark, sf).where("split = 'test'").join(cell_groups(spark, HEIGHT, WIDTH), "cell")
    return rounded(maps.groupBy("category", "grp", "anomaly").agg(
        F.count(F.lit(1)).alias("cells"), F.avg("z").alias("mean_z"), F.max("z").alias("max_z"),
        F.count_if(F.col("z") > 3).alias("above3"), F.count_if(F.col("z") > 5).alias("above5"),
        F.count_if(F.col("z") > 10).alias("above10")))


QUERIES["group_profile"] = group_profile
ORACLE["group_profile"] = f"""WITH {SQL_SCORED},
  g AS (SELECT * , unnest(list_filter(['outer_border', CASE WHEN cell < 4 THEN 'top_row' END,
    CASE WHEN cell >= 4 THEN 'bottom_row' END, CASE WHEN cell % 4 = 0 THEN 'left_col' END,
    CASE WHEN cell % 4 = 3 THEN 'right_col' END], lambda v: v IS NOT NULL)) AS grp FROM maps WHERE split = 'test')
SELECT category, grp, anomaly, count(*) AS cells, {r('avg(z)')} AS mean_z, {r('max(z)')} AS max_z,
  count_if(z > 3) AS above3, count_if(z > 5) AS above5, count_if(z > 10) AS above10 FROM g GROUP BY ALL"""


def loss_recovered(spark, sf):
    """Image ranking with all cells and without the outer columns: ordered pairs, loss recovered, peaks removed."""
    inner = F.pmod(F.col("cell"), F.lit(WIDTH)).between(1, WIDTH - 2)
    maps = scored(spark, sf).where("split = 'test'")
    per = maps.groupBy("category", "image", "defect", "anomaly").agg(
        F.max("z").alias("full"), F.max(F.when(inner, F.col("z"))).alias("inner"),
        (-F.max(F.struct("z", (-F.col("cell")).alias("c")))["c"]).alias("peak"))
    per = kept(per, "per-image")
    full = E.auroc(per, ["category"], "full").withColumnRenamed("auroc", "full")
    small = E.auroc(per, ["category"], "inner").select("category", F.col("auroc").alias("inner"))
    gone = per.groupBy("category").agg(
        F.count_if(~F.pmod(F.col("peak"), F.lit(WIDTH)).between(1, WIDTH - 2)).alias("peaks_removed"))
    pairs = F.col("positives") * F.col("negatives")
    right = lambda c: F.round(F.col(c) * pairs).cast("long")
    return rounded(full.join(small, "category").join(gone, "category").select(
        "category", "full", "inner", pairs.alias("pairs"), right("full").alias("correct_full"),
        right("inner").alias("correct_inner"), (right("inner") - right("full")).alias("loss_recovered"), "peaks_removed"))


QUERIES["loss_recovered"] = loss_recovered
ORACLE["loss_recovered"] = f"""WITH {SQL_SCORED},
  per AS (SELECT category, image, anomaly, max(z) AS f, max(z) FILTER (cell % 4 IN (1, 2)) AS i,
    first(cell ORDER BY z DESC, cell) AS peak FROM maps WHERE split = 'test' GROUP BY ALL),
  a AS (SELECT p.category, avg(CASE WHEN p.f > g.f THEN 1.0 WHEN p.f = g.f THEN .5 ELSE 0 END) AS f,
    avg(CASE WHEN p.i > g.i THEN 1.0 WHEN p.i = g.i THEN .5 ELSE 0 END) AS i, count(*) AS pairs
    FROM per p JOIN per g USING (category) WHERE p.anomaly AND NOT g.anomaly GROUP BY ALL),
  gone AS (SELECT category, count_if(peak % 4 IN (0, 3)) AS peaks_removed FROM per GROUP BY ALL)
SELECT category, {r('f')} AS "full", {r('i')} AS "inner", pairs, CAST(round(f * pairs) AS BIGINT) AS correct_full,
  CAST(round(i * pairs) AS BIGINT) AS correct_inner,
  CAST(round(i * pairs) AS BIGINT) - CAST(round(f * pairs) AS BIGINT) AS loss_recovered, peaks_removed
FROM a JOIN gone USING (category)"""


def score_correlation(spark, sf):
    """Pearson of raw and calibrated peak, and of calibrated peak and the deviation at it; null when constant."""
    maps = scored(spark, sf).where("split = 'test'")
    per = image_table(maps)
    return rounded(per.groupBy("category", "anomaly").agg(
        pearson("score", "raw_score").alias("pearson"),
        F.count(F.lit(1)).alias("n")))


QUERIES["score_correlation"] = score_correlation
ORACLE["score_correlation"] = f"""WITH {SQL_SCORED}
SELECT category, anomaly, CASE WHEN stddev_pop(score) > 0 AND stddev_pop(raw_score) > 0
  THEN {r('corr(score, raw_score)')} END AS pearson, count(*) AS n FROM scores WHERE split = 'test' GROUP BY ALL"""


def diagnosis(spark, sf):
    """Whether poor separation comes from the raw score or from the calibration, from fixed thresholds."""
    per = kept(image_table(scored(spark, sf)).where("split = 'test'"), "per-image")
    z = E.auroc(per, ["category"], "score").select("category", F.col("auroc").alias("z"))
    raw = E.auroc(per, ["category"], "raw_score").select("category", F.col("auroc").alias("raw"))
    tie = per.where("NOT anomaly").groupBy("category").agg(pearson("score", "raw_score").alias("pearson"))
    poor, harmless = F.col("raw") < 0.80, F.col("z") >= F.col("raw") - 0.02
    label = (F.when(poor & harmless & (F.col("pearson") < -0.30), "MIXED").when(poor & harmless, "RAW_DRIVEN")
             .when(F.col("z") - F.col("raw") < -0.12, "Z_AMPLIFIED").otherwise("INCONCLUSIVE"))
    return rounded(z.join(raw, "category").join(tie, "category").withColumn("label", label))


QUERIES["diagnosis"] = diagnosis
ORACLE["diagnosis"] = f"""WITH {SQL_LONG},
  p AS (SELECT category, corr(score, raw_score) AS pearson FROM scores WHERE split = 'test' AND NOT anomaly GROUP BY ALL),
  a AS (SELECT z.category, z.auroc AS z, w.auroc AS raw, pearson FROM auc z JOIN auc w USING (category)
        JOIN p USING (category) WHERE z.method = 'z' AND w.method = 'raw')
SELECT category, {r('z')} AS z, {r('raw')} AS raw, {r('pearson')} AS pearson,
  CASE WHEN raw < .8 AND z >= raw - .02 AND pearson < -.3 THEN 'MIXED' WHEN raw < .8 AND z >= raw - .02 THEN 'RAW_DRIVEN'
    WHEN z - raw < -.12 THEN 'Z_AMPLIFIED' ELSE 'INCONCLUSIVE' END AS label FROM a"""


def foreground_above(spark, sf):
    """Pixels above z = 3 inside and outside the annotated regions, good and anomalous images apart."""
    p = pixels(spark, sf)
    return rounded(p.groupBy("category", (F.col("defect") == "good").alias("good"), F.col("hit").alias("foreground")).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("score") > 3).alias("above3"),
        F.avg("score").alias("mean_score"), F.sum(F.greatest("score", F.lit(0.0))).alias("positive_mass")), 5)


QUERIES["foreground_above"] = foreground_above
ORACLE["foreground_above"] = f"""WITH {sql_pixels()}
SELECT category, defect = 'good' AS good, region > 0 AS foreground, count(*) AS pixels, count_if(score > 3) AS above3,
  {r('avg(score)', 5)} AS mean_score, {r('sum(greatest(score, 0))', 5)} AS positive_mass FROM pixels GROUP BY ALL"""


def extreme_quarter_maps(spark, sf):
    """Mean map of the lowest and of the highest quarter of the good images by score, and the difference."""
    maps = kept(scored(spark, sf).where("split = 'test' AND NOT anomaly"), "maps")
    placed = numbered(M.image_scores(maps), ["category"], [("score", "asc"), ("image", "asc")])
    quarter = placed.groupBy("category").agg(F.greatest(F.floor(F.count(F.lit(1)) / 4), F.lit(1)).alias("k"),
                                             F.count(F.lit(1)).alias("n"))
    sides = placed.join(quarter, "category").select(
        "category", "image", F.when(F.col("position") <= F.col("k"), "low").when(
            F.col("position") > F.col("n") - F.col("k"), "high").alias("side")).where("side IS NOT NULL")
    mean = maps.join(sides, ["category", "image"]).groupBy("category", "cell").agg(
        F.avg(F.when(F.col("side") == "low", F.col("z"))).alias("low"),
        F.avg(F.when(F.col("side") == "high", F.col("z"))).alias("high"))
    return rounded(mean.withColumn("difference", F.col("high") - F.col("low")))


QUERIES["extreme_quarter_maps"] = extreme_quarter_maps
ORACLE["extreme_quarter_maps"] = f"""WITH {SQL_SCORED},
  o AS (SELECT category, image, row_number() OVER (PARTITION BY category ORDER BY score, image) AS pos,
    count(*) OVER (PARTITION BY category) AS n FROM scores WHERE split = 'test' AND NOT anomaly),
  s AS (SELECT category, image, CASE WHEN pos <= greatest(n // 4, 1) THEN 'low'
    WHEN pos > n - greatest(n // 4, 1) THEN 'high' END AS side FROM o)
SELECT category, cell, {r("avg(z) FILTER (side = 'low')")} AS low, {r("avg(z) FILTER (side = 'high')")} AS high,
  {r("avg(z) FILTER (side = 'high') - avg(z) FILTER (side = 'low')")} AS difference
FROM maps JOIN s USING (category, image) WHERE side IS NOT NULL GROUP BY ALL"""
