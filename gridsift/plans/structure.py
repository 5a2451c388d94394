"""Queries: correspondence, coherence, variance decomposition, projections and the models built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.functions import vectors as V
from gridsift.operators import correspondence as C
from gridsift.operators import evaluate as E
from gridsift.operators import moments as M
from gridsift.operators import projection as P
from gridsift.operators.describe import describe
from gridsift.operators.ordered import numbered
from gridsift.plans import evaluation as EV
from gridsift.plans.views import (CHANNELS, HEIGHT, SQL_MODEL, SQL_UNITS, WIDTH, features, fitted, images,
                                  r, rounded, units)
from gridsift.session import kept

QUERIES, ORACLE = {}, {}

SEED, DIMENSIONS = 42, 32
SIGNS = P.signs(SEED, CHANNELS, DIMENSIONS)

# Correspondence --------------------------------------------------------------------------------------------------------

SQL_MATCH = SQL_MODEL + """,
  pairs AS (SELECT a.cell, b.cell AS reference, m.mode FROM (SELECT unnest(range(8)) AS cell) a,
     (SELECT unnest(range(8)) AS cell) b, (SELECT unnest(['N1', 'G']) AS mode) m
     WHERE m.mode = 'G' OR (abs(a.cell // 4 - b.cell // 4) <= 1 AND abs(a.cell % 4 - b.cell % 4) <= 1)),
  dist AS (SELECT p.mode, l.category, l.image, l.split, l.cell, p.reference,
      avg(((v - mean) / std) * ((v - mean) / std)) AS d
    FROM long l JOIN pairs p USING (cell) JOIN model m ON m.category = l.category AND m.cell = p.reference AND m.ch = l.ch
    GROUP BY ALL),
  matched AS (SELECT mode, category, image, split, cell, min(d) AS raw,
      CAST(first(reference ORDER BY d, reference) AS INTEGER) AS reference FROM dist GROUP BY ALL)"""


def matched(spark, sf):
    """Images are read as rows that hold their whole grid, so descriptors are not shuffled."""
    _, model, _ = fitted(spark, sf)
    pack = kept(C.packed(model, ["mean", "std"]), "packed")
    grid = images(spark, sf).select("category", "image", "split", "anomaly", F.col("embedding").alias("grid"))
    return C.correspondence_maps(grid, pack, HEIGHT, WIDTH, normalise=True)


def correspondence_maps(spark, sf):
    return rounded(matched(spark, sf).select("mode", "category", "image", "cell", "raw", "reference"))


QUERIES["correspondence_maps"] = correspondence_maps
ORACLE["correspondence_maps"] = f"""WITH {SQL_MATCH}
SELECT mode, category, image, cell, {r('raw')} AS raw, reference FROM matched"""


def correspondence_summary(spark, sf):
    return rounded(C.match_summary(matched(spark, sf), ["mode", "category", "split"], WIDTH))


QUERIES["correspondence_summary"] = correspondence_summary
ORACLE["correspondence_summary"] = f"""WITH {SQL_MATCH}
SELECT mode, category, split, {r('avg(CAST(reference = cell AS INT))')} AS same_position,
  {r('avg(sqrt((cell // 4 - reference // 4) ** 2 + (cell % 4 - reference % 4) ** 2))')} AS displacement
FROM matched GROUP BY ALL"""


def correspondence_scores(spark, sf):
    """Each mode is calibrated on its own held-out maps."""
    maps = kept(matched(spark, sf), "matched")
    calibration = kept(M.position_calibration(maps.where("split = 'calibration'"), ["mode", "category", "cell"]), "calibration")
    z = M.calibrated(maps, calibration, ["mode", "category", "cell"])
    return rounded(M.image_scores(z, ["mode", "category", "image"]))


QUERIES["correspondence_scores"] = correspondence_scores
ORACLE["correspondence_scores"] = f"""WITH {SQL_MATCH},
  k AS (SELECT mode, category, cell, avg(raw) AS alpha, greatest(stddev_samp(raw), 1e-6) AS beta
        FROM matched WHERE split = 'calibration' GROUP BY ALL)
SELECT mode, category, image, {r('max((raw - alpha) / beta)')} AS score
FROM matched JOIN k USING (mode, category, cell) GROUP BY ALL"""


# Coherence -------------------------------------------------------------------------------------------------------------

def position_coherence(spark, sf):
    model = M.position_model(units(spark, sf).where("split = 'fit'"))
    return rounded(C.coherence(model))


QUERIES["position_coherence"] = position_coherence
ORACLE["position_coherence"] = f"""WITH {SQL_MODEL}
SELECT category, cell, n, {r('(n * sum(mean * mean) - 1) / (n - 1)')} AS cosine_mean,
  {r('1 - sum(mean * mean)')} AS dispersion, {r('avg(std_sample * std_sample)')} AS channel_variance,
  CAST(count_if(std_sample <= 1e-6) AS INTEGER) AS low_1e6, CAST(count_if(std_sample <= 1e-5) AS INTEGER) AS low_1e5,
  CAST(count_if(std_sample <= 1e-4) AS INTEGER) AS low_1e4, CAST(count_if(std_sample <= 1e-3) AS INTEGER) AS low_001
FROM model GROUP BY category, cell, n"""


def coherence_summary(spark, sf):
    model = M.position_model(units(spark, sf).where("split = 'fit'"))
    return rounded(describe(C.coherence(model), ["category"], ["cosine_mean", "dispersion", "channel_variance"],
                            [.25, .5, .75, .9, .95]))


QUERIES["coherence_summary"] = coherence_summary
ORACLE["coherence_summary"] = f"""WITH {SQL_MODEL},
  c AS (SELECT category, cell, (n * sum(mean * mean) - 1) / (n - 1) AS a, 1 - sum(mean * mean) AS b,
     avg(std_sample * std_sample) AS c FROM model GROUP BY category, cell, n),
  f AS (SELECT category, 'cosine_mean' AS field, a AS v FROM c UNION ALL SELECT category, 'dispersion', b FROM c
        UNION ALL SELECT category, 'channel_variance', c FROM c)
SELECT category, field, count(*) AS n, {r('min(v)')} AS "min", {r('max(v)')} AS "max", {r('avg(v)')} AS mean,
  {r('quantile_cont(v, .25)')} AS p25, {r('quantile_cont(v, .5)')} AS p50, {r('quantile_cont(v, .75)')} AS p75,
  {r('quantile_cont(v, .9)')} AS p90, {r('quantile_cont(v, .95)')} AS p95 FROM f GROUP BY ALL"""


def mean_pair_cosine(spark, sf):
    """Mean cosine over all pairs of FIT images per position; the twin forms the pairs, the query does not."""
    model = M.position_model(units(spark, sf).where("split = 'fit'"))
    return rounded(C.coherence(model).select("category", "cell", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"),
                                             "cosine_mean"))


QUERIES["mean_pair_cosine"] = mean_pair_cosine
ORACLE["mean_pair_cosine"] = f"""WITH {SQL_UNITS}, f AS (SELECT * FROM units WHERE split = 'fit')
SELECT a.category, a.cell, count(*) AS pairs,
  {r('avg(list_inner_product(a.u, b.u))')} AS cosine_mean
FROM f a JOIN f b ON a.category = b.category AND a.cell = b.cell AND a.image < b.image GROUP BY ALL"""


def neighbour_contrast(spark, sf):
    grid = C.grids(units(spark, sf), ["category", "image", "split"])
    c = grid.withColumn("_c", C.neighbour_contrast(HEIGHT, WIDTH)("grid"))
    return rounded(c.groupBy("category", "split").agg(F.sum("_c.edges").alias("edges"),
                                                      (F.sum("_c.total") / F.sum("_c.edges")).alias("contrast")))


QUERIES["neighbour_contrast"] = neighbour_contrast
ORACLE["neighbour_contrast"] = f"""WITH {SQL_UNITS}
SELECT a.category, a.split, count(*) // 8 AS edges, {r('sum((a.v - b.v) * (a.v - b.v)) / (count(*) / 8)')} AS contrast
FROM long a JOIN long b ON a.category = b.category AND a.image = b.image AND a.ch = b.ch
  AND ((b.cell = a.cell + 1 AND a.cell % 4 < 3) OR b.cell = a.cell + 4) GROUP BY ALL"""


def square_units(spark, sf):
    """The same vectors as a 4x4 grid of 4 channels, which has inner cells."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(F.col("embedding"), i * 4 + 1, 4))
    return M.units(images(spark, sf).where("split = 'fit'").select("category", "image", F.posexplode(cells).alias("cell", "x")))


def template_drift(spark, sf):
    u = square_units(spark, sf)
    model = kept(C.packed(M.channel_moments(u, ["category", "cell"]).withColumn(
        "sums", F.transform("mean", lambda m: m * F.col("n"))), ["sums"]), "sums")
    grid = C.grids(u, ["category", "image"])
    joined = grid.join(model, "category").withColumn("_l", C.held_out_template(4, 4)("grid", "sums"))
    drift = joined.select("category", "image", F.explode("_l").alias("_l")).select("category", "image", "_l.*")
    return rounded(C.drift_summary(drift, ["category"], 4))


QUERIES["template_drift"] = template_drift
ORACLE["template_drift"] = f"""WITH f AS (
  SELECT 'c' || (label % 2) AS category, vec_id AS image, c.cell,
    CAST(list_slice(embedding, c.cell * 4 + 1, c.cell * 4 + 4) AS DOUBLE[]) AS x
  FROM embeddings, (SELECT unnest(range(16)) AS cell) c WHERE label < 2),
  u AS (SELECT category, image, cell, list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda w: w * w)))) AS u FROM f),
  l AS (SELECT category, image, cell, unnest(u) AS v, generate_subscripts(u, 1) AS ch FROM u),
  t AS (SELECT category, image, cell, ch, v, sum(v) OVER (PARTITION BY category, cell, ch) - v AS w FROM l),
  n AS (SELECT category, image, cell, sqrt(sum(w * w)) AS nrm FROM t GROUP BY ALL),
  inner_cells AS (SELECT unnest([5, 6, 9, 10]) AS p),
  nb AS (SELECT p, p + dr * 4 + dc AS q FROM inner_cells, (SELECT unnest([-1, 0, 1]) AS dr) a, (SELECT unnest([-1, 0, 1]) AS dc) b),
  cs AS (SELECT a.category, a.image, p, q, sum(a.v * b.w) / any_value(n.nrm) AS c FROM nb
    JOIN t a ON a.cell = p JOIN t b ON b.cell = q AND b.category = a.category AND b.image = a.image AND b.ch = a.ch
    JOIN n ON n.cell = q AND n.category = a.category AND n.image = a.image GROUP BY ALL),
  best AS (SELECT category, image, p, max(c) AS best, max(c) FILTER (p = q) AS own,
      first(q ORDER BY c DESC, CASE WHEN p = q THEN -1 ELSE q END) AS bq FROM cs GROUP BY ALL)
SELECT category, count(*) AS cells, {r('avg(sqrt((bq % 4 - p % 4) ** 2 + (bq // 4 - p // 4) ** 2))')} AS drift,
  {r('avg(CAST(bq = p AS INT))')} AS same_cell, {r('avg(best - own)')} AS gain FROM best GROUP BY ALL"""


SQL_POOLED = SQL_MODEL + """,
  pooled AS (SELECT category, ch, count(*) AS n_all, avg(v) AS m_all, var_samp(v) AS v_all
             FROM long WHERE split = 'fit' GROUP BY ALL)"""


def both_moments(spark, sf):
    u = units(spark, sf).where("split = 'fit'")
    return kept(M.channel_moments(u, ["category", "cell"]), "position"), kept(M.channel_moments(u, ["category"]), "pooled")


def variance_shares(spark, sf):
    return rounded(C.variance_shares(*both_moments(spark, sf)))


QUERIES["variance_shares"] = variance_shares
ORACLE["variance_shares"] = f"""WITH {SQL_POOLED},
  s AS (SELECT category, ch, (n_all - 1) * v_all AS total, sum((n - 1) * std_sample * std_sample) AS within,
     sum(n * (mean - m_all) * (mean - m_all)) AS between_ FROM model JOIN pooled USING (category, ch)
     GROUP BY category, ch, n_all, v_all)
SELECT category, CAST(ch - 1 AS INTEGER) AS channel, {r('total')} AS total, {r('within')} AS within,
  {r('between_')} AS "between", {r('between_ / total')} AS share, {r('abs(total - within - between_)')} AS residual FROM s"""


def position_offsets(spark, sf):
    return rounded(C.position_offsets(*both_moments(spark, sf)))


QUERIES["position_offsets"] = position_offsets
ORACLE["position_offsets"] = f"""WITH {SQL_POOLED},
  o AS (SELECT category, cell, sqrt(sum((mean - m_all) * (mean - m_all) / v_all)) AS offset_norm,
     avg(std_sample / sqrt(v_all)) AS std_ratio FROM model JOIN pooled USING (category, ch) GROUP BY ALL),
  l AS (SELECT category, greatest(quantile_cont(offset_norm, .1), .05) AS lim FROM o GROUP BY ALL)
SELECT category, cell, {r('offset_norm')} AS offset_norm, {r('std_ratio')} AS std_ratio, {r('lim')} AS "limit",
  offset_norm < lim AS flagged FROM o JOIN l USING (category)"""


def positions_by_offset(spark, sf):
    """Positions of each category from the least to the largest offset, with their place."""
    offsets = kept(C.position_offsets(*both_moments(spark, sf)).select("category", "cell", "offset_norm", "flagged"), "offsets")
    return rounded(numbered(offsets, ["category"], [("offset_norm", "asc"), ("cell", "asc")], "place"))


QUERIES["positions_by_offset"] = positions_by_offset
ORACLE["positions_by_offset"] = ORACLE["position_offsets"].rsplit("SELECT category, cell,", 1)[0] + f"""SELECT category, cell, {r('offset_norm')} AS offset_norm,
  offset_norm < lim AS flagged, row_number() OVER (PARTITION BY category ORDER BY offset_norm, cell) AS place FROM o JOIN l USING (category)"""


# Projections -----------------------------------------------------------------------------------------------------------

SQL_SIGNS = f"""lcg(k, s) AS (
    SELECT 0, CAST(xor({SEED}, 25214903917) AS HUGEINT)
    UNION ALL SELECT k + 1, (s * 25214903917 + 11) % 281474976710656 FROM lcg WHERE k < {CHANNELS * DIMENSIONS}),
  signs AS (SELECT (k - 1) // {DIMENSIONS} + 1 AS ch, (k - 1) % {DIMENSIONS} AS d,
     CASE WHEN s >= 140737488355328 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn FROM lcg WHERE k > 0)"""

SQL_PROJECTED = f"WITH RECURSIVE {SQL_SIGNS}, {SQL_UNITS}" + f""",
  y AS (SELECT category, image, split, anomaly, cell, d, sum(sgn * v) / sqrt({DIMENSIONS}) AS y
        FROM long JOIN signs USING (ch) GROUP BY ALL)"""

SQL_FILTERS = SQL_PROJECTED + f""",
  ps AS (SELECT category, d, count(*) AS n, avg(y) AS mu, greatest(stddev_samp(y), 1e-6) AS sd
         FROM y WHERE split = 'fit' GROUP BY ALL),
  asum AS (SELECT category, cell, d, count(*) AS n, sum((y - mu) / sd) AS a FROM y JOIN ps USING (category, d)
           WHERE split = 'fit' GROUP BY ALL),
  anorm AS (SELECT category, cell, sqrt(sum(a * a)) AS l FROM asum GROUP BY ALL),
  arch AS (SELECT category, cell, d, asum.n, a / l AS a FROM asum JOIN anorm USING (category, cell))"""


def clamped_units(spark, sf):
    f = features(spark, sf)
    return f.withColumn("u", V.unit_clamped("x", F.lit(P.NORM_EPSILON))).drop("x")


def projection_memory(spark, sf):
    """Statistics, archetypes and compiled filters from channel sums and cross products of the FIT descriptors."""
    u = clamped_units(spark, sf)
    fit = u.where("split = 'fit'")
    statistics = kept(P.projection_statistics(P.cross_products(fit, ["category"]), SIGNS), "statistics")
    bank = kept(P.archetypes(M.channel_moments(fit, ["category", "cell"]), statistics, SIGNS), "archetypes")
    filters = kept(P.compiled_filters(bank, statistics, SIGNS), "filters")
    return u, statistics, bank, filters


def projected_descriptors(spark, sf):
    y = clamped_units(spark, sf).withColumn("y", P.projected(SIGNS)("u"))
    return rounded(y.select("category", "image", "cell", F.posexplode("y").alias("d", "y")))


QUERIES["projected_descriptors"] = projected_descriptors
ORACLE["projected_descriptors"] = f"""{SQL_PROJECTED}
SELECT category, image, cell, CAST(d AS INTEGER) AS d, {r('y')} AS y FROM y"""


def projection_statistics(spark, sf):
    fit = clamped_units(spark, sf).where("split = 'fit'")
    s = P.projection_statistics(P.cross_products(fit, ["category"]), SIGNS)
    return rounded(s.select("category", "n", F.posexplode(F.arrays_zip("mean", "std")).alias("d", "_m")).select(
        "category", "n", "d", "_m.mean", "_m.std"))


QUERIES["projection_statistics"] = projection_statistics
ORACLE["projection_statistics"] = f"""{SQL_FILTERS}
SELECT category, n, CAST(d AS INTEGER) AS d, {r('mu')} AS mean, {r('sd')} AS std FROM ps"""


def archetypes(spark, sf):
    _, _, bank, _ = projection_memory(spark, sf)
    return rounded(bank.select("category", "cell", "n", F.posexplode("a").alias("d", "a")))


QUERIES["archetypes"] = archetypes
ORACLE["archetypes"] = f"""{SQL_FILTERS} SELECT category, cell, n, CAST(d AS INTEGER) AS d, {r('a')} AS a FROM arch"""


def compiled_filters(spark, sf):
    _, _, _, filters = projection_memory(spark, sf)
    return rounded(filters.select("category", "cell", F.posexplode("w").alias("channel", "w"), "b"))


QUERIES["compiled_filters"] = compiled_filters
ORACLE["compiled_filters"] = f"""{SQL_FILTERS},
  bias AS (SELECT category, cell, -sum(mu * a / sd) AS b FROM arch JOIN ps USING (category, d) GROUP BY ALL)
SELECT category, cell, CAST(ch - 1 AS INTEGER) AS channel, {r(f'sum(sgn * a / sd) / sqrt({DIMENSIONS})')} AS w,
  {r('any_value(b)')} AS b
FROM arch JOIN ps USING (category, d) JOIN signs USING (d) JOIN bias USING (category, cell) GROUP BY category, cell, ch"""


def filter_maps(spark, sf):
    """Compiled scores; the twin projects every descriptor explicitly."""
    u, _, _, filters = projection_memory(spark, sf)
    return rounded(P.filter_maps(u, filters).select("category", "image", "cell", "raw"))


QUERIES["filter_maps"] = filter_maps
SQL_EXPLICIT = SQL_FILTERS + """,
  m0 AS (SELECT category, image, split, anomaly, cell, 1 - sum(a * (y - mu) / sd) AS raw
         FROM y JOIN ps USING (category, d) JOIN arch USING (category, cell, d) GROUP BY ALL)"""
ORACLE["filter_maps"] = f"{SQL_EXPLICIT} SELECT category, image, cell, {r('raw')} AS raw FROM m0"


def explicit_maps(spark, sf):
    u, statistics, bank, _ = projection_memory(spark, sf)
    return rounded(P.explicit_maps(u, bank, statistics, SIGNS).select("category", "image", "cell", "raw"))


QUERIES["explicit_maps"] = explicit_maps
ORACLE["explicit_maps"] = ORACLE["filter_maps"]


def packed_signs(spark, sf):
    """Signs of descriptors against the sign matrix by words: per position and dimension the sum, the best and the number of ties."""
    words = features(spark, sf).select("category", "split", "cell", P.sign_words("x", CHANNELS).alias("w"))
    products = words.select("category", "split", "cell", F.posexplode(P.sign_products("w", P.packed_signs(SIGNS), CHANNELS)).alias("d", "y"))
    return products.groupBy("category", "split", "cell", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.max("y").alias("highest"), F.count_if(F.col("y") == 0).alias("ties"))


QUERIES["packed_signs"] = packed_signs
ORACLE["packed_signs"] = f"""{SQL_PROJECTED.split('  y AS (SELECT')[0]}
  y AS (SELECT category, image, split, cell, d, CAST(sum(sgn * CASE WHEN v < 0 THEN -1 ELSE 1 END) AS BIGINT) AS y FROM long JOIN signs USING (ch) GROUP BY ALL)
SELECT category, split, cell, CAST(d AS INTEGER) AS d, count(*) AS n, CAST(sum(y) AS BIGINT) AS total, CAST(max(y) AS INTEGER) AS highest, count_if(y = 0) AS ties
FROM y GROUP BY ALL"""


def isometry_report(spark, sf):
    return rounded(P.isometry_report(features(spark, sf), ["category", "split"], SIGNS))


QUERIES["isometry_report"] = isometry_report
ORACLE["isometry_report"] = f"""{SQL_PROJECTED},
  rho AS (SELECT category, split, image, cell, sqrt(sum(y * y)) AS rho FROM y GROUP BY ALL)
SELECT category, split, count(*) AS used, CAST(0 AS BIGINT) AS excluded, {r('avg(rho)')} AS mean_ratio,
  {r('quantile_disc(abs(rho - 1), .99)')} AS p99_error, {r('max(abs(rho - 1))')} AS max_error FROM rho GROUP BY ALL"""


SQL_CENTROID = SQL_PROJECTED + """,
  mo AS (SELECT category, cell, ch, avg(v) AS mean FROM long WHERE split = 'fit' GROUP BY ALL),
  ml AS (SELECT category, cell, sqrt(sum(mean * mean)) AS l FROM mo GROUP BY ALL),
  my AS (SELECT category, cell, d, avg(y) AS my FROM y WHERE split = 'fit' GROUP BY ALL),
  myl AS (SELECT category, cell, sqrt(sum(my * my)) AS l FROM my GROUP BY ALL),
  c1 AS (SELECT category, image, split, anomaly, cell, 1 - sum(v * mean) / any_value(l) AS raw
    FROM long JOIN mo USING (category, cell, ch) JOIN ml USING (category, cell) GROUP BY ALL),
  v1 AS (SELECT category, image, split, anomaly, cell, 1 - sum(y * my) / any_value(l) / sqrt(sum(y * y)) AS raw
    FROM y JOIN my USING (category, cell, d) JOIN myl USING (category, cell) GROUP BY ALL),
  cv AS (SELECT 'c1' AS method, * FROM c1 UNION ALL SELECT 'v1', * FROM v1)"""


def centroid_scores(spark, sf):
    u = units(spark, sf)
    model = kept(P.centroid_model(M.channel_moments(u.where("split = 'fit'"), ["category", "cell"]), SIGNS), "centroids")
    return u, P.centroid_maps(u, model, SIGNS)


def centroid_maps(spark, sf):
    return rounded(centroid_scores(spark, sf)[1].select("method", "category", "image", "cell", "raw"))


QUERIES["centroid_maps"] = centroid_maps
ORACLE["centroid_maps"] = f"{SQL_CENTROID} SELECT method, category, image, cell, {r('raw')} AS raw FROM cv"

SQL_DISPERSION = SQL_PROJECTED + """,
  pd AS (SELECT category, cell, d, avg(y) AS mu, greatest(stddev_samp(y), 1e-6) AS sd FROM y WHERE split = 'fit' GROUP BY ALL),
  m3 AS (SELECT category, image, split, anomaly, cell, avg(((y - mu) / sd) * ((y - mu) / sd)) AS raw
         FROM y JOIN pd USING (category, cell, d) GROUP BY ALL)"""


def dispersion_scores(spark, sf):
    u = units(spark, sf)
    model = kept(P.dispersion_model(P.cross_products(u.where("split = 'fit'"), ["category", "cell"]), SIGNS), "forms")
    return P.dispersion_maps(u, model)


def dispersion_maps(spark, sf):
    return rounded(dispersion_scores(spark, sf).select("category", "image", "cell", "raw"))


QUERIES["dispersion_maps"] = dispersion_maps
ORACLE["dispersion_maps"] = f"{SQL_DISPERSION} SELECT category, image, cell, {r('raw')} AS raw FROM m3"


def method_maps(spark, sf):
    """Raw maps of five methods in one long table: every model joined once, descriptors read once."""
    _, _, _, filters = projection_memory(spark, sf)
    u = units(spark, sf).where("split = 'fit'")
    moments = kept(M.position_model(u), "model")
    centroids = P.centroid_model(moments, SIGNS)
    forms = P.dispersion_model(P.cross_products(u, ["category", "cell"]), SIGNS)
    wide = moments.select("category", "cell", "mean", "std")
    for table_ in (filters, centroids, forms):
        wide = wide.join(table_, ["category", "cell"])
    return P.all_methods(features(spark, sf), kept(wide, "methods"), SIGNS)


def method_comparison(spark, sf):
    """Image AUROC of every method and category, raw and calibrated."""
    maps = kept(method_maps(spark, sf), "method-maps")
    keys = ["method", "category", "cell"]
    calibration = kept(M.position_calibration(maps.where("split = 'calibration'"), keys), "calibration")
    z = M.calibrated(maps.where("split = 'test'"), calibration, keys)
    per = z.groupBy("method", "category", "image", "anomaly").agg(F.max("raw").alias("raw"), F.max("z").alias("z"))
    both = per.select("method", "category", "anomaly", F.explode(F.array(
        F.struct(F.lit("raw").alias("kind"), F.col("raw").alias("score")),
        F.struct(F.lit("z").alias("kind"), F.col("z").alias("score")))).alias("_s")).select(
        "method", "category", "anomaly", "_s.kind", "_s.score")
    return rounded(E.auroc(both, ["method", "kind", "category"]))


QUERIES["method_comparison"] = method_comparison
_EVERY = (SQL_EXPLICIT + SQL_CENTROID[len(SQL_PROJECTED):] + SQL_DISPERSION[len(SQL_PROJECTED):] + """,
  pm AS (SELECT category, cell, ch, avg(v) AS mean, greatest(stddev_samp(v), 1e-6) AS std FROM long WHERE split = 'fit' GROUP BY ALL),
  m2 AS (SELECT category, image, split, anomaly, cell, avg(((v - mean) / std) * ((v - mean) / std)) AS raw
         FROM long JOIN pm USING (category, cell, ch) GROUP BY ALL),
  every AS (SELECT 'm0' AS method, * FROM m0 UNION ALL SELECT * FROM cv UNION ALL SELECT 'm2', * FROM m2
            UNION ALL SELECT 'm3', * FROM m3)""")
ORACLE["method_comparison"] = f"""{_EVERY},
  cal AS (SELECT method, category, cell, avg(raw) AS alpha, greatest(stddev_samp(raw), 1e-6) AS beta FROM every
          WHERE split = 'calibration' GROUP BY ALL),
  per AS (SELECT method, category, image, anomaly, max(raw) AS raw, max((raw - alpha) / beta) AS z
          FROM every JOIN cal USING (method, category, cell) WHERE split = 'test' GROUP BY ALL),
  kinds AS (SELECT method, 'raw' AS kind, category, image, anomaly, raw AS s FROM per
            UNION ALL SELECT method, 'z', category, image, anomaly, z FROM per)
SELECT p.method, p.kind, p.category, count(DISTINCT p.image) AS positives, count(DISTINCT g.image) AS negatives,
  {r('avg(CASE WHEN p.s > g.s THEN 1.0 WHEN p.s = g.s THEN .5 ELSE 0 END)')} AS auroc
FROM kinds p JOIN kinds g USING (method, kind, category) WHERE p.anomaly AND NOT g.anomaly GROUP BY ALL"""


# Localisation of every method. It reads masks and pixels as the evaluation queries do.

def method_localisation(spark, sf):
    """Pixel AUROC and AUPRO of every method and category, raw and calibrated, from one pass over the methods' maps."""
    maps = kept(method_maps(spark, sf), "method-maps")
    keys = ["method", "category", "cell"]
    calibration = kept(M.position_calibration(maps.where("split = 'calibration'"), keys), "calibration")
    z = M.calibrated(maps.where("split = 'test'"), calibration, keys)
    cells = F.array_sort(F.collect_list(F.struct("cell", "raw", "z")))
    both = z.groupBy("method", "category", "image").agg(cells.alias("_c")).select("method", "category", "image", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(f"_c.{kind}").alias("map")) for kind in ("raw", "z")])).alias("_m")).select(
        "method", "category", "image", "_m.kind", "_m.map")
    pixels = E.labelled_pixels(both, EV.masks(spark, sf), ["category", "image"], HEIGHT, WIDTH, EV.OUT_HEIGHT, EV.OUT_WIDTH)
    return rounded(E.localisation(pixels, ["method", "kind", "category"]))


QUERIES["method_localisation"] = method_localisation
ORACLE["method_localisation"] = f"""{_EVERY},
  cal AS (SELECT method, category, cell, avg(raw) AS alpha, greatest(stddev_samp(raw), 1e-6) AS beta FROM every WHERE split = 'calibration' GROUP BY ALL),
  tested AS (SELECT method, category, image, cell, raw, (raw - alpha) / beta AS z FROM every JOIN cal USING (method, category, cell) WHERE split = 'test'),
  marr AS (SELECT method, 'raw' AS kind, category, image, list(raw ORDER BY cell) AS m FROM tested GROUP BY ALL
    UNION ALL SELECT method, 'z', category, image, list(z ORDER BY cell) FROM tested GROUP BY ALL),
  {EV.SQL_UP[EV.SQL_UP.index("px AS (SELECT unnest"):EV.SQL_UP.index("  marr AS (")].rstrip().rstrip(",")},
  up AS (SELECT method, kind, category, image, 'd' || label AS defect, label >= 6 AS bad, px, y, x,
      (m[y0 * 4 + x0 + 1] * (1 - fx) + m[y0 * 4 + x1 + 1] * fx) * (1 - fy) + (m[y1 * 4 + x0 + 1] * (1 - fx) + m[y1 * 4 + x1 + 1] * fx) * fy AS score
    FROM marr JOIN embeddings ON vec_id = image, grid),
  lab AS (SELECT *, CASE WHEN NOT bad THEN 0 WHEN y BETWEEN image % 2 AND image % 2 + 1 AND x BETWEEN image % 5 AND image % 5 + 2 THEN 1
      WHEN defect IN ('d6', 'd9') AND y BETWEEN 4 AND 5 AND x BETWEEN 8 AND 9 + image % 2 THEN 2 ELSE 0 END AS region FROM up),
  area AS (SELECT method, kind, image, region, count(*) AS a FROM lab WHERE region > 0 GROUP BY ALL),
  pixels AS (SELECT lab.*, coalesce(1.0::DOUBLE / a, 0) AS w FROM lab LEFT JOIN area USING (method, kind, image, region)) {EV.sql_metrics('method, kind, category', 'pixels')}
SELECT method, kind, category, regions, positive_pixels, negative_pixels, {r('pixel_auroc')} AS pixel_auroc, {r('aupro030')} AS aupro030 FROM metrics"""
