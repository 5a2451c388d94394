"""Queries: rotated, scaled and shifted images, taken back again, and how the three ways of matching cells stand them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.operators import correspondence as C
from gridsift.operators import geometry as G
from gridsift.operators import moments as M
from gridsift.operators import paired as P
from gridsift.plans.studies import INNER, KEYS, SQL_TRIP, _sql_delta, nuisance_state, pixel_features, pixel_images
from gridsift.plans.views import HEIGHT, WIDTH, r, rounded
from gridsift.session import kept

QUERIES, ORACLE = {}, {}

#: Images are 8x8 here.
SIDE = 8
TRIP = {"ROTATION": G.ROTATION, "SCALE": G.SCALE}
#: With the level that changes nothing; shifts are fitted to the size of the images.
ROBUST = {"ROTATION": (*G.ROTATION, 0.0), "SCALE": (*G.SCALE, 1.0), "TRANSLATION_X": (-1.0, 0.0, 1.0), "TRANSLATION_Y": (-1.0, 0.0, 1.0)}


def _sql_levels(levels):
    return "SELECT * FROM (VALUES " + ", ".join(f"('{f}', CAST({v} AS DOUBLE))" for f, values in levels.items() for v in values) + ") v(family, level)"


def _sql_places(source):
    """Neighbours and fractions of each pixel under the rows (family, level, applied) of ``source``; ``applied`` is the level that is applied."""
    return f"""SELECT family, level, i, x0, y0, least(x0 + 1, 7) AS x1, least(y0 + 1, 7) AS y1, sx - x0 AS dx, sy - y0 AS dy
    FROM (SELECT *, CAST(floor(sx) AS INT) AS x0, CAST(floor(sy) AS INT) AS y0 FROM (
      SELECT family, level, i, least(greatest(a * (i % 8) + b * (i // 8) + c, 0), 7) AS sx, least(greatest(d * (i % 8) + e * (i // 8) + f, 0), 7) AS sy
      FROM (SELECT family, level,
          CASE family WHEN 'ROTATION' THEN cos(radians(applied)) WHEN 'SCALE' THEN 1 / applied ELSE 1 END AS a,
          CASE family WHEN 'ROTATION' THEN sin(radians(applied)) ELSE 0 END AS b,
          CASE family WHEN 'ROTATION' THEN 3.5::DOUBLE - cos(radians(applied)) * 3.5::DOUBLE - sin(radians(applied)) * 3.5::DOUBLE WHEN 'SCALE' THEN 3.5::DOUBLE - 3.5::DOUBLE / applied
            WHEN 'TRANSLATION_X' THEN -applied ELSE 0 END AS c,
          CASE family WHEN 'ROTATION' THEN -sin(radians(applied)) ELSE 0 END AS d,
          CASE family WHEN 'ROTATION' THEN cos(radians(applied)) WHEN 'SCALE' THEN 1 / applied ELSE 1 END AS e,
          CASE family WHEN 'ROTATION' THEN 3.5::DOUBLE + sin(radians(applied)) * 3.5::DOUBLE - cos(radians(applied)) * 3.5::DOUBLE WHEN 'SCALE' THEN 3.5::DOUBLE - 3.5::DOUBLE / applied
            WHEN 'TRANSLATION_Y' THEN -applied ELSE 0 END AS f
        FROM ({source})), (SELECT unnest(range(64)) AS i)))"""


def _sql_value(p):
    return f"""CAST(floor(({p}[y0 * 8 + x0 + 1] * (1 - dx) + {p}[y0 * 8 + x1 + 1] * dx) * (1 - dy)
      + ({p}[y1 * 8 + x0 + 1] * (1 - dx) + {p}[y1 * 8 + x1 + 1] * dx) * dy + 0.5) AS INT)"""


SQL_PIXELS = """
  pix AS (SELECT 'c' || (label % 2) AS category, vec_id AS image,
      CASE WHEN label < 2 THEN 'fit' WHEN label < 4 THEN 'calibration' ELSE 'test' END AS split,
      list_transform(embedding, lambda v: CAST(floor(least(greatest(CAST(127.5 AS DOUBLE) + 400 * CAST(v AS DOUBLE), 0), 255) + 0.5) AS INT)) AS p
    FROM embeddings)"""

SQL_GEOMETRY = SQL_PIXELS + f""",
  cond AS ({_sql_levels(TRIP)}),
  there AS ({_sql_places('SELECT *, level AS applied FROM cond')}),
  home AS ({_sql_places("SELECT *, CASE family WHEN 'SCALE' THEN 1 / level ELSE -level END AS applied FROM cond")}),
  ch AS (SELECT category, image, split, family, level, any_value(p) AS p, list({_sql_value('p')} ORDER BY i) AS q FROM pix, there WHERE split = 'test' GROUP BY ALL),
  bk AS (SELECT category, image, split, family, level, any_value(p) AS p, any_value(q) AS q, list({_sql_value('q')} ORDER BY i) AS c
    FROM ch JOIN home USING (family, level) GROUP BY ALL),
""" + SQL_TRIP[SQL_TRIP.index("  st AS ("):]


def geometric_trip(spark, sf):
    """Test images changed and changed back by the inverse level, and the maps of all three stages."""
    model, calibration = nuisance_state(spark, sf, ("identity",))
    keys = ["category", "image", "family", "level"]
    back = kept(G.changed(pixel_images(spark, sf).where("split = 'test'"), TRIP, SIDE, SIDE, back=True).select(*keys, "pixels", "changed", "corrected"), "trip")
    stages = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(c).alias("pixels")) for s, c in (
        ("s0", "pixels"), ("sp", "changed"), ("sc", "corrected"))])).alias("_s")
    f = pixel_features(back.select(*keys, F.lit("identity").alias("variant"), stages).select(*keys, "variant", "_s.stage", "_s.pixels"))
    return back, M.calibrated(M.feature_maps(f, model, KEYS), calibration, KEYS), keys


def geometric_maps(spark, sf):
    """One row per image, level and cell with the values of the three stages."""
    back, maps, keys = geometric_trip(spark, sf)
    at = lambda s: F.max(F.when(F.col("stage") == s, F.col("z"))).alias(s)
    return back, kept(maps.groupBy(*keys, "cell").agg(at("s0"), at("sp"), at("sc")), "geometric-maps"), keys


def geometric_records(spark, sf):
    """Per image and level: peaks of the three stages, inner peaks, errors of both maps and of the pixels taken back."""
    back, cells, keys = geometric_maps(spark, sf)
    inner = F.expr(INNER)
    peaks = [F.max(F.when(where, F.col(s))).alias(f"{name}{s}") for name, where in (("", F.lit(True)), ("interior_", inner)) for s in ("s0", "sp", "sc")]
    errors = []
    for stage, prefix in (("sc", ""), ("sp", "perturbed_")):
        for name, where in (("map", F.lit(True)), ("interior_map", inner)):
            d = F.when(where, F.abs(F.col(stage) - F.col("s0")))
            errors += [F.avg(d).alias(f"{prefix}{name}_mae"), F.sqrt(F.avg(d * d)).alias(f"{prefix}{name}_rmse"), F.max(d).alias(f"{prefix}{name}_max")]
    gaps = F.zip_with("pixels", "corrected", lambda a, b: F.abs(a - b))
    count = F.lit(SIDE * SIDE)
    pixels = back.select(*keys, (F.aggregate(gaps, F.lit(0), lambda s, v: s + v) / count).alias("rgb_mae"),
                         F.sqrt(F.aggregate(gaps, F.lit(0), lambda s, v: s + v * v) / count).alias("rgb_rmse"), F.array_max(gaps).alias("rgb_max"))
    return rounded(cells.groupBy(*keys).agg(*peaks, *errors).join(pixels, keys), 4)


QUERIES["geometric_records"] = geometric_records
_errors = ", ".join(f"{r(f'{how}', 4)} AS {prefix}{name}_{what}" for stage, prefix in (("sc", ""), ("sp", "perturbed_")) for name, where in (("map", "TRUE"), ("interior_map", INNER))
                    for what, how in (("mae", f"avg(abs({stage} - s0)) FILTER ({where})"), ("rmse", f"sqrt(avg(({stage} - s0) ** 2) FILTER ({where}))"), ("max", f"max(abs({stage} - s0)) FILTER ({where})")))
_peaks = ", ".join(f"{r(f'max({s}) FILTER ({where})', 4)} AS {name}{s}" for name, where in (("", "TRUE"), ("interior_", INNER)) for s in ("s0", "sp", "sc"))
SQL_CELLS = """
  wide AS (SELECT category, image, family, level, cell, max(z) FILTER (stage = 's0') AS s0, max(z) FILTER (stage = 'sp') AS sp, max(z) FILTER (stage = 'sc') AS sc
    FROM tz GROUP BY ALL)"""
ORACLE["geometric_records"] = f"""WITH {SQL_GEOMETRY}, {SQL_CELLS},
  peaks AS (SELECT category, image, family, level, {_peaks}, {_errors} FROM wide GROUP BY ALL),
  gaps AS (SELECT category, image, family, level, list_transform(list_zip(p, c), lambda t: abs(t[1] - t[2])) AS g FROM bk)
SELECT peaks.*, {r('list_sum(g) / 64', 4)} AS rgb_mae, {r('sqrt(list_sum(list_transform(g, lambda v: v * v)) / 64)', 4)} AS rgb_rmse, list_max(g) AS rgb_max
FROM peaks JOIN gaps USING (category, image, family, level)"""


def geometric_recovery(spark, sf):
    """How much of the effect of a rotation or scale its inverse takes back."""
    _, cells, keys = geometric_maps(spark, sf)
    triples = kept(cells.groupBy(*keys).agg(*[F.max(s).alias(s) for s in ("s0", "sp", "sc")]), "triples")
    return rounded(P.recovery_summary(triples, ["category", "family", "level"]), 4)


QUERIES["geometric_recovery"] = geometric_recovery
ORACLE["geometric_recovery"] = f"""WITH {SQL_GEOMETRY},
  d AS (SELECT *, sp - s0 AS dp, sc - s0 AS dc, CASE WHEN abs(sp - s0) > .1 THEN 1 - (sc - s0) / (sp - s0) END AS ratio FROM tr)
SELECT category, family, level, count(*) AS n, count(ratio) AS recovery_count, {r('avg(CAST(abs(dc) <= 1 AS INT))', 4)} AS within_1,
  {r('avg(CAST(abs(dc) <= 2 AS INT))', 4)} AS within_2, {r('avg(CAST(abs(dc) <= 5 AS INT))', 4)} AS within_5, {r('median(dp)', 4)} AS median_dp,
  {r('median(dc)', 4)} AS median_dc, {r('avg(dc)', 4)} AS mean_dc, {r('quantile_cont(dc, .9)', 4)} AS p90_dc,
  {r('quantile_cont(dc, .95)', 4)} AS p95_dc, {r('median(ratio)', 4)} AS median_recovery FROM d GROUP BY ALL"""


# Correspondence under geometric changes --------------------------------------------------------------------------------

def correspondence_robustness(spark, sf):
    """Peaks of own-cell, neighbourhood and free matching under geometric changes, against each mode's own calibration."""
    model, _ = nuisance_state(spark, sf, ("identity",))
    pack = kept(C.packed(model.where("variant = 'identity'"), ["mean", "std"]), "packed")
    modes, by = ("P", "N1", "G"), ["mode", "category", "cell"]
    grey = lambda c: F.transform(c, lambda v: v / F.lit(255.0)).alias("grid")
    px = pixel_images(spark, sf)
    plain = kept(C.correspondence_maps(px.where("split <> 'fit'").select("category", "image", "split", grey("pixels")), pack, HEIGHT, WIDTH, modes, normalise=True), "plain")
    calibration = kept(M.position_calibration(plain.where("split = 'calibration'"), by), "calibration")
    before = M.image_scores(M.calibrated(plain, calibration, by), ["mode", "category", "image", "split"])
    rows = G.changed(px.where("split = 'test'"), ROBUST, SIDE, SIDE).select("category", "image", "family", "level", grey("changed"))
    after = M.image_scores(M.calibrated(C.correspondence_maps(rows, pack, HEIGHT, WIDTH, modes, normalise=True), calibration, by), ["mode", "category", "image", "family", "level"])
    before = kept(before, "before")
    reference = before.where("split = 'calibration'").groupBy("mode", "category").agg(F.max("score").alias("reference"))
    pairs = P.paired(after.withColumnRenamed("score", "st"), before.where("split = 'test'").withColumnRenamed("score", "s0"), ["mode", "category", "image"])
    pairs = pairs.join(reference, ["mode", "category"]).withColumn("exceeds", F.col("st") > F.col("reference"))
    return rounded(P.robustness_summary(kept(pairs, "pairs"), ["mode", "category", "family", "level"]), 4)


QUERIES["correspondence_robustness"] = correspondence_robustness
ORACLE["correspondence_robustness"] = f"""WITH {SQL_PIXELS},
  cond AS ({_sql_levels(ROBUST)}),
  there AS ({_sql_places('SELECT *, level AS applied FROM cond')}),
  every AS (SELECT category, image, split, '' AS family, CAST(0 AS DOUBLE) AS level, p FROM pix
    UNION ALL SELECT category, image, 'changed', family, level, list({_sql_value('p')} ORDER BY i) FROM pix, there WHERE split = 'test' GROUP BY ALL),
  px AS (SELECT * EXCLUDE (p), unnest(p) / CAST(255 AS DOUBLE) AS x, generate_subscripts(p, 1) - 1 AS i FROM every),
  cu AS (SELECT category, image, split, family, level, i // 8 AS cell, i % 8 AS ch,
      x / sqrt(sum(x * x) OVER (PARTITION BY image, split, family, level, i // 8)) AS u FROM px),
  mo AS (SELECT category, cell, ch, avg(u) AS mean, greatest(stddev_samp(u), 1e-6) AS std FROM cu WHERE split = 'fit' GROUP BY ALL),
  pairs AS (SELECT a.cell, b.cell AS reference, m.mode FROM (SELECT unnest(range(8)) AS cell) a, (SELECT unnest(range(8)) AS cell) b,
     (SELECT unnest(['P', 'N1', 'G']) AS mode) m WHERE m.mode = 'G' OR a.cell = b.cell
       OR (m.mode = 'N1' AND abs(a.cell // 4 - b.cell // 4) <= 1 AND abs(a.cell % 4 - b.cell % 4) <= 1)),
  dist AS (SELECT c.category, c.image, c.split, c.family, c.level, c.cell, mo.cell AS reference, avg(((u - mean) / std) * ((u - mean) / std)) AS d
    FROM cu c JOIN mo ON mo.category = c.category AND mo.ch = c.ch WHERE c.split <> 'fit' GROUP BY ALL),
  best AS (SELECT mode, category, image, split, family, level, cell, min(d) AS raw FROM dist JOIN pairs USING (cell, reference) GROUP BY ALL),
  ca AS (SELECT mode, category, cell, avg(raw) AS alpha, greatest(stddev_samp(raw), 1e-6) AS beta FROM best WHERE split = 'calibration' GROUP BY ALL),
  peak AS (SELECT mode, category, image, split, family, level, max((raw - alpha) / beta) AS score FROM best JOIN ca USING (mode, category, cell) GROUP BY ALL),
  rf AS (SELECT mode, category, max(score) AS reference FROM peak WHERE split = 'calibration' GROUP BY ALL),
  rp AS (SELECT a.mode, a.category, a.family, a.level, a.score AS st, b.score AS s0, a.score - b.score AS delta, reference, a.score > reference AS exceeds
    FROM peak a JOIN peak b ON b.mode = a.mode AND b.category = a.category AND b.image = a.image AND b.split = 'test'
      JOIN rf ON rf.mode = a.mode AND rf.category = a.category WHERE a.split = 'changed')
SELECT mode, category, family, level, count(*) AS n, {_sql_delta('', 4)}, {r('avg(CAST(exceeds AS INT))', 4)} AS exceedance, {r('max(reference)', 4)} AS reference
FROM rp GROUP BY ALL"""
