"""Queries: silhouettes, poses, resampling, bands and detection on the 8x8 images read from the vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridsift.functions import grid as G
from gridsift.images.photometry import LEVELS, gradient_energy
from gridsift.operators import evaluate as E
from gridsift.operators import imaging as I
from gridsift.operators import moments as M
from gridsift.operators import regions as R
from gridsift.plans.studies import pixel_images
from gridsift.plans.views import SQL_SCORED, image_table, r, rounded, scored
from gridsift.session import kept

QUERIES, ORACLE = {}, {}

SIDE = 8
KEEP = ("category", "image", "defect", "split", "anomaly")

SQL_PIX = """pix AS (SELECT 'c' || (label % 2) AS category, vec_id AS image, CASE WHEN label < 6 THEN 'good' ELSE 'd' || label END AS defect,
      CASE WHEN label < 2 THEN 'fit' WHEN label < 4 THEN 'calibration' ELSE 'test' END AS split, label >= 6 AS anomaly,
      list_transform(embedding, lambda v: CAST(floor(least(greatest(CAST(127.5 AS DOUBLE) + 400 * CAST(v AS DOUBLE), 0), 255) + 0.5) AS INT)) AS p
    FROM embeddings),
  px AS (SELECT category, image, defect, split, anomaly, unnest(p) AS v, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS px FROM pix),
  pxy AS (SELECT *, px // 8 AS y, px % 8 AS x FROM px)"""

# Silhouette: threshold, largest 8-connected region, hole fill.
SQL_MASK = SQL_PIX + """,
  hist AS (SELECT image, v, count(*) AS n FROM px GROUP BY ALL),
  cum AS (SELECT image, v, sum(n) OVER w AS wt, sum(n * v) OVER w AS sm, sum(n * v) OVER (PARTITION BY image) AS tot FROM hist WINDOW w AS (PARTITION BY image ORDER BY v)),
  sep AS (SELECT image, v, CASE WHEN wt < 64 THEN (CAST(tot AS DOUBLE) * wt - CAST(sm AS DOUBLE) * 64) ** 2 / (CAST(wt AS DOUBLE) * (64 - wt)) ELSE 0 END AS sc FROM cum),
  thr AS (SELECT image, first(v ORDER BY sc DESC, v) AS t FROM sep GROUP BY ALL),
  fg AS (SELECT image, px, y, x FROM pxy JOIN thr USING (image) WHERE v > t),
  reach AS (SELECT image, px AS a, px AS b, y, x FROM fg
    UNION SELECT r.image, r.a, f.px, f.y, f.x FROM reach r JOIN fg f ON f.image = r.image AND abs(f.y - r.y) <= 1 AND abs(f.x - r.x) <= 1),
  lab AS (SELECT image, a AS px, min(b) AS root FROM reach GROUP BY ALL),
  big AS (SELECT image, first(root ORDER BY n DESC, root) AS root FROM (SELECT image, root, count(*) AS n FROM lab GROUP BY ALL) GROUP BY ALL),
  bg AS (SELECT image, px, y, x FROM pxy ANTI JOIN (SELECT lab.image, lab.px FROM lab JOIN big USING (image, root)) k USING (image, px)),
  ext AS (SELECT image, px, y, x FROM bg WHERE y IN (0, 7) OR x IN (0, 7)
    UNION SELECT f.image, f.px, f.y, f.x FROM ext e JOIN bg f ON f.image = e.image AND abs(f.y - e.y) + abs(f.x - e.x) = 1),
  mk AS (SELECT category, image, defect, split, anomaly, px, y, x, v FROM pxy ANTI JOIN ext USING (image, px))"""


def masks(spark, sf):
    return kept(I.silhouettes(pixel_images(spark, sf).select(*KEEP, "pixels"), [*KEEP, "pixels"], SIDE, SIDE), "masks")


def silhouettes(spark, sf):
    m = masks(spark, sf)
    return m.select("category", "image", "threshold", "area", F.posexplode("mask").alias("px", "inside")).where("inside").drop("inside")


QUERIES["silhouettes"] = silhouettes
ORACLE["silhouettes"] = f"""WITH RECURSIVE {SQL_MASK}, ar AS (SELECT image, CAST(count(*) AS INTEGER) AS area FROM mk GROUP BY ALL)
SELECT category, image, t AS threshold, area, px FROM mk JOIN thr USING (image) JOIN ar USING (image)"""


def mask_regions(spark, sf):
    """8-connected regions of the pixels above 160, with their areas."""
    bright = pixel_images(spark, sf).select("category", "image", F.transform("pixels", lambda v: v > 160).alias("mask"))
    found = I.regions(bright, ["category", "image"], SIDE, SIDE)
    px = found.select("category", "image", F.posexplode("regions").alias("px", "region")).where("region > 0")
    return px.groupBy("category", "image", "region").agg(F.count(F.lit(1)).alias("area"), F.min("px").alias("first_px"))


QUERIES["mask_regions"] = mask_regions
ORACLE["mask_regions"] = f"""WITH RECURSIVE {SQL_PIX},
  fg AS (SELECT category, image, px, y, x FROM pxy WHERE v > 160),
  reach AS (SELECT image, px AS a, px AS b, y, x FROM fg
    UNION SELECT r.image, r.a, f.px, f.y, f.x FROM reach r JOIN fg f ON f.image = r.image AND abs(f.y - r.y) <= 1 AND abs(f.x - r.x) <= 1),
  lab AS (SELECT image, a AS px, min(b) AS root FROM reach GROUP BY ALL)
SELECT category, image, CAST(dense_rank() OVER (PARTITION BY image ORDER BY root) AS INTEGER) AS region, count(*) AS area, root AS first_px
FROM lab JOIN fg USING (image, px) GROUP BY category, image, root"""


def axis_poses(spark, sf):
    p = I.axis_poses(masks(spark, sf), ["category", "image"], SIDE, SIDE, ["CENTER_ONLY", "AXIS"])
    return rounded(p.select("category", "image", "strategy", "state", "cx", "cy", "area", "anisotropy", "border"))


QUERIES["axis_poses"] = axis_poses
SQL_POSE = SQL_MASK + """,
  ms AS (SELECT category, image, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy,
     bool_or(x IN (0, 7) OR y IN (0, 7)) AS border FROM mk GROUP BY ALL),
  po AS (SELECT category, image, n, border, CAST(sx AS DOUBLE) / n AS mx, CAST(sy AS DOUBLE) / n AS my, CAST(sxx * n - sx * sx AS DOUBLE) / n AS xx,
     CAST(syy * n - sy * sy AS DOUBLE) / n AS yy, CAST(sxy * n - sx * sy AS DOUBLE) / n AS xy FROM ms),
  p2 AS (SELECT *, CASE WHEN xx + yy > 0 THEN sqrt((xx - yy) ** 2 + 4 * xy * xy) / (xx + yy) ELSE 0 END AS anis FROM po)"""
ORACLE["axis_poses"] = f"""WITH RECURSIVE {SQL_POSE}, s AS (SELECT *, unnest(['CENTER_ONLY', 'AXIS']) AS strategy FROM p2)
SELECT category, image, strategy, CASE WHEN border OR n / 64.0 > .95 OR n / 64.0 < .005 THEN 'SEGMENTATION_FAILURE' WHEN strategy = 'AXIS' AND anis < .1 THEN 'WEAK_AXIS' ELSE 'OK' END AS state,
  {r('(mx + .5) * 4 - .5')} AS cx, {r('(my + .5) * 4 - .5')} AS cy, {r('n / 64.0::DOUBLE')} AS area, {r('anis')} AS anisotropy, border FROM s"""


def fourfold_poses(spark, sf):
    p = I.fourfold_poses(pixel_images(spark, sf), ["category", "image"], SIDE, SIDE)
    return rounded(p.select("category", "image", "status", "reason", "cx", "cy", "area", "strength", "radius"))


QUERIES["fourfold_poses"] = fourfold_poses
ORACLE["fourfold_poses"] = f"""WITH RECURSIVE {SQL_POSE},
  h4 AS (SELECT image, avg(CASE WHEN x = mx AND y = my THEN 1 ELSE cos(4 * atan2(y - my, x - mx)) END) AS re, avg(CASE WHEN x = mx AND y = my THEN 0 ELSE sin(4 * atan2(y - my, x - mx)) END) AS im
     FROM mk JOIN p2 USING (image) GROUP BY ALL),
  q AS (SELECT p2.*, sqrt(re * re + im * im) AS st, NOT border AND n / 64.0 BETWEEN .2 AND .8 AS ok FROM p2 JOIN h4 USING (image))
SELECT category, image, CASE WHEN ok AND st >= .03 THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
  CASE WHEN NOT ok THEN 'AREA_OR_BORDER' WHEN st < .03 THEN 'WEAK_FOURFOLD_HARMONIC' ELSE 'OK' END AS reason,
  {r('CASE WHEN ok THEN (mx + .5) * 4 - .5 ELSE 15.5::DOUBLE END')} AS cx, {r('CASE WHEN ok THEN (my + .5) * 4 - .5 ELSE 15.5::DOUBLE END')} AS cy, {r('n / 64.0::DOUBLE')} AS area,
  {r('CASE WHEN ok THEN st ELSE 0 END')} AS strength, {r('CASE WHEN ok THEN sqrt(n / pi()) * 4 ELSE 0 END')} AS radius FROM q"""


def symmetry_orders(spark, sf):
    """Amplitudes of the angular orders 2..12 of every silhouette."""
    s = I.symmetry_orders(masks(spark, sf), ["category", "image"], SIDE, SIDE)
    return rounded(s.select("category", "image", F.posexplode("amplitudes").alias("i", "amplitude")).select(
        "category", "image", (F.col("i") + 2).alias("order"), "amplitude"), 5)


QUERIES["symmetry_orders"] = symmetry_orders
SQL_ORDERS = SQL_POSE + """,
  th AS (SELECT mk.category, image, atan2(my - y, x - mx) AS t FROM mk JOIN p2 USING (image)),
  bn AS (SELECT category, image, (CAST(floor(round(degrees(t), 9)) AS INT) + 360) % 360 AS b FROM th),
  od AS (SELECT category, image, k, sqrt(sum(cos(2 * pi() * k * b / 360)) ** 2 + sum(sin(2 * pi() * k * b / 360)) ** 2) AS amp
     FROM bn, (SELECT unnest(range(2, 13)) AS k) GROUP BY ALL)"""
ORACLE["symmetry_orders"] = f"WITH RECURSIVE {SQL_ORDERS} SELECT category, image, CAST(k AS INTEGER) AS \"order\", {r('amp', 5)} AS amplitude FROM od"


def dominant_order(spark, sf):
    return R.symmetry_order(I.symmetry_orders(masks(spark, sf), ["category", "image"], SIDE, SIDE), ["category"])


QUERIES["dominant_order"] = dominant_order
ORACLE["dominant_order"] = f"""WITH RECURSIVE {SQL_ORDERS}, d AS (SELECT category, image, first(k ORDER BY round(amp, 9) DESC, k) AS k FROM od GROUP BY ALL),
  n AS (SELECT category, k, count(*) AS n FROM d GROUP BY ALL)
SELECT category, CAST(first(k ORDER BY n DESC, k) AS INTEGER) AS "order", CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY ALL"""


# Geometric changes -----------------------------------------------------------------------------------------------------

GEOMETRIC = ("TRANSLATION_X", "TRANSLATION_Y", "ROTATION", "SCALE")


def geometric_changes(spark, sf):
    """Every image under every geometric family and level, with the largest and mean absolute pixel change."""
    grid = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(v).alias("level")) for f in GEOMETRIC for v in LEVELS[f]])
    rows = pixel_images(spark, sf).select("category", "image", "pixels", F.col("pixels").alias("before"), F.explode(grid).alias("_g")).select(
        "category", "image", "pixels", "before", "_g.*")
    out = I.geometric(rows, ["category", "image", "before"], SIDE, SIDE)
    d = F.zip_with("pixels", "before", lambda a, b: F.abs(a - b))
    return rounded(out.select("category", "image", "family", "level", F.array_max(d).alias("max_change"),
                              (F.aggregate(d, F.lit(0), lambda a, v: a + v) / F.lit(64.0)).alias("mean_change")))


QUERIES["geometric_changes"] = geometric_changes
_moves = " UNION ALL ".join(f"SELECT '{f}' AS family, CAST({v} AS DOUBLE) AS level" for f in GEOMETRIC for v in LEVELS[f])
ORACLE["geometric_changes"] = f"""WITH {SQL_PIX}, cond AS ({_moves}),
  src AS (SELECT category, image, p, family, level, px, v, CASE family WHEN 'TRANSLATION_X' THEN x - level WHEN 'ROTATION' THEN cos(radians(level)) * (x - 3.5::DOUBLE) + sin(radians(level)) * (y - 3.5::DOUBLE) + 3.5::DOUBLE
      WHEN 'SCALE' THEN (x - 3.5::DOUBLE) / level + 3.5::DOUBLE ELSE x END AS sx, CASE family WHEN 'TRANSLATION_Y' THEN y - level
      WHEN 'ROTATION' THEN -sin(radians(level)) * (x - 3.5::DOUBLE) + cos(radians(level)) * (y - 3.5::DOUBLE) + 3.5::DOUBLE WHEN 'SCALE' THEN (y - 3.5::DOUBLE) / level + 3.5::DOUBLE ELSE y END AS sy
    FROM pxy JOIN pix USING (category, image), cond),
  cl AS (SELECT *, least(greatest(sx, 0), 7) AS u, least(greatest(sy, 0), 7) AS w FROM src),
  ix AS (SELECT *, CAST(floor(u) AS INT) AS x0, CAST(floor(w) AS INT) AS y0, least(CAST(floor(u) AS INT) + 1, 7) AS x1, least(CAST(floor(w) AS INT) + 1, 7) AS y1, u - floor(u) AS fx, w - floor(w) AS fy FROM cl),
  nv AS (SELECT category, image, family, level, v, floor((p[y0 * 8 + x0 + 1] * (1 - fx) + p[y0 * 8 + x1 + 1] * fx) * (1 - fy) + (p[y1 * 8 + x0 + 1] * (1 - fx) + p[y1 * 8 + x1 + 1] * fx) * fy + 0.5) AS q FROM ix)
SELECT category, image, family, level, CAST(max(abs(q - v)) AS INTEGER) AS max_change, {r('avg(abs(q - v))')} AS mean_change FROM nv GROUP BY ALL"""


def resized_images(spark, sf):
    """Bicubic reduction to 5x5."""
    small = I.resized(pixel_images(spark, sf), ["category", "image"], SIDE, SIDE, 5, 5)
    return small.select("category", "image", F.posexplode("pixels").alias("px", "v"))


QUERIES["resized_images"] = resized_images
SQL_KEYS = "CASE WHEN abs({t}) <= 1 THEN (1.5 * abs({t}) - 2.5) * abs({t}) * abs({t}) + 1 WHEN abs({t}) < 2 THEN ((-.5 * abs({t}) + 2.5) * abs({t}) - 4) * abs({t}) + 2 ELSE 0 END"


def _keys(t):
    return SQL_KEYS.replace("{t}", t)


ORACLE["resized_images"] = f"""WITH {SQL_PIX},
  o AS (SELECT i, (i % 5 + .5::DOUBLE) * 8 / 5 - .5::DOUBLE AS sx, (i // 5 + .5::DOUBLE) * 8 / 5 - .5::DOUBLE AS sy FROM (SELECT unnest(range(25)) AS i)),
  t AS (SELECT i, CAST(floor(sx) AS INT) + a AS tx, CAST(floor(sy) AS INT) + b AS ty, CAST({_keys('(sx - floor(sx) - a)')} AS DOUBLE) * CAST({_keys('(sy - floor(sy) - b)')} AS DOUBLE) AS w
     FROM o, (SELECT unnest([-1, 0, 1, 2]) AS a), (SELECT unnest([-1, 0, 1, 2]) AS b)),
  s AS (SELECT category, image, i, sum(w * p[least(greatest(ty, 0), 7) * 8 + least(greatest(tx, 0), 7) + 1]) / sum(w) AS v FROM pix, t GROUP BY ALL)
SELECT category, image, CAST(i AS INTEGER) AS px, CAST(floor(least(greatest(v, 0), 255) + .5) AS INTEGER) AS v FROM s"""


def posed(spark, sf):
    """Each image with the turn of its first two entries about the middle of the frame."""
    from gridsift.plans.views import images
    e = lambda i: F.col("embedding")[i].cast("double")
    middle = F.lit((SIDE - 1) / 2)
    t = images(spark, sf).select("image", G.rigid_about(F.atan2(e(1), e(0)), middle, middle, middle, middle).alias("transform"))
    return pixel_images(spark, sf).join(t, "image")


SQL_TURN = SQL_PIX + """,
  tr AS (SELECT vec_id AS image, cos(a) AS co, sin(a) AS si, 3.5::DOUBLE - (cos(a) * 3.5::DOUBLE - sin(a) * 3.5::DOUBLE) AS tx, 3.5::DOUBLE - (sin(a) * 3.5::DOUBLE + cos(a) * 3.5::DOUBLE) AS ty
    FROM (SELECT vec_id, atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)) AS a FROM embeddings)),
  oq AS (SELECT i, 2 * (i % 4 + .5::DOUBLE) - .5::DOUBLE AS qx, 2 * (i // 4 + .5::DOUBLE) - .5::DOUBLE AS qy FROM (SELECT unnest(range(16)) AS i)),
  sq AS (SELECT category, image, p, i, co, si, co * (qx - tx) + si * (qy - ty) AS sx, -si * (qx - tx) + co * (qy - ty) AS sy FROM pix JOIN tr USING (image), oq)"""


def canonical_samples(spark, sf):
    """4x4 samples of every turned image with the three kernels."""
    rows = posed(spark, sf)
    out = None
    for kernel in ("bilinear", "bicubic", "tent"):
        s = I.canonical_samples(rows, ["category", "image"], SIDE, 4, kernel).select(
            F.lit(kernel).alias("kernel"), "category", "image", F.posexplode("values").alias("px", "v"))
        out = s if out is None else out.unionByName(s)
    return rounded(out)


QUERIES["canonical_samples"] = canonical_samples
_tap = "p[least(greatest(ty, 0), 7) * 8 + least(greatest(tx, 0), 7) + 1]"
ORACLE["canonical_samples"] = f"""WITH {SQL_TURN},
  bl AS (SELECT category, image, i, CAST(floor(sx) AS INT) + a AS tx, CAST(floor(sy) AS INT) + b AS ty, (CASE a WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END)
     * (CASE b WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) AS w, p FROM sq, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
  bc AS (SELECT category, image, i, CAST(floor(sx) AS INT) + a AS tx, CAST(floor(sy) AS INT) + b AS ty, CAST({_keys('(sx - floor(sx) - a)')} AS DOUBLE) * CAST({_keys('(sy - floor(sy) - b)')} AS DOUBLE) AS w, p
     FROM sq, (SELECT unnest([-1, 0, 1, 2]) AS a), (SELECT unnest([-1, 0, 1, 2]) AS b)),
  tn AS (SELECT category, image, i, tx, ty, greatest(0, 1 - abs((co * (tx - sx) - si * (ty - sy)) / 2)) * greatest(0, 1 - abs((si * (tx - sx) + co * (ty - sy)) / 2)) AS w, p
     FROM (SELECT *, CAST(floor(sx) AS INT) + a AS tx, CAST(floor(sy) AS INT) + b AS ty FROM sq, (SELECT unnest(range(-3, 5)) AS a), (SELECT unnest(range(-3, 5)) AS b))
     WHERE abs(tx - sx) <= 2 * (abs(co) + abs(si)) AND abs(ty - sy) <= 2 * (abs(co) + abs(si))),
  every AS (SELECT 'bilinear' AS kernel, category, image, i, sum(w * {_tap}) / sum(w) AS v FROM bl GROUP BY ALL
    UNION ALL SELECT 'bicubic', category, image, i, sum(w * {_tap}) / sum(w) FROM bc GROUP BY ALL
    UNION ALL SELECT 'tent', category, image, i, sum(w * {_tap}) / sum(w) FROM tn GROUP BY ALL)
SELECT kernel, category, image, CAST(i AS INTEGER) AS px, {r('least(greatest(v, 0), 255)')} AS v FROM every"""


def backprojected_maps(spark, sf):
    """Calibrated maps on 8x8 pixels seen from the source frame of the turned image."""
    arrays = E.map_arrays(scored(spark, sf).where("split = 'test'"), ["category", "image"])
    up = E.upsampled(arrays, 2, 4, SIDE, SIDE)
    full = up.groupBy("category", "image").agg(F.transform(F.array_sort(F.collect_list(F.struct("px", "score"))), lambda p: p["score"]).alias("map"))
    t = posed(spark, sf).select("image", "transform")
    back = I.backprojected(full.join(t, "image"), ["category", "image"], SIDE)
    return rounded(back.select("category", "image", F.posexplode("map").alias("px", "score")), 5)


QUERIES["backprojected_maps"] = backprojected_maps
SQL_UP8 = """,
  g8 AS (SELECT px, least(greatest((px // 8 + .5::DOUBLE) / 4 - .5::DOUBLE, 0), 1) AS sy, least(greatest((px % 8 + .5::DOUBLE) / 2 - .5::DOUBLE, 0), 3) AS sx FROM (SELECT unnest(range(64)) AS px)),
  m8 AS (SELECT category, image, list(z ORDER BY cell) AS m FROM maps WHERE split = 'test' GROUP BY ALL),
  u8 AS (SELECT category, image, px, (m[floor(sy)::INT * 4 + floor(sx)::INT + 1] * (1 - (sx - floor(sx))) + m[floor(sy)::INT * 4 + least(floor(sx)::INT + 1, 3) + 1] * (sx - floor(sx))) * (1 - (sy - floor(sy)))
     + (m[least(floor(sy)::INT + 1, 1) * 4 + floor(sx)::INT + 1] * (1 - (sx - floor(sx))) + m[least(floor(sy)::INT + 1, 1) * 4 + least(floor(sx)::INT + 1, 3) + 1] * (sx - floor(sx))) * (sy - floor(sy)) AS score FROM m8, g8)"""
ORACLE["backprojected_maps"] = f"""WITH {SQL_SCORED} {SQL_UP8},
  a8 AS (SELECT category, image, list(score ORDER BY px) AS m FROM u8 GROUP BY ALL),
  tr AS (SELECT vec_id AS image, cos(a) AS co, sin(a) AS si, 3.5::DOUBLE - (cos(a) * 3.5::DOUBLE - sin(a) * 3.5::DOUBLE) AS tx, 3.5::DOUBLE - (sin(a) * 3.5::DOUBLE + cos(a) * 3.5::DOUBLE) AS ty
    FROM (SELECT vec_id, atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)) AS a FROM embeddings)),
  c AS (SELECT category, image, m, px, least(greatest(co * (px % 8) - si * (px // 8) + tx, 0), 7) AS u, least(greatest(si * (px % 8) + co * (px // 8) + ty, 0), 7) AS w FROM a8 JOIN tr USING (image), (SELECT unnest(range(64)) AS px)),
  d AS (SELECT category, image, m, px, CAST(floor(u) AS INT) AS x0, CAST(floor(w) AS INT) AS y0, least(CAST(floor(u) AS INT) + 1, 7) AS x1, least(CAST(floor(w) AS INT) + 1, 7) AS y1, u - floor(u) AS fx, w - floor(w) AS fy FROM c)
SELECT category, image, CAST(px AS INTEGER) AS px, {r('(m[y0 * 8 + x0 + 1] * (1 - fx) + m[y0 * 8 + x1 + 1] * fx) * (1 - fy) + (m[y1 * 8 + x0 + 1] * (1 - fx) + m[y1 * 8 + x1 + 1] * fx) * fy', 5)} AS score FROM d"""


# Bands, rings, occupancy -----------------------------------------------------------------------------------------------

def edge_band_shares(spark, sf):
    """Share of the positive score inside, along the edge of, and outside every silhouette (one step)."""
    arrays = E.map_arrays(scored(spark, sf).where("split = 'test'"), ["category", "image"])
    bands = I.edge_bands(masks(spark, sf).where("split = 'test'"), ["category", "image"], SIDE, SIDE, 1)
    px = E.upsampled(arrays.join(bands, ["category", "image"]), 2, 4, SIDE, SIDE, carry=["bands"])
    positive = F.greatest("score", F.lit(0.0))
    total = F.sum(positive)
    part = lambda k: F.when(total > 0, F.coalesce(F.sum(F.when(F.col("bands") == k, positive)), F.lit(0.0)) / total)
    return rounded(px.groupBy("category", "image").agg(part(2).alias("band"), part(1).alias("interior"), part(0).alias("outside"),
                                                       F.avg(F.when(F.col("bands") == 2, F.col("score"))).alias("mean_band")), 5)


QUERIES["edge_band_shares"] = edge_band_shares
ORACLE["edge_band_shares"] = f"""WITH RECURSIVE {SQL_MASK}, {SQL_SCORED} {SQL_UP8},
  near AS (SELECT a.image, a.px, count(b.px) AS k, bool_or(b.px = a.px) AS self, (1 + (a.y > 0)::INT + (a.y < 7)::INT + (a.x > 0)::INT + (a.x < 7)::INT) AS have
     FROM pxy a LEFT JOIN mk b ON b.image = a.image AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY a.image, a.px, a.y, a.x),
  bd AS (SELECT image, px, CASE WHEN k = 5 THEN 1 WHEN k > 0 THEN 2 ELSE 0 END AS b FROM near)
SELECT category, image, {r('CASE WHEN sum(greatest(score, 0)) > 0 THEN coalesce(sum(greatest(score, 0)) FILTER (b = 2), 0) / sum(greatest(score, 0)) END', 5)} AS band,
  {r('CASE WHEN sum(greatest(score, 0)) > 0 THEN coalesce(sum(greatest(score, 0)) FILTER (b = 1), 0) / sum(greatest(score, 0)) END', 5)} AS interior,
  {r('CASE WHEN sum(greatest(score, 0)) > 0 THEN coalesce(sum(greatest(score, 0)) FILTER (b = 0), 0) / sum(greatest(score, 0)) END', 5)} AS outside,
  {r('avg(score) FILTER (b = 2)', 5)} AS mean_band FROM u8 JOIN bd USING (image, px) GROUP BY ALL"""


def ring_contrast(spark, sf):
    """Mean score inside every silhouette and on the ring around it, and the percentile of the inner peak in its map."""
    arrays = E.map_arrays(scored(spark, sf).where("split = 'test'"), ["category", "image"])
    m = masks(spark, sf).where("split = 'test'")
    rings = I.rings(m, ["category", "image", "mask"], SIDE, SIDE, 1)
    px = E.upsampled(arrays.join(rings, ["category", "image"]), 2, 4, SIDE, SIDE, carry=["mask", "ring"])
    inner, near = F.when(F.col("mask"), F.col("score")), F.when(F.col("ring"), F.col("score"))
    per = px.groupBy("category", "image").agg(
        F.count(inner).alias("inside"), F.count(near).alias("on_ring"), F.avg(inner).alias("mean_inside"), F.avg(near).alias("mean_ring"),
        F.max(inner).alias("peak"), F.collect_list("score").alias("_all"))
    share = F.size(F.filter("_all", lambda v: v <= F.col("peak"))) / F.size("_all")
    return rounded(per.select("category", "image", "inside", "on_ring", (F.col("mean_inside") - F.col("mean_ring")).alias("contrast"),
                              "peak", share.alias("peak_percentile")), 5)


QUERIES["ring_contrast"] = ring_contrast
ORACLE["ring_contrast"] = f"""WITH RECURSIVE {SQL_MASK}, {SQL_SCORED} {SQL_UP8},
  rn AS (SELECT DISTINCT a.image, a.px FROM pxy a JOIN mk b ON b.image = a.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 ANTI JOIN mk c ON c.image = a.image AND c.px = a.px),
  s AS (SELECT u8.category, u8.image, u8.px, score, mk.px IS NOT NULL AS ins, rn.px IS NOT NULL AS rg FROM u8 LEFT JOIN mk ON mk.image = u8.image AND mk.px = u8.px LEFT JOIN rn ON rn.image = u8.image AND rn.px = u8.px),
  k AS (SELECT image, max(score) FILTER (ins) AS peak FROM s GROUP BY ALL)
SELECT category, image, count_if(ins) AS inside, count_if(rg) AS on_ring, {r('avg(score) FILTER (ins) - avg(score) FILTER (rg)', 5)} AS contrast, {r('any_value(peak)', 5)} AS peak,
  {r('count_if(score <= peak) / 64.0::DOUBLE', 5)} AS peak_percentile FROM s JOIN k USING (image) GROUP BY category, image"""


def region_statistics(spark, sf):
    s = I.region_statistics(masks(spark, sf), ["category", "image"], SIDE, SIDE, 1, 4)
    return rounded(s, 5)


QUERIES["region_statistics"] = region_statistics
ORACLE["region_statistics"] = f"""WITH RECURSIVE {SQL_POSE},
  rn AS (SELECT DISTINCT a.image, a.px, a.v FROM pxy a JOIN mk b ON b.image = a.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 ANTI JOIN mk c ON c.image = a.image AND c.px = a.px),
  rv AS (SELECT image, avg(v) AS m FROM rn GROUP BY ALL),
  eg AS (SELECT a.image, count(*) AS edges, avg((a.v - b.v) ** 2) AS energy FROM mk a JOIN mk b ON a.image = b.image AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.y = a.y + 1 AND b.x = a.x)) GROUP BY ALL),
  st AS (SELECT category, image, count(*) AS selected, count(DISTINCT y * 4 // 8 * 4 + x * 4 // 8) AS cells, avg(v) AS m, median(v) AS md FROM mk GROUP BY ALL)
SELECT st.category, st.image, CAST(selected AS INTEGER) AS selected, CAST(cells AS INTEGER) AS cells, CAST(coalesce(edges, 0) AS INTEGER) AS edges, {r('energy', 5)} AS gradient_energy,
  {r('st.m', 5)} AS mean, {r('md', 5)} AS median, {r('st.m - rv.m', 5)} AS contrast, {r('sqrt(12 * greatest(0, (xx + yy - sqrt((xx - yy) ** 2 + 4 * xy * xy)) / (2 * n)))', 5)} AS minor_width
FROM st JOIN p2 USING (image) LEFT JOIN rv USING (image) LEFT JOIN eg USING (image)"""


def cell_occupancy(spark, sf):
    """Mean object share of every cell over the normal images, and whether any of them ever reaches it."""
    o = I.occupancies(masks(spark, sf).where("NOT anomaly"), ["category", "image"], SIDE, SIDE, 2, 4)
    return rounded(o.groupBy("category", "cell").agg(F.avg("fraction").alias("mean_occupancy"), F.max("fraction").alias("max_occupancy"),
                                                     (F.max("fraction") > 0).alias("ever_object")))


QUERIES["cell_occupancy"] = cell_occupancy
SQL_OCC = SQL_MASK + """,
  gr AS (SELECT category, image, CAST(unnest(range(8)) AS INTEGER) AS cell FROM pix WHERE NOT anomaly),
  oc AS (SELECT gr.category, gr.image, gr.cell, count(mk.px) / 8.0::DOUBLE AS f FROM gr LEFT JOIN mk ON mk.image = gr.image AND mk.y // 4 * 4 + mk.x // 2 = gr.cell GROUP BY ALL)"""
ORACLE["cell_occupancy"] = f"WITH RECURSIVE {SQL_OCC} SELECT category, cell, {r('avg(f)')} AS mean_occupancy, {r('max(f)')} AS max_occupancy, max(f) > 0 AS ever_object FROM oc GROUP BY ALL"


def object_cell_scores(spark, sf):
    """Image AUROC with all cells, and without the cells whose mean occupancy over the normal images is below a third."""
    o = I.occupancies(masks(spark, sf).where("NOT anomaly"), ["category", "image"], SIDE, SIDE, 2, 4)
    background = kept(o.groupBy("category", "cell").agg(F.avg("fraction").alias("f")).where("f < 0.35"), "background")
    maps = kept(scored(spark, sf).where("split = 'test'"), "maps")
    restricted = maps.join(background.select("category", "cell"), ["category", "cell"], "left_anti")
    both = image_table(maps).withColumn("support", F.lit("all")).unionByName(image_table(restricted).withColumn("support", F.lit("object")))
    return rounded(E.auroc(both, ["category", "support"]))


QUERIES["object_cell_scores"] = object_cell_scores
ORACLE["object_cell_scores"] = f"""WITH RECURSIVE {SQL_OCC}, {SQL_SCORED},
  bk AS (SELECT category, cell FROM oc GROUP BY ALL HAVING avg(f) < .35),
  pr AS (SELECT category, image, anomaly, 'all' AS support, max(z) AS s FROM maps WHERE split = 'test' GROUP BY ALL
    UNION ALL SELECT category, image, anomaly, 'object', max(z) FROM maps ANTI JOIN bk USING (category, cell) WHERE split = 'test' GROUP BY ALL)
SELECT a.category, a.support, count(DISTINCT a.image) AS positives, count(DISTINCT b.image) AS negatives, {r('avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN .5 ELSE 0 END)')} AS auroc
FROM pr a JOIN pr b USING (category, support) WHERE a.anomaly AND NOT b.anomaly GROUP BY ALL"""


def mask_cells(spark, sf):
    """Grid cells of the turned frame that the silhouette's pixels fall into."""
    t = posed(spark, sf).select("image", "transform")
    # The transform meets the image's row, before there are pixels: the size that Spark sees at the join is the true one.
    whole = masks(spark, sf).select("category", "image", "mask").join(t, "image")
    px = whole.select("category", "image", "transform", F.posexplode("mask").alias("px", "inside")).where("inside")
    x, y = G.column_of(F.col("px"), SIDE).cast("double"), G.row_of(F.col("px"), SIDE).cast("double")
    tf = F.col("transform")
    cell = G.cell_at(G.forward_x(tf, x, y), G.forward_y(tf, x, y), 2.0, 4, 4)
    return px.select("category", "image", cell.alias("cell")).where("cell IS NOT NULL").groupBy("category", "image", "cell").agg(
        F.count(F.lit(1)).alias("pixels"))


QUERIES["mask_cells"] = mask_cells
ORACLE["mask_cells"] = f"""WITH RECURSIVE {SQL_MASK},
  tr AS (SELECT vec_id AS image, cos(a) AS co, sin(a) AS si, 3.5::DOUBLE - (cos(a) * 3.5::DOUBLE - sin(a) * 3.5::DOUBLE) AS tx, 3.5::DOUBLE - (sin(a) * 3.5::DOUBLE + cos(a) * 3.5::DOUBLE) AS ty
    FROM (SELECT vec_id, atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)) AS a FROM embeddings)),
  c AS (SELECT category, image, floor((co * x - si * y + tx + .5) / 2) AS cc, floor((si * x + co * y + ty + .5) / 2) AS cr FROM mk JOIN tr USING (image))
SELECT category, image, CAST(cr * 4 + cc AS INTEGER) AS cell, count(*) AS pixels FROM c WHERE cc BETWEEN 0 AND 3 AND cr BETWEEN 0 AND 3 GROUP BY ALL"""


def image_gradients(spark, sf):
    """Fixed-point luminance, gradient energy and content hash of every image."""
    rows = pixel_images(spark, sf)
    rgb = rows.withColumn("pixels", F.flatten(F.zip_with("pixels", F.reverse("pixels"), lambda a, b: F.array(a, b, F.lit(128)))))
    lum = I.luminances(rgb, ["category", "image"], SIDE, SIDE)
    return rounded(lum.select("category", "image", gradient_energy(SIDE, SIDE)("luminance").alias("gradient"), F.array_max("luminance").alias("brightest"),
                              F.sha2(F.array_join("luminance", ","), 256).alias("sha256")))


QUERIES["image_gradients"] = image_gradients
ORACLE["image_gradients"] = f"""WITH {SQL_PIX},
  l AS (SELECT category, image, list_transform(list_zip(p, list_reverse(p)), lambda t: (19595 * t[1] + 38470 * t[2] + 7471 * 128 + 32768) >> 16) AS l FROM pix),
  q AS (SELECT category, image, l, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS i FROM l),
  e AS (SELECT a.category, a.image, avg(CAST((a.v - b.v) AS DOUBLE) ** 2) AS g FROM q a JOIN q b ON a.image = b.image AND ((b.i = a.i + 1 AND a.i % 8 < 7) OR b.i = a.i + 8) GROUP BY ALL)
SELECT category, image, {r('g')} AS gradient, CAST(list_max(l) AS INTEGER) AS brightest, sha256(array_to_string(l, ',')) AS sha256 FROM e JOIN l USING (category, image)"""


# Detection from images with a stand-in encoder: the red plane of the 8x8 tensor as 2x4 blocks of 4x2 pixels.

def block_encoder():
    def encode(batch: np.ndarray) -> np.ndarray:
        red = batch[:, 0].astype(np.float64)
        n = len(red)
        return red.reshape(n, 2, 4, 4, 2).transpose(0, 1, 3, 2, 4).reshape(n, -1)

    return encode


def detected_images(spark, sf):
    """Resize, normalise, encode, fit, calibrate and score straight from pixels."""
    tensors = I.tensors(pixel_images(spark, sf).select(*KEEP, "pixels"), list(KEEP), SIDE, SIDE, SIDE)
    features = kept(I.encoded(tensors, block_encoder, (3, SIDE, SIDE), 8, 8), "features")
    u = M.units(features)
    model = kept(M.position_model(u.where("split = 'fit'")), "model")
    calibration = kept(M.position_calibration(M.raw_maps(u.where("split = 'calibration'"), model)), "calibration")
    return rounded(M.image_scores(I.detected(features.where("split = 'test'"), model, calibration)), 3)


QUERIES["detected_images"] = detected_images
ORACLE["detected_images"] = f"""WITH {SQL_PIX},
  x AS (SELECT category, image, split, y // 4 * 4 + x // 2 AS cell, y % 4 * 2 + x % 2 AS ch, CAST(CAST((v / 255.0::DOUBLE - .485::DOUBLE) / .229::DOUBLE AS FLOAT) AS DOUBLE) AS f FROM pxy),
  u AS (SELECT category, image, split, cell, ch, f / sqrt(sum(f * f) OVER (PARTITION BY image, cell)) AS u FROM x),
  mo AS (SELECT category, cell, ch, avg(u) AS m, greatest(stddev_samp(u), 1e-6) AS s FROM u WHERE split = 'fit' GROUP BY ALL),
  rw AS (SELECT category, image, split, cell, avg(((u - m) / s) * ((u - m) / s)) AS raw FROM u JOIN mo USING (category, cell, ch) GROUP BY ALL),
  ca AS (SELECT category, cell, avg(raw) AS a, greatest(stddev_samp(raw), 1e-6) AS b FROM rw WHERE split = 'calibration' GROUP BY ALL)
SELECT category, image, {r('max((raw - a) / b)', 3)} AS score FROM rw JOIN ca USING (category, cell) WHERE split = 'test' GROUP BY ALL"""


def canonical_preparation(spark, sf):
    """Pose then sampler: images whose pose failed keep their row, without a tensor."""
    p = I.canonical_tensors(pixel_images(spark, sf), ["category", "image"], SIDE, 4)
    return p.groupBy("category", "status", "reason").agg(F.count(F.lit(1)).alias("images"), F.count("tensor").alias("tensors"))


QUERIES["canonical_preparation"] = canonical_preparation
ORACLE["canonical_preparation"] = f"""WITH f AS ({ORACLE["fourfold_poses"]})
SELECT category, status, reason, count(*) AS images, count_if(status = 'SUCCESS') AS tensors FROM f GROUP BY ALL"""
