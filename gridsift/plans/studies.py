"""Queries: perturbation, nuisance, round trip and multi-seed studies on whole tables.

Each embedding is also read as an 8x8 grey image (pixel = 127.5 + 400 v, clamped
to 0..255). A photometric change acts on the pixels; the pixels over 255 are the
descriptors of a 2x4 grid, so a study is change -> describe -> score -> compare.
The second variant turns an image upside down when its lower half is brighter.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.images import photometry as PH
from gridsift.operators import evaluate as E
from gridsift.operators import moments as M
from gridsift.operators import nuisance as N
from gridsift.operators import paired as P
from gridsift.operators import splits as S
from gridsift.plans.views import CELLS, CHANNELS, images, r, rounded, table, units
from gridsift.session import kept

QUERIES, ORACLE = {}, {}

KEYS = ("variant", "category", "cell")


def pixel_images(spark, sf):
    px = F.transform("embedding", lambda v: F.floor(F.least(F.greatest(
        127.5 + 400.0 * v.cast("double"), F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int"))
    return images(spark, sf).withColumn("pixels", px).drop("embedding")


LEVELS = (0.8, 0.9, 1.0, 1.1, 1.2)
VARIANTS = ("identity", "canonical")


def with_variants(rows, variants=VARIANTS):
    """Identity, and turned so that the brighter half is on top; only the ``variants`` asked for are made."""
    half = lambda a, b: F.aggregate(F.slice("pixels", a, b), F.lit(0), lambda s, v: s + v)
    turned = F.when(half(33, 32) > half(1, 32), F.reverse("pixels")).otherwise(F.col("pixels"))
    made = {"identity": F.col("pixels"), "canonical": turned}
    both = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), made[v].alias("pixels")) for v in variants])).alias("_v")
    return rows.select(*[c for c in rows.columns if c != "pixels"], both).select(
        *[c for c in rows.columns if c != "pixels"], "_v.variant", "_v.pixels")


def pixel_features(rows):
    """One row per cell with its grey values over 255."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.transform(
        F.slice(F.col("pixels"), i * CHANNELS + 1, CHANNELS), lambda v: v / F.lit(255.0)))
    others = [c for c in rows.columns if c != "pixels"]
    return rows.select(*others, F.posexplode(cells).alias("cell", "x"))


def pixel_units(rows):
    return M.units(pixel_features(rows))


def conditions(rows, levels, families=PH.PHOTOMETRIC):
    grid = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(float(v)).alias("level")) for f in families for v in levels])
    spread = rows.select(*rows.columns, F.explode(grid).alias("_g")).select(*rows.columns, "_g.family", "_g.level")
    return spread.withColumn("_c", PH.photometric("pixels", "family", "level")).withColumn(
        "pixels", F.col("_c.pixels")).withColumn("clipped", F.col("_c.clipped")).drop("_c")




def nuisance_state(spark, sf, variants=VARIANTS):
    """(model, calibration) of the variants, from unchanged images."""
    f = pixel_features(with_variants(pixel_images(spark, sf), variants))
    model = kept(M.position_model(M.units(f.where("split = 'fit'")), KEYS), "model")
    raw = M.feature_maps(f.where("split = 'calibration'"), model, KEYS)
    return model, kept(M.position_calibration(raw, KEYS), "calibration")


def nuisance_maps(spark, sf, split="calibration", keep_units=False, variants=VARIANTS, levels=LEVELS, families=PH.PHOTOMETRIC):
    """Maps of every image of the split under every condition asked for; level 1 is the baseline."""
    model, calibration = nuisance_state(spark, sf, variants)
    # The change is applied before the variant turns the image, as a camera would.
    rows = conditions(pixel_images(spark, sf).where(F.col("split") == split), levels, families)
    f = pixel_features(with_variants(rows, variants))
    # Normalisation and distance are one Python pass, so a task has one worker less beside that of the change.
    raw = M.raw_maps(M.units(f).withColumn("unit", F.col("u")), model, KEYS) if keep_units else M.feature_maps(f, model, KEYS)
    maps = M.calibrated(raw, calibration, KEYS)
    return kept(maps, "nuisance"), model, calibration


def levels_sql(values):
    return ", ".join(f"CAST({v} AS DOUBLE)" for v in values)


def sql_nuisance(split="calibration", levels=LEVELS):
    return f"""
  pix AS (SELECT 'c' || (label % 2) AS category, vec_id AS image, label >= 6 AS anomaly,
      CASE WHEN label < 2 THEN 'fit' WHEN label < 4 THEN 'calibration' ELSE 'test' END AS split,
      list_transform(embedding, lambda v: CAST(floor(least(greatest(CAST(127.5 AS DOUBLE) + 400 * CAST(v AS DOUBLE), 0), 255) + 0.5) AS INT)) AS p
    FROM embeddings),
  cond AS (SELECT f.family, l.level FROM (SELECT unnest(['BRIGHTNESS', 'CONTRAST', 'GAMMA']) AS family) f,
      (SELECT unnest([{levels_sql(levels)}]) AS level) l),
  raw_changed AS (SELECT pix.* EXCLUDE (p), family, level, list_transform(p, lambda v: CASE family WHEN 'BRIGHTNESS' THEN v * level
      WHEN 'CONTRAST' THEN CAST(127.5 AS DOUBLE) + (v - CAST(127.5 AS DOUBLE)) * level ELSE 255 * pow(v / CAST(255 AS DOUBLE), level) END) AS q
    FROM pix, cond WHERE split = '{split}'),
  changed AS (SELECT * EXCLUDE (q), len(list_filter(q, lambda v: v < 0 OR v > 255)) AS clipped,
      list_transform(q, lambda v: CAST(floor(least(greatest(v, 0), 255) + 0.5) AS INT)) AS p FROM raw_changed),
  base AS (SELECT category, image, anomaly, split, '' AS family, CAST(1 AS DOUBLE) AS level, CAST(0 AS BIGINT) AS clipped, p FROM pix),
  every AS (SELECT category, image, anomaly, split, family, level, clipped, p, FALSE AS isbase FROM changed
            UNION ALL SELECT category, image, anomaly, split, family, level, clipped, p, TRUE FROM base),
  variants AS (SELECT * EXCLUDE (p), 'identity' AS variant, p FROM every
    UNION ALL SELECT * EXCLUDE (p), 'canonical', CASE WHEN list_sum(p[33:64]) > list_sum(p[1:32]) THEN list_reverse(p) ELSE p END FROM every),
  px AS (SELECT * EXCLUDE (p), unnest(p) / CAST(255 AS DOUBLE) AS x, generate_subscripts(p, 1) - 1 AS i FROM variants),
  cu AS (SELECT variant, category, image, anomaly, split, family, level, clipped, isbase, i // 8 AS cell, i % 8 AS ch,
      x / sqrt(sum(x * x) OVER (PARTITION BY variant, image, family, level, isbase, i // 8)) AS u FROM px),
  mo AS (SELECT variant, category, cell, ch, avg(u) AS mean, greatest(stddev_samp(u), 1e-6) AS std FROM cu
         WHERE isbase AND split = 'fit' GROUP BY ALL),
  rw AS (SELECT variant, category, image, anomaly, split, family, level, clipped, isbase, CAST(cell AS INTEGER) AS cell,
      avg(((u - mean) / std) * ((u - mean) / std)) AS raw
    FROM cu JOIN mo USING (variant, category, cell, ch) WHERE NOT isbase OR split = 'calibration' GROUP BY ALL),
  ca AS (SELECT variant, category, cell, avg(raw) AS alpha, greatest(stddev_samp(raw), 1e-6) AS beta FROM rw
         WHERE isbase AND split = 'calibration' GROUP BY ALL),
  nz AS (SELECT rw.*, (raw - alpha) / beta AS z FROM rw JOIN ca USING (variant, category, cell) WHERE NOT isbase),
  won AS (SELECT variant, category, image, family, level, max(z) AS max_z, max(raw) AS max_raw,
      first(cell ORDER BY z DESC, cell) AS max_cell, count_if(z > 3) AS cells_above_3, count_if(z > 5) AS cells_above_5,
      count_if(z > 10) AS cells_above_10 FROM nz GROUP BY ALL),
  rec AS (SELECT w.*, n.raw AS raw_at_winner, ca.alpha AS alpha_at_winner, ca.beta AS beta_at_winner,
      b.max_z AS baseline_max_z, b.max_raw AS baseline_max_raw, w.max_z - b.max_z AS delta_max_z,
      w.max_raw - b.max_raw AS delta_max_raw, n.raw - n0.raw AS raw_growth_at_winner,
      (n.raw - n0.raw) / ca.beta AS same_cell_z_growth, n0.z - b.max_z AS winner_switch_penalty
    FROM won w JOIN nz n ON n.variant = w.variant AND n.category = w.category AND n.image = w.image AND n.family = w.family
        AND n.level = w.level AND n.cell = w.max_cell
      JOIN ca ON ca.variant = w.variant AND ca.category = w.category AND ca.cell = w.max_cell
      JOIN won b ON b.variant = w.variant AND b.category = w.category AND b.image = w.image AND b.family = w.family AND b.level = 1
      JOIN nz n0 ON n0.variant = w.variant AND n0.category = w.category AND n0.image = w.image AND n0.family = w.family
        AND n0.level = 1 AND n0.cell = w.max_cell)"""


def records(spark, sf):
    maps, _, calibration = nuisance_maps(spark, sf)
    # Level 1 leaves the pixels as they are in every family, so one family's baseline serves all.
    baseline = maps.where("level = 1.0 AND family = 'BRIGHTNESS'")
    return kept(N.winner_records(maps, baseline, calibration), "records"), maps, calibration


def cell_state(model, calibration):
    std = F.aggregate("std", F.lit(0.0), lambda a, v: a + v) / F.size("std")
    return kept(model.withColumn("s", std).select("variant", "category", "cell", F.col("s").alias("std")).join(
        calibration.select("variant", "category", "cell", "beta"), list(KEYS)), "state")


def nuisance_records(spark, sf):
    return rounded(records(spark, sf)[0])


QUERIES["nuisance_records"] = nuisance_records
ORACLE["nuisance_records"] = f"""WITH {sql_nuisance()}
SELECT variant, category, image, family, level, max_cell, {", ".join(f"{r(c)} AS {c}" for c in (
    'max_z', 'max_raw', 'raw_at_winner', 'alpha_at_winner', 'beta_at_winner', 'baseline_max_z', 'baseline_max_raw', 'delta_max_z',
    'delta_max_raw', 'raw_growth_at_winner', 'same_cell_z_growth', 'winner_switch_penalty'))},
  cells_above_3, cells_above_5, cells_above_10 FROM rec"""


def nuisance_channels(spark, sf):
    """Which channels carry the raw growth of the winning cell."""
    maps, model, calibration = nuisance_maps(spark, sf, keep_units=True)
    keys = ["variant", "category", "image"]
    won = N.winners(maps, [*keys, "family", "level"]).select(*keys, "family", "level", F.col("max_cell").alias("cell"))
    now = won.join(maps.select(*keys, "family", "level", "cell", "unit"), [*keys, "family", "level", "cell"])
    then = maps.where("level = 1.0 AND family = 'BRIGHTNESS'").select(*keys, "cell", F.col("unit").alias("unit0"))
    joined = now.join(then, [*keys, "cell"]).join(model.select("variant", "category", "cell", "mean", "std"), list(KEYS))
    grown = joined.withColumn("growth", N.channel_growth(F.col("unit"), F.col("unit0"), F.col("mean"), F.col("std")))
    return rounded(grown.where("level <> 1.0").select(*keys, "family", "level", "cell", *N.contribution_shape("growth")), 5)


QUERIES["nuisance_channels"] = nuisance_channels
ORACLE["nuisance_channels"] = f"""WITH {sql_nuisance()},
  g AS (SELECT w.variant, w.category, w.image, w.family, w.level, w.max_cell AS cell, a.ch,
      (((a.u - mean) / std) ** 2 - ((b.u - mean) / std) ** 2) / 8 AS g
    FROM won w JOIN cu a ON NOT a.isbase AND a.variant = w.variant AND a.image = w.image AND a.family = w.family
        AND a.level = w.level AND a.cell = w.max_cell
      JOIN cu b ON NOT b.isbase AND b.variant = w.variant AND b.image = w.image AND b.family = w.family AND b.level = 1
        AND b.cell = w.max_cell AND b.ch = a.ch
      JOIN mo m ON m.variant = w.variant AND m.category = w.category AND m.cell = w.max_cell AND m.ch = a.ch WHERE w.level <> 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY variant, image, family, level ORDER BY g DESC) AS k FROM g)
SELECT variant, category, image, family, level, cell, CAST(count_if(g > 0) AS INTEGER) AS positive_channel_count,
  {r('coalesce(sum(greatest(g, 0)) FILTER (k <= 5) / nullif(sum(greatest(g, 0)), 0), 0)', 5)} AS top5_positive_growth_share,
  {r('coalesce(sum(greatest(g, 0)) ** 2 / nullif(sum(greatest(g, 0) ** 2), 0), 0)', 5)} AS positive_effective_participation
FROM k GROUP BY ALL"""


def pairs_of(recs):
    return N.amplification(recs, "identity", "canonical", ["category", "image", "family", "level"])


def nuisance_amplification(spark, sf):
    return rounded(pairs_of(records(spark, sf)[0]), 5)


SQL_AMP = sql_nuisance() + """,
  amp AS (SELECT i.category, i.image, i.family, i.level, i.delta_max_z AS first_change, c.delta_max_z AS second_change,
      c.delta_max_z - i.delta_max_z AS amplification,
      (c.raw_growth_at_winner - i.raw_growth_at_winner) / i.beta_at_winner AS raw_term,
      c.raw_growth_at_winner * (1 / c.beta_at_winner - 1 / i.beta_at_winner) AS scaling_term,
      c.winner_switch_penalty - i.winner_switch_penalty AS switch_term
    FROM rec i JOIN rec c USING (category, image, family, level) WHERE i.variant = 'identity' AND c.variant = 'canonical')"""
QUERIES["nuisance_amplification"] = nuisance_amplification
ORACLE["nuisance_amplification"] = f"""WITH {SQL_AMP}
SELECT category, image, family, level, {", ".join(f"{r(c, 5)} AS {c}" for c in (
    'first_change', 'second_change', 'amplification', 'raw_term', 'scaling_term', 'switch_term'))} FROM amp"""


def nuisance_responses(spark, sf):
    return rounded(N.response_summary(records(spark, sf)[0], ["max_z", "delta_max_z", "raw_growth_at_winner", "cells_above_3"]), 5)


QUERIES["nuisance_responses"] = nuisance_responses
ORACLE["nuisance_responses"] = f"""WITH {sql_nuisance()},
  f AS (SELECT family, level, variant, unnest([{{'k': 'max_z', 'v': max_z}}, {{'k': 'delta_max_z', 'v': delta_max_z}},
     {{'k': 'raw_growth_at_winner', 'v': raw_growth_at_winner}}, {{'k': 'cells_above_3', 'v': CAST(cells_above_3 AS DOUBLE)}}]) AS s FROM rec)
SELECT family, level, variant, s.k AS field, count(*) AS n, {r('min(s.v)', 5)} AS "min", {r('max(s.v)', 5)} AS "max",
  {r('avg(s.v)', 5)} AS mean, {r('quantile_cont(s.v, .05)', 5)} AS p05, {r('quantile_cont(s.v, .5)', 5)} AS p50,
  {r('quantile_cont(s.v, .95)', 5)} AS p95 FROM f GROUP BY ALL"""


def nuisance_stability(spark, sf):
    return N.family_stability(pairs_of(records(spark, sf)[0]).where("level <> 1.0"))


QUERIES["nuisance_stability"] = nuisance_stability
ORACLE["nuisance_stability"] = f"""WITH {SQL_AMP},
  p AS (SELECT family, category, image, max(abs(first_change)) AS a, max(abs(second_change)) AS b FROM amp WHERE level <> 1 GROUP BY ALL)
SELECT family, count(*) AS images, count_if(b > a) AS second_larger, count_if(a > b) AS first_larger, count_if(a = b) AS ties
FROM p GROUP BY ALL"""


def nuisance_worst(spark, sf):
    worst = N.worst_cases(pairs_of(records(spark, sf)[0]).where("level <> 1.0"), ["family"], 5)
    return rounded(worst.select("family", "place", "category", "image", "level", "amplification"), 5)


QUERIES["nuisance_worst"] = nuisance_worst
ORACLE["nuisance_worst"] = f"""WITH {SQL_AMP}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY family
    ORDER BY amplification DESC, category, image, level) AS INTEGER) AS place FROM amp WHERE level <> 1)
SELECT family, place, category, image, level, {r('amplification', 5)} AS amplification FROM k WHERE place <= 5"""


def nuisance_slopes(spark, sf):
    return rounded(N.slopes(records(spark, sf)[0]), 5)


QUERIES["nuisance_slopes"] = nuisance_slopes
ORACLE["nuisance_slopes"] = f"""WITH {sql_nuisance()},
  p AS (SELECT family, variant, category, image, max(max_z) FILTER (level = CAST(.9 AS DOUBLE)) AS a,
     max(max_z) FILTER (level = 1) AS b, max(max_z) FILTER (level = CAST(1.1 AS DOUBLE)) AS c FROM rec GROUP BY ALL)
SELECT family, variant, category, image, {r('(c - a) / (CAST(1.1 AS DOUBLE) - CAST(.9 AS DOUBLE))', 5)} AS centred_slope,
  {r('greatest(abs(a - b), abs(c - b)) / CAST(.1 AS DOUBLE)', 5)} AS one_sided FROM p"""


def sensitivity(spark, sf):
    maps, model, calibration = nuisance_maps(spark, sf)
    cells = kept(N.cell_sensitivity(maps), "sensitivity")
    return cells, cell_state(model, calibration)


SQL_SENS = sql_nuisance() + """,
  pc AS (SELECT family, variant, category, cell, image, max(z) FILTER (level = CAST(.9 AS DOUBLE)) AS a,
     max(z) FILTER (level = 1) AS b, max(z) FILTER (level = CAST(1.1 AS DOUBLE)) AS c FROM nz GROUP BY ALL),
  sens AS (SELECT family, variant, category, cell, avg(greatest(abs(a - b), abs(c - b)) / CAST(.1 AS DOUBLE)) AS sensitivity,
     avg(abs(c - a) / CAST(.2 AS DOUBLE)) AS centred_sensitivity FROM pc GROUP BY ALL),
  state AS (SELECT variant, category, CAST(cell AS INTEGER) AS cell, avg(std) AS std, any_value(beta) AS beta
            FROM mo JOIN ca USING (variant, category, cell) GROUP BY ALL)"""


def cell_sensitivity(spark, sf):
    return rounded(sensitivity(spark, sf)[0], 5)


QUERIES["cell_sensitivity"] = cell_sensitivity
ORACLE["cell_sensitivity"] = f"""WITH {SQL_SENS} SELECT family, variant, category, cell, {r('sensitivity', 5)} AS sensitivity,
  {r('centred_sensitivity', 5)} AS centred_sensitivity FROM sens"""


def state_sensitivity_ranks(spark, sf):
    """Spearman correlation of cell sensitivity with the cell's deviation and with its calibration scale."""
    cells, state = sensitivity(spark, sf)
    joined = kept(cells.join(state, list(KEYS)), "joined")
    keys = ["family", "variant", "category"]
    a = P.spearman(joined, keys, "sensitivity", "std").withColumnRenamed("spearman", "spearman_std")
    b = P.spearman(joined, keys, "sensitivity", "beta").select(*keys, F.col("spearman").alias("spearman_beta"))
    return rounded(a.join(b, keys))


QUERIES["state_sensitivity_ranks"] = state_sensitivity_ranks
ORACLE["state_sensitivity_ranks"] = f"""WITH {SQL_SENS},
  j AS (SELECT * FROM sens JOIN state USING (variant, category, cell)),
  k AS (SELECT family, variant, category, {", ".join(f'''rank() OVER (PARTITION BY family, variant, category ORDER BY {c})
     + (count(*) OVER (PARTITION BY family, variant, category, {c}) - 1) / 2.0::DOUBLE AS r_{c}''' for c in ('sensitivity', 'std', 'beta'))} FROM j)
SELECT family, variant, category, count(*) AS n, {r('corr(r_sensitivity, r_std)')} AS spearman_std,
  {r('corr(r_sensitivity, r_beta)')} AS spearman_beta FROM k GROUP BY ALL"""


def winner_buckets(spark, sf):
    maps, model, calibration = nuisance_maps(spark, sf)
    recs = N.winner_records(maps, maps.where("level = 1.0 AND family = 'BRIGHTNESS'"), calibration)
    return N.winner_buckets(recs.where("level <> 1.0"), cell_state(model, calibration))


QUERIES["winner_buckets"] = winner_buckets
ORACLE["winner_buckets"] = f"""WITH {SQL_SENS},
  q AS (SELECT variant, category, quantile_cont(std, .25) AS s, quantile_cont(beta, .25) AS b FROM state GROUP BY ALL),
  m AS (SELECT state.variant, state.category, cell, std <= s AS ls, beta <= b AS lb FROM state JOIN q USING (variant, category))
SELECT family, rec.variant, CASE WHEN ls AND lb THEN 'both' WHEN ls THEN 'low_std' WHEN lb THEN 'low_beta' ELSE 'neither' END AS bucket,
  count(*) AS winners FROM rec JOIN m ON m.variant = rec.variant AND m.category = rec.category AND m.cell = rec.max_cell
WHERE level <> 1 GROUP BY ALL"""


# Robustness of the test images ----------------------------------------------------------------------------------------

INNER = "cell % 4 IN (1, 2)"


def robustness_pairs(spark, sf):
    """Perturbed and original peak of every test image (whole map and inner columns), identity variant."""
    maps, model, calibration = nuisance_maps(spark, sf, split="test", variants=("identity",))
    peaks = maps.groupBy("category", "image", "anomaly", "family", "level").agg(
        F.max("z").alias("st"), F.max(F.when(F.expr(INNER), F.col("z"))).alias("interior_st"))
    original = peaks.where("level = 1.0 AND family = 'BRIGHTNESS'").select(
        "category", "image", F.col("st").alias("s0"), F.col("interior_st").alias("interior_s0"))
    held_out = pixel_features(with_variants(pixel_images(spark, sf).where("split = 'calibration'"), ("identity",)))
    scores = M.image_scores(M.calibrated(M.feature_maps(held_out, model, KEYS), calibration, KEYS))
    pairs = P.paired(peaks, original.drop("interior_s0")).join(original.select("category", "image", "interior_s0"), ["category", "image"])
    pairs = pairs.withColumn("interior_delta", F.col("interior_st") - F.col("interior_s0"))
    return kept(P.with_reference(pairs, scores), "pairs")


SQL_PAIRS = sql_nuisance("test") + f""",
  pk AS (SELECT category, image, anomaly, family, level, max(z) AS st, max(z) FILTER ({INNER}) AS interior_st FROM nz
         WHERE variant = 'identity' GROUP BY ALL),
  rf AS (SELECT category, max(z) AS reference FROM (SELECT rw.category, rw.image, (raw - alpha) / beta AS z FROM rw
     JOIN ca USING (variant, category, cell) WHERE isbase AND variant = 'identity') GROUP BY ALL),
  rp AS (SELECT a.*, b.st AS s0, b.interior_st AS interior_s0, a.st - b.st AS delta, a.interior_st - b.interior_st AS interior_delta,
     reference, a.st > reference AS exceeds FROM pk a JOIN pk b ON a.category = b.category AND a.image = b.image AND a.family = b.family
       AND b.level = 1 JOIN rf ON rf.category = a.category)"""


def robustness_summary(spark, sf):
    return rounded(P.robustness_summary(robustness_pairs(spark, sf), prefixes=["", "interior_"]), 5)


QUERIES["robustness_summary"] = robustness_summary


def _sql_delta(p, k=5):
    d = f"{p}delta"
    return f"""{r(f'median({p}s0)', k)} AS {p}median_s0, {r(f'median({p}st)', k)} AS {p}median_st,
  {r(f'median({d})', k)} AS {p}median_delta, {r(f'avg({d})', k)} AS {p}mean_delta, {r(f'quantile_cont({d}, .9)', k)} AS {p}p90_delta,
  {r(f'quantile_cont({d}, .95)', k)} AS {p}p95_delta, {r(f'max({d})', k)} AS {p}max_delta"""


SQL_ROBUST = f"""SELECT category, family, level, count(*) AS n, {_sql_delta('')}, {_sql_delta('interior_')},
  {r('avg(CAST(exceeds AS INT))', 5)} AS exceedance, {r('max(reference)', 5)} AS reference FROM rp GROUP BY ALL"""
ORACLE["robustness_summary"] = f"WITH {SQL_PAIRS} {SQL_ROBUST}"


def robustness_macro(spark, sf):
    rows = P.robustness_summary(robustness_pairs(spark, sf)).withColumn(
        "kind", F.when(F.col("category") == "c0", "texture").otherwise("object"))
    return rounded(E.macro_groups(rows, ["family", "level"], "kind", ["median_delta", "p95_delta", "exceedance"]), 5)


QUERIES["robustness_macro"] = robustness_macro
ORACLE["robustness_macro"] = f"""WITH {SQL_PAIRS},
  c AS (SELECT category, family, level, median(delta) AS m, quantile_cont(delta, .95) AS p, avg(CAST(exceeds AS INT)) AS e FROM rp GROUP BY ALL),
  g AS (SELECT *, unnest(['all', CASE category WHEN 'c0' THEN 'texture' ELSE 'object' END]) AS grp FROM c)
SELECT family, level, grp, count(*) AS categories, {r('avg(m)', 5)} AS median_delta, {r('avg(p)', 5)} AS p95_delta,
  {r('avg(e)', 5)} AS exceedance FROM g GROUP BY ALL"""


# Broken rules put into the pairs, so that each count has something to find: column, new value, and in which images.
PLANTED = (("delta", "delta + 1", 41), ("exceeds", "NOT exceeds", 43), ("level", "level * 7", 47), ("s0", "s0 + level - 1", 53))
PLANTED_TWICE = 37


def pairing_problems(spark, sf):
    """Counts of broken pairing rules in pairs of which some were broken on purpose."""
    pairs = robustness_pairs(spark, sf)
    pairs = pairs.select(*[F.expr(next((f"CASE WHEN image % {every} = 0 THEN {value} ELSE {name} END" for name, value, every in PLANTED if name == c), c)).alias(c)
                           for c in pairs.columns])
    return P.pairing_problems(pairs.unionByName(pairs.where(f"image % {PLANTED_TWICE} = 0")), {f: LEVELS for f in PH.PHOTOMETRIC})


QUERIES["pairing_problems"] = pairing_problems
_BROKEN = ", ".join(f"CASE WHEN image % {every} = 0 THEN {value} ELSE {name} END AS {name}" for name, value, every in PLANTED)
ORACLE["pairing_problems"] = f"""WITH {SQL_PAIRS},
  b AS (SELECT * REPLACE ({_BROKEN}) FROM rp), bp AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE image % {PLANTED_TWICE} = 0),
  o AS (SELECT category, image, family, level, count(*) AS n, min(s0) AS lo, max(s0) AS hi, count_if(abs(delta - (st - s0)) > 1e-12) AS d,
      count_if(exceeds <> (st > reference)) AS f, count_if(level NOT IN ({", ".join(str(v) for v in LEVELS)})) AS u FROM bp GROUP BY ALL),
  i AS (SELECT category, image, max(hi) - min(lo) > 1e-9 AS moved, count_if(n > 1) AS dup, sum(n) AS n, sum(d) AS d, sum(f) AS f, sum(u) AS u FROM o GROUP BY ALL)
SELECT category, CAST(sum(n) AS BIGINT) AS observations, count_if(moved) AS changed_originals, CAST(sum(dup) AS BIGINT) AS duplicates,
  CAST(sum(d) AS BIGINT) AS wrong_deltas, CAST(sum(f) AS BIGINT) AS wrong_flags, CAST(sum(u) AS BIGINT) AS unknown_levels FROM i GROUP BY ALL"""


def line_level(q):
    return F.floor((F.col(q) - 1) / 10).cast("double")


def line_pairs(spark, sf):
    """Line items as observations: a part is an image, a ten-unit quantity band is a level, price per unit the score."""
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_returnflag").alias("category"), F.col("l_partkey").alias("image"), F.lit("QUANTITY").alias("family"),
                     line_level("l_quantity").alias("level"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    per = rows.groupBy("category", "image", "family", "level").agg(F.max("price").alias("st"))
    original = rows.groupBy("category", "image").agg(F.min("price").alias("s0"))
    scores = li.where("l_linestatus = 'F'").groupBy(F.col("l_returnflag").alias("category"), "l_orderkey").agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("score"))
    return kept(P.with_reference(P.paired(per, original), scores), "line-pairs")


def line_robustness(spark, sf):
    return rounded(P.robustness_summary(line_pairs(spark, sf)), 3)


SQL_LINE = """WITH l AS (SELECT l_returnflag AS category, l_partkey AS image, 'QUANTITY' AS family, CAST(floor((l_quantity - 1) / 10) AS DOUBLE) AS level,
     l_extendedprice / l_quantity AS price, l_linestatus, l_orderkey FROM lineitem),
  o AS (SELECT category, image, min(price) AS s0 FROM l GROUP BY ALL),
  rf AS (SELECT category, max(s) AS reference FROM (SELECT category, l_orderkey, avg(price) AS s FROM l WHERE l_linestatus = 'F' GROUP BY ALL) GROUP BY ALL),
  rp AS (SELECT p.*, s0, st - s0 AS delta, reference, st > reference AS exceeds FROM
     (SELECT category, image, family, level, max(price) AS st FROM l GROUP BY ALL) p JOIN o USING (category, image) JOIN rf USING (category))"""
QUERIES["line_robustness"] = line_robustness
ORACLE["line_robustness"] = f"""{SQL_LINE} SELECT category, family, level, count(*) AS n, {_sql_delta('', 3)},
  {r('avg(CAST(exceeds AS INT))', 3)} AS exceedance, {r('max(reference)', 3)} AS reference FROM rp GROUP BY ALL"""


def line_grid_gaps(spark, sf):
    """Parts without a sale in some quantity band."""
    pairs = line_pairs(spark, sf)
    gaps = P.grid_gaps(pairs, pairs.select("category", "image").distinct(), {"QUANTITY": [0.0, 1.0, 2.0, 3.0, 4.0]})
    return gaps.groupBy("category", "family", "level").agg(F.count(F.lit(1)).alias("missing"))


QUERIES["line_grid_gaps"] = line_grid_gaps
ORACLE["line_grid_gaps"] = f"""{SQL_LINE},
  e AS (SELECT category, image, CAST(unnest(range(5)) AS DOUBLE) AS level FROM (SELECT DISTINCT category, image FROM rp))
SELECT category, 'QUANTITY' AS family, level, count(*) AS missing FROM e ANTI JOIN rp USING (category, image, level) GROUP BY ALL"""


def line_rank_correlation(spark, sf):
    return rounded(P.spearman(line_pairs(spark, sf), ["category"], "s0", "st"))


QUERIES["line_rank_correlation"] = line_rank_correlation
ORACLE["line_rank_correlation"] = f"""{SQL_LINE}, k AS (SELECT category,
    rank() OVER (PARTITION BY category ORDER BY s0) + (count(*) OVER (PARTITION BY category, s0) - 1) / 2.0::DOUBLE AS a,
    rank() OVER (PARTITION BY category ORDER BY st) + (count(*) OVER (PARTITION BY category, st) - 1) / 2.0::DOUBLE AS b FROM rp)
SELECT category, count(*) AS n, {r('corr(a, b)')} AS spearman FROM k GROUP BY ALL"""


def rotation_summary(spark, sf):
    return rounded(P.rotation_summary(robustness_pairs(spark, sf).where("level <> 1.0"), ["category", "family"]), 5)


QUERIES["rotation_summary"] = rotation_summary
SQL_ROT = SQL_PAIRS + """,
  md AS (SELECT category, family, level, median(delta) AS m FROM rp WHERE level <> 1 GROUP BY ALL),
  rot AS (SELECT category, family, count(*) AS levels, avg(abs(m)) AS mam FROM md GROUP BY ALL)"""
ORACLE["rotation_summary"] = f"WITH {SQL_ROT} SELECT category, family, levels, {r('mam', 5)} AS mean_absolute_median FROM rot"


def acceptance_gates(spark, sf):
    pairs = robustness_pairs(spark, sf)
    metrics = P.rotation_summary(pairs.where("level <> 1.0"), ["category", "family"]).join(
        pairs.groupBy("category", "family").agg(F.avg(F.col("exceeds").cast("double")).alias("exceedance")), ["category", "family"])
    gated = P.acceptance(metrics, {"small_shift": ("mean_absolute_median", "<=", 1.0), "few_alarms": ("exceedance", "<=", 0.25),
                                   "all_levels": ("levels", ">=", 4)})
    return rounded(gated, 5)


QUERIES["acceptance_gates"] = acceptance_gates
ORACLE["acceptance_gates"] = f"""WITH {SQL_ROT},
  x AS (SELECT category, family, avg(CAST(exceeds AS INT)) AS e FROM rp GROUP BY ALL)
SELECT category, family, levels, {r('mam', 5)} AS mean_absolute_median, {r('e', 5)} AS exceedance, mam <= 1 AS small_shift,
  e <= .25 AS few_alarms, levels >= 4 AS all_levels, mam <= 1 AND e <= .25 AND levels >= 4 AS qualifies FROM rot JOIN x USING (category, family)"""


# Round trip -----------------------------------------------------------------------------------------------------------

ROUND_TRIP = {"BRIGHTNESS": (0.8, 0.9, 1.1, 1.2), "CONTRAST": (0.8, 0.9, 1.1, 1.2)}


def round_trip(spark, sf):
    """Original, changed and changed-back maps of the test images; the change back uses the reciprocal level."""
    model, calibration = nuisance_state(spark, sf)
    rows = pixel_images(spark, sf).where("split = 'test'")
    grid = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(v).alias("level")) for f, vs in ROUND_TRIP.items() for v in vs])
    spread = rows.select(*rows.columns, F.explode(grid).alias("_g")).select(*rows.columns, "_g.*")
    there = spread.withColumn("changed", PH.photometric("pixels", "family", "level")["pixels"])
    back = there.withColumn("corrected", PH.photometric("changed", "family", 1 / F.col("level"))["pixels"])
    stages = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(c).alias("pixels")) for s, c in (
        ("s0", "pixels"), ("sp", "changed"), ("sc", "corrected"))])).alias("_s")
    keys = ["category", "image", "family", "level"]
    u = pixel_units(back.select(*keys, F.lit("identity").alias("variant"), stages).select(*keys, "variant", "_s.stage", "_s.pixels"))
    maps = kept(M.calibrated(M.raw_maps(u, model, KEYS), calibration, KEYS), "round-trip")
    return back.select(*keys, "pixels", "changed", "corrected"), maps, keys


def recovery_summary(spark, sf):
    _, maps, keys = round_trip(spark, sf)
    peak = lambda s: F.max(F.when(F.col("stage") == s, F.col("z"))).alias(s)
    return rounded(P.recovery_summary(kept(maps.groupBy(*keys).agg(peak("s0"), peak("sp"), peak("sc")), "triples"),
                                      ["category", "family", "level"]), 4)


QUERIES["recovery_summary"] = recovery_summary
SQL_TRIP = """
  pix AS (SELECT 'c' || (label % 2) AS category, vec_id AS image,
      CASE WHEN label < 2 THEN 'fit' WHEN label < 4 THEN 'calibration' ELSE 'test' END AS split,
      list_transform(embedding, lambda v: CAST(floor(least(greatest(CAST(127.5 AS DOUBLE) + 400 * CAST(v AS DOUBLE), 0), 255) + 0.5) AS INT)) AS p
    FROM embeddings),
  cond AS (SELECT f.family, l.level FROM (SELECT unnest(['BRIGHTNESS', 'CONTRAST']) AS family) f,
      (SELECT unnest([CAST(.8 AS DOUBLE), CAST(.9 AS DOUBLE), CAST(1.1 AS DOUBLE), CAST(1.2 AS DOUBLE)]) AS level) l),
  ch AS (SELECT pix.*, family, level, list_transform(p, lambda v: CAST(floor(least(greatest(CASE family WHEN 'BRIGHTNESS' THEN v * level
      ELSE CAST(127.5 AS DOUBLE) + (v - CAST(127.5 AS DOUBLE)) * level END, 0), 255) + 0.5) AS INT)) AS q FROM pix, cond WHERE split = 'test'),
  bk AS (SELECT *, list_transform(q, lambda v: CAST(floor(least(greatest(CASE family WHEN 'BRIGHTNESS' THEN v * (1 / level)
      ELSE CAST(127.5 AS DOUBLE) + (v - CAST(127.5 AS DOUBLE)) * (1 / level) END, 0), 255) + 0.5) AS INT)) AS c FROM ch),
  st AS (SELECT category, image, family, level, 's0' AS stage, split, p FROM bk UNION ALL SELECT category, image, family, level, 'sp', split, q FROM bk
     UNION ALL SELECT category, image, family, level, 'sc', split, c FROM bk
     UNION ALL SELECT category, image, '', 0, 'base', split, p FROM pix),
  px AS (SELECT * EXCLUDE (p), unnest(p) / CAST(255 AS DOUBLE) AS x, generate_subscripts(p, 1) - 1 AS i FROM st),
  cu AS (SELECT category, image, family, level, stage, split, i // 8 AS cell, i % 8 AS chn,
      x / sqrt(sum(x * x) OVER (PARTITION BY image, family, level, stage, i // 8)) AS u FROM px),
  mo AS (SELECT category, cell, chn, avg(u) AS mean, greatest(stddev_samp(u), 1e-6) AS std FROM cu WHERE stage = 'base' AND split = 'fit' GROUP BY ALL),
  rw AS (SELECT category, image, family, level, stage, split, cell, avg(((u - mean) / std) * ((u - mean) / std)) AS raw
    FROM cu JOIN mo USING (category, cell, chn) WHERE stage <> 'base' OR split = 'calibration' GROUP BY ALL),
  ca AS (SELECT category, cell, avg(raw) AS alpha, greatest(stddev_samp(raw), 1e-6) AS beta FROM rw WHERE stage = 'base' GROUP BY ALL),
  tz AS (SELECT category, image, family, level, stage, cell, (raw - alpha) / beta AS z FROM rw JOIN ca USING (category, cell) WHERE stage <> 'base'),
  tr AS (SELECT category, image, family, level, max(z) FILTER (stage = 's0') AS s0, max(z) FILTER (stage = 'sp') AS sp,
     max(z) FILTER (stage = 'sc') AS sc FROM tz GROUP BY ALL)"""
ORACLE["recovery_summary"] = f"""WITH {SQL_TRIP},
  d AS (SELECT *, sp - s0 AS dp, sc - s0 AS dc, CASE WHEN abs(sp - s0) > .1 THEN 1 - (sc - s0) / (sp - s0) END AS ratio FROM tr)
SELECT category, family, level, count(*) AS n, count(ratio) AS recovery_count, {r('avg(CAST(abs(dc) <= 1 AS INT))', 4)} AS within_1,
  {r('avg(CAST(abs(dc) <= 2 AS INT))', 4)} AS within_2, {r('avg(CAST(abs(dc) <= 5 AS INT))', 4)} AS within_5, {r('median(dp)', 4)} AS median_dp,
  {r('median(dc)', 4)} AS median_dc, {r('avg(dc)', 4)} AS mean_dc, {r('quantile_cont(dc, .9)', 4)} AS p90_dc,
  {r('quantile_cont(dc, .95)', 4)} AS p95_dc, {r('median(ratio)', 4)} AS median_recovery FROM d GROUP BY ALL"""


def map_errors(spark, sf):
    """Errors of the changed and the changed-back map, and their correlation with the pixel error."""
    rows, maps, keys = round_trip(spark, sf)
    z0 = maps.where("stage = 's0'").select(*keys, "cell", "z")
    out = None
    for stage, column in (("sp", "changed"), ("sc", "corrected")):
        err = P.map_errors(maps.where(F.col("stage") == stage).select(*keys, "cell", "z"), z0, keys, "cell", "z")
        d = F.aggregate(F.zip_with("pixels", column, lambda a, b: (a - b) * (a - b)), F.lit(0), lambda s, v: s + v)
        rgb = rows.select(*keys, F.sqrt(d / F.lit(64.0)).alias("rgb_rmse"))
        both = err.join(rgb, keys).withColumn("stage", F.lit(stage))
        out = both if out is None else out.unionByName(both)
    return rounded(out.groupBy("stage", "category", "family", "level").agg(
        F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.max("max").alias("max"), F.avg("rgb_rmse").alias("rgb_rmse"),
        P.pearson("rgb_rmse", "rmse").alias("pearson")), 4)


QUERIES["map_errors"] = map_errors
ORACLE["map_errors"] = f"""WITH {SQL_TRIP},
  e AS (SELECT a.stage, a.category, a.image, a.family, a.level, avg(abs(a.z - b.z)) AS mae, sqrt(avg((a.z - b.z) ** 2)) AS rmse, max(abs(a.z - b.z)) AS mx
    FROM tz a JOIN tz b USING (category, image, family, level, cell) WHERE a.stage <> 's0' AND b.stage = 's0' GROUP BY ALL),
  g AS (SELECT category, image, family, level, 'sp' AS stage, sqrt(list_sum(list_transform(list_zip(p, q), lambda t: (t[1] - t[2]) ** 2)) / 64) AS g FROM bk
    UNION ALL SELECT category, image, family, level, 'sc', sqrt(list_sum(list_transform(list_zip(p, c), lambda t: (t[1] - t[2]) ** 2)) / 64) FROM bk)
SELECT stage, category, family, level, {r('avg(mae)', 4)} AS mae, {r('avg(rmse)', 4)} AS rmse, {r('max(mx)', 4)} AS "max",
  {r('avg(g)', 4)} AS rgb_rmse, CASE WHEN stddev_pop(g) > 0 AND stddev_pop(rmse) > 0 THEN {r('corr(g, rmse)', 4)} END AS pearson
FROM e JOIN g USING (category, image, family, level, stage) GROUP BY ALL"""


# Splits and seeds -------------------------------------------------------------------------------------------------------

def document_names(spark, sf):
    return table(spark, sf, "documents").select(F.col("lang").alias("category"), F.concat(
        F.col("lang"), F.lit("_"), F.col("source"), F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("image"))


def hashed_split(spark, sf):
    return S.hashed_split(document_names(spark, sf).withColumn("seed", F.lit(42))).drop("seed")


SQL_SPLIT = """n AS (SELECT lang AS category, lang || '_' || source || '_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS image FROM documents),
  o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('42:' || image), image) AS ord,
     count(*) OVER (PARTITION BY category) AS n FROM n),
  sp AS (SELECT category, image, ord, CASE WHEN ord <= greatest(1, least(n - 2, n * 4 // 5)) THEN 'fit' ELSE 'calibration' END AS split FROM o)"""
QUERIES["hashed_split"] = hashed_split
ORACLE["hashed_split"] = f"WITH {SQL_SPLIT} SELECT category, image, ord, split FROM sp"


def seeded_split(spark, sf):
    """The seeded shuffle of sorted names, exact order."""
    return S.seeded_split(document_names(spark, sf), 42)


QUERIES["seeded_split"] = seeded_split
# One step of the shuffle, or one refused draw, per round; the list holds the sorted names' places.
ORACLE["seeded_split"] = f"""WITH RECURSIVE n AS (SELECT lang AS category, lang || '_' || source || '_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS image FROM documents),
  o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY image) AS p, count(*) OVER (PARTITION BY category) AS n FROM n),
  c AS (SELECT DISTINCT category, n FROM o),
  s AS (SELECT category, n AS i, CAST(xor(42, {S.MULTIPLIER}) AS HUGEINT) AS state, range(1, n + 1) AS items FROM c
    UNION ALL SELECT category, CASE WHEN taken THEN i - 1 ELSE i END, state,
      CASE WHEN taken THEN list_transform(items, lambda x, k: CASE WHEN k = i THEN items[j + 1] WHEN k = j + 1 THEN items[i] ELSE x END) ELSE items END
    FROM (SELECT *, CASE WHEN two THEN (i * bits) // 2147483648 ELSE bits % i END AS j, two OR bits - bits % i + i - 1 < 2147483648 AS taken
      FROM (SELECT category, i, items, next AS state, CAST(next // 131072 AS BIGINT) AS bits, (i & (i - 1)) = 0 AS two
        FROM (SELECT *, (state * {S.MULTIPLIER} + {S.INCREMENT}) % {S.MASK + 1} AS next FROM s WHERE i > 1)))),
  placed AS (SELECT category, unnest(items) AS p, unnest(range(1, len(items) + 1)) AS ord FROM s WHERE i = 1)
SELECT category, image, ord, CASE WHEN ord <= greatest(1, least(n - 2, n * 4 // 5)) THEN 'fit' ELSE 'calibration' END AS split
FROM o JOIN placed USING (category, p)"""


#: FIT names at multiples of this place are planted in the calibration half, too.
TAKEN_TWICE = 25


def split_checks(spark, sf):
    """Names in both FIT and calibration, and names that the two hold not as often as they should; some are put in twice on purpose."""
    names = document_names(spark, sf)
    split = kept(S.hashed_split(names.withColumn("seed", F.lit(42))), "split")
    fit, cal = split.where("split = 'fit'"), split.where(f"split = 'calibration' OR ord % {TAKEN_TWICE} = 0")
    both = S.overlap(fit, cal).groupBy("category").agg(F.count(F.lit(1)).alias("overlap"))
    off = S.set_difference(fit.unionByName(cal), names).groupBy("category").agg(F.count(F.lit(1)).alias("mismatch"))
    count = split.groupBy("category").agg(F.count_if(F.col("split") == "fit").alias("fit"),
                                          F.count_if(F.col("split") == "calibration").alias("calibration"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return count.join(both, "category", "left").join(off, "category", "left").select(
        "category", "fit", "calibration", zero("overlap"), zero("mismatch"))


QUERIES["split_checks"] = split_checks
ORACLE["split_checks"] = f"""WITH {SQL_SPLIT}, fit AS (SELECT category, image FROM sp WHERE split = 'fit'),
  cal AS (SELECT category, image FROM sp WHERE split = 'calibration' OR ord % {TAKEN_TWICE} = 0),
  have AS (SELECT category, image, count(*) AS k FROM (SELECT * FROM fit UNION ALL SELECT * FROM cal) GROUP BY ALL),
  want AS (SELECT category, image, count(*) AS k FROM n GROUP BY ALL),
  off AS (SELECT coalesce(h.category, w.category) AS category, sum(abs(coalesce(h.k, 0) - coalesce(w.k, 0))) AS m
    FROM have h FULL JOIN want w ON h.category = w.category AND h.image = w.image GROUP BY ALL),
  common AS (SELECT category, count(*) AS c FROM (SELECT * FROM fit INTERSECT SELECT * FROM cal) GROUP BY ALL)
SELECT category, count_if(split = 'fit') AS fit, count_if(split = 'calibration') AS calibration,
  CAST(coalesce(any_value(c), 0) AS BIGINT) AS overlap, CAST(coalesce(any_value(m), 0) AS BIGINT) AS mismatch
FROM sp LEFT JOIN common USING (category) LEFT JOIN off USING (category) GROUP BY category"""


def first_of_split(spark, sf):
    split = S.hashed_split(document_names(spark, sf).withColumn("seed", F.lit(42))).where("split = 'fit'")
    return S.first_per_category(split, 12).select("category", "image", "ord", "place")


QUERIES["first_of_split"] = first_of_split
ORACLE["first_of_split"] = f"""WITH {SQL_SPLIT}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY ord) AS INTEGER) AS place FROM sp WHERE split = 'fit')
SELECT category, image, ord, place FROM k WHERE place <= 12"""


SEEDS = (1, 2, 3, 4, 5)


def seed_runs(spark, sf):
    """Raw and calibrated image AUROC of five splits of the normal training images, all seeds in one job."""
    u = units(spark, sf)
    normal = u.where("split IN ('fit', 'calibration')").select("category", "image").distinct()
    seeds = F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed")
    split = kept(S.hashed_split(normal.select("category", "image", seeds), ["seed", "category"]), "split")
    keys = ["seed", "category", "cell"]
    training = u.drop("split").join(split.select("seed", "category", "image", "split"), ["category", "image"])
    model = kept(M.position_model(training.where("split = 'fit'"), keys), "model")
    held_out = M.raw_maps(training.where("split = 'calibration'"), model, keys)
    calibration = kept(M.position_calibration(held_out, keys), "calibration")
    test = u.where("split = 'test'").select("category", "image", "anomaly", "cell", "u", seeds)
    z = M.calibrated(M.raw_maps(test, model, keys), calibration, keys)
    per = z.groupBy("seed", "category", "image", "anomaly").agg(F.max("raw").alias("raw"), F.max("z").alias("calibrated"))
    both = per.select("seed", "anomaly", "category", F.explode(F.array(*[F.struct(F.lit(b).alias("branch"), F.col(b).alias("score"))
                      for b in ("raw", "calibrated")])).alias("_b")).select("seed", "anomaly", "category", "_b.*")
    return kept(E.auroc(both, ["seed", "branch", "category"]), "runs")


def seed_metrics(spark, sf):
    return rounded(seed_runs(spark, sf).select("seed", "branch", "category", "auroc"))


SQL_SEEDS = """WITH f AS (SELECT 'c' || (label % 2) AS category, vec_id AS image, label, CAST(c.cell AS INT) AS cell,
     CAST(list_slice(embedding, c.cell * 8 + 1, c.cell * 8 + 8) AS DOUBLE[]) AS x FROM embeddings, (SELECT unnest(range(8)) AS cell) c),
  l AS (SELECT category, image, label, cell, unnest(list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda w: w * w))))) AS v,
     generate_subscripts(x, 1) AS ch FROM f),
  s AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS seed),
  o AS (SELECT seed, 'c' || (label % 2) AS category, vec_id AS image, row_number() OVER (PARTITION BY seed, label % 2 ORDER BY sha256(seed || ':' || vec_id), vec_id) AS ord,
     count(*) OVER (PARTITION BY seed, label % 2) AS n FROM embeddings, s WHERE label < 4),
  sp AS (SELECT seed, category, image, ord <= greatest(1, least(n - 2, n * 4 // 5)) AS fit FROM o),
  mo AS (SELECT seed, l.category, cell, ch, avg(v) AS m, greatest(stddev_samp(v), 1e-6) AS sd FROM l JOIN sp ON sp.image = l.image WHERE fit GROUP BY ALL),
  rw AS (SELECT mo.seed, l.category, l.image, label, cell, avg(((v - m) / sd) * ((v - m) / sd)) AS raw FROM l JOIN mo USING (category, cell, ch) GROUP BY ALL),
  ca AS (SELECT rw.seed, rw.category, cell, avg(raw) AS alpha, greatest(stddev_samp(raw), 1e-6) AS beta FROM rw JOIN sp ON sp.seed = rw.seed AND sp.image = rw.image
     WHERE NOT fit GROUP BY ALL),
  im AS (SELECT seed, category, image, label >= 6 AS anomaly, max(raw) AS raw, max((raw - alpha) / beta) AS calibrated FROM rw JOIN ca USING (seed, category, cell)
     WHERE label >= 4 GROUP BY ALL),
  b AS (SELECT seed, category, image, anomaly, 'raw' AS branch, raw AS s FROM im UNION ALL SELECT seed, category, image, anomaly, 'calibrated', calibrated FROM im),
  runs AS (SELECT p.seed, p.branch, p.category, avg(CASE WHEN p.s > g.s THEN 1.0 WHEN p.s = g.s THEN .5 ELSE 0 END) AS auroc
     FROM b p JOIN b g USING (seed, branch, category) WHERE p.anomaly AND NOT g.anomaly GROUP BY ALL)"""
QUERIES["seed_metrics"] = seed_metrics
ORACLE["seed_metrics"] = f"{SQL_SEEDS} SELECT seed, branch, category, {r('auroc')} AS auroc FROM runs"


def wide_runs(spark, sf):
    return seed_runs(spark, sf).groupBy("seed", "branch").pivot("category", ["c0", "c1"]).agg(F.first("auroc"))


def seed_summary(spark, sf):
    return rounded(P.seed_summary(wide_runs(spark, sf), ["c0", "c1"]))


SQL_DELTA = SQL_SEEDS + """,
  dl AS (SELECT seed, category, max(auroc) FILTER (branch = 'raw') AS raw, max(auroc) FILTER (branch = 'calibrated') AS cal FROM runs GROUP BY ALL),
  ev AS (SELECT seed, category AS metric, 'raw' AS branch, raw AS v FROM dl UNION ALL SELECT seed, category, 'calibrated', cal FROM dl
     UNION ALL SELECT seed, category, 'delta', cal - raw FROM dl)"""
QUERIES["seed_summary"] = seed_summary
ORACLE["seed_summary"] = f"""{SQL_DELTA} SELECT branch, metric, count(*) AS n, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS sample_std,
  {r('min(v)')} AS "min", {r('max(v)')} AS "max" FROM ev GROUP BY ALL"""


def seed_signs(spark, sf):
    wide = seed_runs(spark, sf).groupBy("seed", "category").pivot("branch", ["raw", "calibrated"]).agg(F.first("auroc"))
    deltas = wide.select("seed", F.col("category").alias("metric"), F.round(F.col("calibrated") - F.col("raw"), 12).alias("delta"))
    return P.sign_counts(deltas, ["metric"])


QUERIES["seed_signs"] = seed_signs
ORACLE["seed_signs"] = f"""{SQL_DELTA} SELECT metric, count_if(round(v, 12) > 0) AS positive, count_if(round(v, 12) = 0) AS zero,
  count_if(round(v, 12) < 0) AS negative, bool_and(round(v, 12) > 0) AS all_positive FROM ev WHERE branch = 'delta' GROUP BY ALL"""
