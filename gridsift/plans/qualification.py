"""Queries: fits of the survivors, diagnosis of single defects, gates against a reference kernel, evaluation behind a gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.operators import correspondence as C
from gridsift.operators import evaluate as E
from gridsift.operators import imaging as I
from gridsift.operators import moments as M
from gridsift.operators import paired as P
from gridsift.operators import qualification as Q
from gridsift.plans import evaluation as EV
from gridsift.plans import geometry as GE
from gridsift.plans import imaging as IM
from gridsift.plans import operations as OP
from gridsift.plans.contracts import place
from gridsift.plans.reports import framing_states
from gridsift.plans.views import HEIGHT, SQL_MODEL, SQL_SCORED, WIDTH, features, image_table, r, rounded, scored
from gridsift.session import kept
from gridsift.sources import maps as map_files

QUERIES, ORACLE = {}, {}

#: In SQL the survivors are what is left of the table; everything is fitted on them from scratch.
SURVIVORS = "FROM (SELECT * FROM embeddings WHERE CAST(embedding[9] AS DOUBLE) <= .2)"


def _of_survivors(sql):
    return sql.replace("FROM embeddings", SURVIVORS)


def _auc(sql):
    return f"(WITH {sql} SELECT category, positives, negatives, auroc FROM auc WHERE method = 'z')"


def attempts(spark, sf):
    """Every image and whether its object was found."""
    return OP.poses(spark, sf).select("category", "image", "defect", "split", (F.col("state") != "SEGMENTATION_FAILURE").alias("usable"))


def survivors_model(spark, sf, tried):
    """Model of the FIT images that did not fail: the moments of all, without those of the few that failed."""
    fit = features(spark, sf).where("split = 'fit'")
    every = kept(M.channel_moments(M.units(fit), M.POSITION), "moments")
    lost = fit.join(tried.where("split = 'fit' AND NOT usable").select("image"), "image", "left_semi")
    return kept(Q.model_of(Q.taken_back(every, M.channel_moments(M.units(lost), M.POSITION), M.POSITION), M.POSITION), "model")


def survivor_model(spark, sf):
    """Size, mean length and mean deviation of each position of the survivors' model."""
    model = survivors_model(spark, sf, kept(attempts(spark, sf), "attempts"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    return rounded(model.select("category", "cell", "n", F.col("mean")[0].alias("first_mean"), mean("mean").alias("mean"), mean("std").alias("std")), 9)


QUERIES["survivor_model"] = survivor_model
ORACLE["survivor_model"] = f"""WITH {_of_survivors(SQL_MODEL)}
SELECT category, cell, max(n) AS n, {r('max(mean) FILTER (ch = 1)', 9)} AS first_mean, {r('avg(mean)', 9)} AS mean, {r('avg(std)', 9)} AS std FROM model GROUP BY ALL"""


def survivor_coverage(spark, sf):
    """Attempted, usable and failed images per category, split and defect."""
    return Q.survivor_coverage(attempts(spark, sf), ["category", "split", "defect"])


QUERIES["survivor_coverage"] = survivor_coverage
ORACLE["survivor_coverage"] = f"""WITH {OP.SQL_POSES}
SELECT category, split, defect, count(*) AS attempted, count_if(state <> 'SEGMENTATION_FAILURE') AS usable, count_if(state = 'SEGMENTATION_FAILURE') AS failed,
  CASE WHEN count_if(state = 'SEGMENTATION_FAILURE') = 0 THEN 'FULL_POPULATION' ELSE 'SURVIVOR_ONLY' END AS metric_scope FROM poses GROUP BY ALL"""


def survivor_qualification(spark, sf):
    """Image AUROC of the test survivors under a fit and calibration of survivors only, against all images under the fit of all."""
    tried = kept(attempts(spark, sf), "attempts")
    model = survivors_model(spark, sf, tried)
    usable = tried.where("usable").select("image")
    alive = features(spark, sf).where("split <> 'fit'").join(usable, "image", "left_semi")
    raw = kept(M.feature_maps(alive, model).select("category", "image", "defect", "split", "anomaly", "cell", "raw"), "raw")
    calibration = kept(M.position_calibration(raw.where("split = 'calibration'")), "calibration")
    after = E.auroc(image_table(M.calibrated(raw.where("split = 'test'"), calibration)), ["category"])
    before = E.auroc(image_table(scored(spark, sf)).where("split = 'test'"), ["category"])
    sizes = model.groupBy("category").agg(F.max("n").alias("fit_n")).join(calibration.groupBy("category").agg(F.max("n").alias("calibration_n")), "category")
    cover = Q.survivor_coverage(tried.where("split = 'test'"), ["category"])
    return rounded(cover.join(sizes, "category").join(after.select("category", F.col("positives").alias("n_anomaly"), F.col("negatives").alias("n_good"), "auroc"), "category", "left")
                   .join(before.select("category", F.col("auroc").alias("baseline")), "category", "left").withColumn("delta", F.col("auroc") - F.col("baseline")))


QUERIES["survivor_qualification"] = survivor_qualification
ORACLE["survivor_qualification"] = f"""WITH cover AS ({ORACLE['survivor_coverage'].replace('category, split, defect, count', 'category, count').replace('FROM poses', "FROM poses WHERE split = 'test'")}),
  a AS {_auc(_of_survivors(EV.SQL_LONG))}, b AS {_auc(EV.SQL_LONG)},
  n AS (WITH {_of_survivors(SQL_SCORED)} SELECT category, max(m.n) AS fit_n, max(c.n) AS calibration_n FROM model m JOIN calibration c USING (category) GROUP BY ALL)
SELECT cover.*, fit_n, calibration_n, a.positives AS n_anomaly, a.negatives AS n_good, {r('a.auroc')} AS auroc, {r('b.auroc')} AS baseline, {r('a.auroc - b.auroc')} AS delta
FROM cover JOIN n USING (category) LEFT JOIN a USING (category) LEFT JOIN b USING (category)"""


def defect_diagnosis(spark, sf):
    """Raw and calibrated AUROC of every defect and why it separates badly."""
    auc = E.auroc_by_defect(EV.test_scores(spark, sf), ["method", "category"])
    at = lambda m: F.max(F.when(F.col("method") == m, F.col("auroc"))).alias(m)
    both = auc.groupBy("category", "defect").agg(at("raw"), at("z"))
    return rounded(both.withColumn("label", Q.defect_label(F.col("raw"), F.col("z"))))


QUERIES["defect_diagnosis"] = defect_diagnosis
ORACLE["defect_diagnosis"] = f"""WITH {EV.SQL_LONG},
  d AS (SELECT p.category, p.defect, p.method, avg(CASE WHEN p.score > g.score THEN 1.0::DOUBLE WHEN p.score = g.score THEN 0.5 ELSE 0 END) AS auroc
    FROM test p JOIN test g USING (method, category) WHERE p.anomaly AND NOT g.anomaly GROUP BY ALL),
  w AS (SELECT category, defect, max(auroc) FILTER (method = 'raw') AS raw, max(auroc) FILTER (method = 'z') AS z FROM d GROUP BY ALL)
SELECT category, defect, {r('raw')} AS raw, {r('z')} AS z, CASE WHEN raw < .7 AND z < .7 THEN 'RAW_REPRESENTATION_LIMIT' WHEN z - raw < -.1 THEN 'Z_CALIBRATION_DAMAGE' ELSE 'MIXED' END AS label FROM w"""


# Kernels as candidates. A turned image on 4x4 samples is a 2x2 grid of 4 channels; the bicubic kernel is the reference, the
# grid of the image as it stands the baseline. The answer to rotations is measured before the kernel, so all kernels share it.

def kernel_evidence(spark, sf):
    """Per kernel and category: image AUROC of its own fit, coherence and deviation of the FIT units, rotation, framing."""
    rows = kept(IM.posed(spark, sf).select("category", "image", "split", "anomaly", "pixels", "transform"), "posed")
    keys = ["category", "image", "split", "anomaly"]
    out = None
    for kernel in ("bilinear", "bicubic", "tent"):
        s = I.canonical_samples(rows, keys, IM.SIDE, 4, kernel).withColumn("kernel", F.lit(kernel))
        out = s if out is None else out.unionByName(s)
    at = lambda r_, c: F.array(*[F.element_at("values", 4 * (2 * r_ + i) + 2 * c + j + 1) for i in (0, 1) for j in (0, 1)])
    cells = F.array(*[at(r_, c) for r_ in (0, 1) for c in (0, 1)])
    units = kept(M.units(out.select("kernel", *keys, F.posexplode(cells).alias("cell", "x"))), "kernel-units")
    by = ["kernel", "category", "cell"]
    model = kept(M.position_model(units.where("split = 'fit'"), by), "model")
    raw = kept(M.raw_maps(units.where("split <> 'fit'"), model, by).select(*by, "image", "split", "anomaly", "raw"), "raw")
    calibration = kept(M.position_calibration(raw.where("split = 'calibration'"), by), "calibration")
    peaks = M.image_scores(M.calibrated(raw.where("split = 'test'"), calibration, by), ["kernel", "category", "image", "anomaly"]).withColumn("score", F.round("score", 9))
    quality = E.auroc(peaks, ["kernel", "category"]).select("kernel", "category", F.col("auroc").alias("image_auroc"))
    named = model.withColumn("category", F.concat_ws("/", "kernel", "category"))
    split = F.split("category", "/")
    coherent = C.coherence(named).groupBy("category").agg(F.avg("cosine_mean").alias("cosine_mean")).select(split[0].alias("kernel"), split[1].alias("category"), "cosine_mean")
    # The model holds one deviation per cell and channel: a group is bounded by the grid.
    spread = model.select("kernel", "category", F.explode("std_sample").alias("s")).groupBy("kernel", "category").agg(F.median("s").alias("median_std"))
    _, maps, trip = GE.geometric_maps(spark, sf)
    turned = maps.where("family = 'ROTATION'").groupBy(*trip).agg((F.max("sp") - F.max("s0")).alias("delta"))
    rotation = P.rotation_summary(kept(turned, "turned"), ["category"]).select("category", F.col("mean_absolute_median").alias("rotation"))
    framed = framing_states(spark, sf).where("split = 'fit'").groupBy("category").agg(F.bool_and(F.col("frame") != "CLIPPED").alias("geometry"))
    return quality.join(coherent, ["kernel", "category"]).join(spread, ["kernel", "category"]).join(rotation, "category").join(framed, "category")


def kernel_acceptance(spark, sf):
    """Which resampling kernel holds all gates against the reference kernel and the unaligned baseline."""
    evidence = kept(kernel_evidence(spark, sf), "evidence")
    baseline = E.auroc(image_table(scored(spark, sf)).where("split = 'test'"), ["category"]).select("category", F.col("auroc").alias("image_auroc"))
    return rounded(Q.relative_gates(evidence, evidence.where("kernel = 'bicubic'"), baseline, ["category"], ["image_auroc"]), 5)


QUERIES["kernel_acceptance"] = kernel_acceptance
ORACLE["kernel_acceptance"] = f"""WITH ev AS ({IM.ORACLE["canonical_samples"].rsplit("SELECT kernel", 1)[0]},
    x AS (SELECT kernel, category, image, label, i // 4 // 2 * 2 + i % 4 // 2 AS cell, i // 4 % 2 * 2 + i % 4 % 2 AS ch, least(greatest(v, 0), 255) AS v FROM every JOIN embeddings ON vec_id = image),
    u AS (SELECT kernel, category, image, label, cell, ch, v / sqrt(sum(v * v) OVER (PARTITION BY kernel, image, cell)) AS u FROM x),
    m AS (SELECT kernel, category, cell, ch, count(*) AS n, avg(u) AS m, stddev_samp(u) AS s FROM u WHERE label < 2 GROUP BY ALL),
    c AS (SELECT kernel, category, cell, (any_value(n) * sum(m * m) - 1) / (any_value(n) - 1) AS cm FROM m GROUP BY ALL),
    rw AS (SELECT kernel, category, image, label, cell, avg(((u - m) / greatest(s, 1e-6)) ** 2) AS raw FROM u JOIN m USING (kernel, category, cell, ch) WHERE label >= 2 GROUP BY ALL),
    k AS (SELECT kernel, category, cell, avg(raw) AS alpha, greatest(stddev_samp(raw), 1e-6) AS beta FROM rw WHERE label IN (2, 3) GROUP BY ALL),
    s AS (SELECT kernel, category, image, label >= 6 AS anomaly, round(max((raw - alpha) / beta), 9) AS s FROM rw JOIN k USING (kernel, category, cell) WHERE label >= 4 GROUP BY ALL),
    a AS (SELECT p.kernel, p.category, avg(CASE WHEN p.s > g.s THEN 1.0::DOUBLE WHEN p.s = g.s THEN .5 ELSE 0 END) AS image_auroc FROM s p JOIN s g USING (kernel, category)
      WHERE p.anomaly AND NOT g.anomaly GROUP BY ALL),
    cc AS (SELECT kernel, category, avg(cm) AS cosine_mean FROM c GROUP BY ALL),
    md AS (SELECT kernel, category, median(s) AS median_std FROM m GROUP BY ALL)
    SELECT * FROM a JOIN cc USING (kernel, category) JOIN md USING (kernel, category)),
  ro AS (WITH {GE.SQL_GEOMETRY}, l AS (SELECT category, level, median(sp - s0) AS d FROM tr WHERE family = 'ROTATION' GROUP BY ALL)
    SELECT category, avg(abs(d)) AS rotation FROM l GROUP BY ALL),
  fr AS (WITH {OP.SQL_FRAMED}, {OP.SQL_POSES} SELECT fm.category, bool_and(state = 'SEGMENTATION_FAILURE' OR support_outside = 0) AS geometry
    FROM fm JOIN poses USING (image) WHERE fm.split = 'fit' GROUP BY ALL),
  b AS {_auc(EV.SQL_LONG)},
  g AS (SELECT ev.*, rotation, geometry, ev.image_auroc >= f.image_auroc - .01 AS quality_loss, ev.image_auroc > b.auroc AS above_unaligned, ev.median_std <= 1.1 * f.median_std AS median_std_gate,
     ev.cosine_mean >= f.cosine_mean - .02 AS cosine_gate, rotation <= 1 AS rotation_gate, geometry AS geometry_gate
   FROM ev JOIN ev f ON f.category = ev.category AND f.kernel = 'bicubic' JOIN ro ON ro.category = ev.category JOIN fr ON fr.category = ev.category JOIN b ON b.category = ev.category)
SELECT * REPLACE ({r('image_auroc', 5)} AS image_auroc, {r('cosine_mean', 5)} AS cosine_mean, {r('median_std', 5)} AS median_std, {r('rotation', 5)} AS rotation),
  quality_loss AND above_unaligned AND median_std_gate AND cosine_gate AND rotation_gate AND geometry_gate AS qualifies FROM g"""


# Two runs of the same method: one as it should be, one with faults planted in it: predictions of c0, map files of c1.

IDENTITY = {"geometry_id": "grid-2x4", "score_kind": "evaluated", "format_id": "anomaly-map-v1"}


def _written(spark, arrays, run):
    """Map files of one run: those of the spoiled run's category c1 name another geometry, those of its defect d9 another kind."""
    path = place(spark, f"run-{run}")
    spoiled = F.lit(run == "spoiled") & (F.col("category") == "c1")
    parts = ((~spoiled, IDENTITY), (spoiled & (F.col("defect") != "d9"), IDENTITY | {"geometry_id": "grid-4x2"}),
             (spoiled & (F.col("defect") == "d9"), IDENTITY | {"score_kind": "native"}))
    for where, names in parts if run == "spoiled" else parts[:1]:
        done = map_files.write_arrays(arrays.where(where).select("image", "map"), path, height=HEIGHT, width=WIDTH, **names)
        kept(done, "written")
    return path


def _map_problems(spark, arrays, path):
    expected = arrays.select(F.col("image").cast("string").alias("stem"), "image", *[F.lit(IDENTITY[k]).alias(n) for n, k in (
        ("geometry_id", "geometry_id"), ("score_kind", "score_kind"), ("format", "format_id"))])
    back, sidecars = map_files.read_once(spark, path)
    return back, map_files.sidecar_problems(back, sidecars, expected)


def map_file_identity(spark, sf):
    """Map files whose sidecars name another geometry or kind of score than the run's."""
    arrays = kept(EV.test_arrays(spark, sf), "arrays")
    return _map_problems(spark, arrays, _written(spark, arrays, "spoiled"))[1]


QUERIES["map_file_identity"] = map_file_identity
ORACLE["map_file_identity"] = """SELECT CAST(vec_id AS VARCHAR) AS stem, CASE label WHEN 9 THEN 'score_kind' ELSE 'geometry_id' END AS problem FROM embeddings WHERE label >= 4 AND label % 2 = 1"""


def runs(spark, sf):
    """(predictions, arrays read back, expected, problems) of both runs."""
    arrays = kept(EV.test_arrays(spark, sf), "arrays")
    named = F.explode(F.array(F.lit("sound"), F.lit("spoiled"))).alias("run_id")
    scores = image_table(scored(spark, sf)).where("split = 'test'")
    flipped = (F.col("run_id") == "spoiled") & (F.col("category") == "c0")
    label = F.when(F.col("anomaly") != (flipped & (F.pmod(F.col("image"), F.lit(50)) == 0)), "anomaly").otherwise("good")
    lost = flipped & (F.pmod(F.col("image"), F.lit(70)) == 0)
    predictions = kept(scores.select("*", named).select("run_id", "category", F.col("image").alias("filename"), label.alias("label"), "defect",
                                                        F.when(~lost, F.col("score")).otherwise(float("nan")).alias("image_score")), "predictions")
    expected = arrays.select(named, "category", F.col("image").alias("filename"), "defect")
    files, faults = None, None
    for run in ("sound", "spoiled"):
        back, wrong = _map_problems(spark, arrays, _written(spark, arrays, run))
        back, wrong = back.withColumn("run_id", F.lit(run)), wrong.withColumn("run_id", F.lit(run))
        files, faults = (back, wrong) if files is None else (files.unionByName(back), faults.unionByName(wrong))
    who = arrays.select(F.col("image").cast("string").alias("stem"), "category", "image", "defect")
    faults = faults.join(who, "stem").select("run_id", "category", F.col("image").alias("filename"), "problem")
    read = files.join(who, "stem").select("run_id", "category", "image", "defect", F.col("values").alias("map"))
    return predictions, read, expected, kept(Q.run_problems(predictions, expected, faults), "problems")


def refused_runs(spark, sf):
    """Which rules the spoiled run breaks, and how often."""
    return runs(spark, sf)[3]


QUERIES["refused_runs"] = refused_runs
ORACLE["refused_runs"] = """WITH t AS (SELECT vec_id, label FROM embeddings WHERE label >= 4),
  p AS (SELECT 'c0' AS category, 'label' AS rule FROM t WHERE label % 2 = 0 AND vec_id % 50 = 0 UNION ALL SELECT 'c0', 'score' FROM t WHERE label % 2 = 0 AND vec_id % 70 = 0
    UNION ALL SELECT 'c1', CASE label WHEN 9 THEN 'map_score_kind' ELSE 'map_geometry_id' END FROM t WHERE label % 2 = 1)
SELECT 'spoiled' AS run_id, category, rule, count(*) AS n FROM p GROUP BY ALL"""


def evaluated_run(spark, sf):
    """Metrics of the runs without a fault, read from their map files; the others are refused before any pixel is swept."""
    predictions, read, expected, problems = runs(spark, sf)
    pixels = E.labelled_pixels(read, EV.masks(spark, sf), ["category", "image"], HEIGHT, WIDTH, EV.OUT_HEIGHT, EV.OUT_WIDTH)
    rows = Q.evaluated(predictions, pixels, expected, problems)
    return rounded(Q.commit_new(rows, place(spark, "evaluated-run")))


QUERIES["evaluated_run"] = evaluated_run
ORACLE["evaluated_run"] = f"""WITH q AS ({ORACLE['refused_runs']}), faults AS (SELECT run_id, category, sum(n)::BIGINT AS n FROM q GROUP BY ALL),
  a AS {_auc(EV.SQL_LONG)},
  m AS (WITH {EV.sql_pixels()} {EV.sql_metrics("category", "pixels")} SELECT * FROM metrics),
  every AS (SELECT run_id, category, coalesce(faults.n, 0) AS problems FROM (SELECT DISTINCT unnest(['sound', 'spoiled']) AS run_id, 'c' || (label % 2) AS category FROM embeddings WHERE label >= 4)
    LEFT JOIN faults USING (run_id, category))
SELECT run_id, e.category, problems, CASE WHEN problems = 0 THEN 'verified' ELSE 'refused' END AS status, a.positives AS n_anomaly, a.negatives AS n_good, {r('a.auroc')} AS image_auroc,
  m.regions, m.positive_pixels AS foreground_pixels, m.negative_pixels AS background_pixels, {r('m.pixel_auroc')} AS pixel_auroc, {r('m.aupro030')} AS aupro030
FROM every e LEFT JOIN a ON a.category = e.category AND problems = 0 LEFT JOIN m ON m.category = e.category AND problems = 0"""
