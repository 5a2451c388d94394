"""Queries: measured runs, coverage, poses, cell regions and framing."""

from __future__ import annotations


from pyspark.sql import functions as F

from gridsift.functions import grid as G

from gridsift.operators import ordered as O
from gridsift.operators import process as PR
from gridsift.operators import regions as R
from gridsift.plans.views import HEIGHT, SQL_SCORED, WIDTH, fitted, images, r, rounded, scored, table
from gridsift.session import kept

QUERIES, ORACLE = {}, {}

# Process memory: events of a user are a run; sign-ups change its phase, other events are samples of the process named by
# their type, polled once an hour. Errors are samples whose counters were not measured.


def phase_changes(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").where("event_type = 'signup'").select(
        F.col("user_id").alias("run"), "ts", F.when(k < 25, "initialization").when(k < 50, "fitting").when(
            k < 75, "calibration").otherwise("steady").alias("phase"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("change_id"))


def samples(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'signup'")
    k = F.get_json_object("props", "$.k").cast("long")
    ok = F.col("event_type") != "error"
    return e.select(
        F.col("user_id").alias("run"), F.date_format(F.date_trunc("hour", "ts"), "yyyyMMddHH").alias("sample_id"), "ts",
        F.col("event_type").alias("process"), F.when(ok, F.floor(F.col("value") * 1000)).cast("long").alias("working_set_bytes"),
        F.when(ok & (k > 3), k * 100).alias("private_bytes"), F.when(ok, F.floor(F.col("value") * 2000)).cast("long").alias("lifetime_peak_bytes"),
        F.when(~ok, F.when(k < 50, "access denied; exited").otherwise("exited")).alias("reason"))


SQL_RUNS = """WITH ph AS (SELECT user_id AS run, ts, event_id, CASE WHEN CAST(props->>'$.k' AS INT) < 25 THEN 'initialization'
     WHEN CAST(props->>'$.k' AS INT) < 50 THEN 'fitting' WHEN CAST(props->>'$.k' AS INT) < 75 THEN 'calibration' ELSE 'steady' END AS phase
     FROM events WHERE event_type = 'signup'),
  sm AS (SELECT user_id AS run, strftime(ts, '%Y%m%d%H') AS sample_id, ts, event_type AS process,
     CASE WHEN event_type <> 'error' THEN CAST(floor(value * 1000) AS BIGINT) END AS ws,
     CASE WHEN event_type <> 'error' AND CAST(props->>'$.k' AS BIGINT) > 3 THEN CAST(props->>'$.k' AS BIGINT) * 100 END AS pb,
     CASE WHEN event_type <> 'error' THEN CAST(floor(value * 2000) AS BIGINT) END AS lp,
     CASE WHEN event_type = 'error' THEN CASE WHEN CAST(props->>'$.k' AS BIGINT) < 50 THEN 'access denied; exited' ELSE 'exited' END END AS reason
     FROM events WHERE event_type <> 'signup'),
  po AS (SELECT run, sample_id, min(ts) AS ts, CAST(sum(ws) AS BIGINT) AS ws, CAST(sum(pb) AS BIGINT) AS pb FROM sm
     WHERE ws IS NOT NULL AND pb IS NOT NULL AND lp IS NOT NULL GROUP BY ALL),
  pp AS (SELECT po.*, coalesce((SELECT max_by(phase, (ph.ts, ph.event_id)) FROM ph WHERE ph.run = po.run AND ph.ts <= po.ts), 'baseline') AS phase FROM po),
  bk AS (SELECT *, CASE WHEN phase IN ('baseline', 'steady') THEN phase ELSE 'fitting' END AS bucket FROM pp)"""


def sample_status(spark, sf):
    return PR.sample_status(samples(spark, sf))


QUERIES["sample_status"] = sample_status
ORACLE["sample_status"] = f"""{SQL_RUNS} SELECT run, count(*) AS observed, count_if(ws IS NOT NULL AND pb IS NOT NULL AND lp IS NOT NULL) AS complete,
  count_if(ws IS NULL OR pb IS NULL OR lp IS NULL) AS missing, count_if(ws IS NULL) AS missing_working_set_bytes,
  count_if(pb IS NULL) AS missing_private_bytes, count_if(lp IS NULL) AS missing_lifetime_peak_bytes FROM sm GROUP BY ALL"""


def missing_reasons(spark, sf):
    return PR.missing_reasons(samples(spark, sf))


QUERIES["missing_reasons"] = missing_reasons
ORACLE["missing_reasons"] = f"""{SQL_RUNS}, t AS (SELECT run, unnest(CASE WHEN reason IS NULL THEN ['unreported_missing']
  ELSE list_transform(string_split(reason, ';'), lambda s: trim(s)) END) AS reason FROM sm WHERE ws IS NULL OR pb IS NULL OR lp IS NULL)
SELECT run, reason, count(*) AS "rows" FROM t GROUP BY ALL"""


def phase_as_of(spark, sf):
    p = PR.phased_polls(samples(spark, sf), phase_changes(spark, sf))
    return p.select("run", "sample_id", "working_set_bytes", "private_bytes", "phase", "bucket")


QUERIES["phase_as_of"] = phase_as_of
ORACLE["phase_as_of"] = f"{SQL_RUNS} SELECT run, sample_id, ws AS working_set_bytes, pb AS private_bytes, phase, bucket FROM bk"


def memory_by_bucket(spark, sf):
    return rounded(PR.memory_by_bucket(PR.phased_polls(samples(spark, sf), phase_changes(spark, sf))))


QUERIES["memory_by_bucket"] = memory_by_bucket
ORACLE["memory_by_bucket"] = f"""{SQL_RUNS}, g AS (SELECT *, bucket AS b FROM bk UNION ALL SELECT *, 'to_ready' FROM bk WHERE bucket IN ('baseline', 'fitting'))
SELECT run, b AS bucket, count(*) AS samples, max(ws) AS max_working_set, max(pb) AS max_private, {r('avg(ws)')} AS mean_working_set,
  {r('avg(pb)')} AS mean_private FROM g GROUP BY ALL"""


def poll_gaps(spark, sf):
    return rounded(PR.poll_gaps(PR.polls(samples(spark, sf))), 3)


QUERIES["poll_gaps"] = poll_gaps
ORACLE["poll_gaps"] = f"""{SQL_RUNS}, g AS (SELECT run, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run ORDER BY ts, sample_id))) / 1000.0::DOUBLE AS gap FROM po)
SELECT run, count(*) AS polls, {r('min(gap)', 3)} AS min_gap_ms, {r('max(gap)', 3)} AS max_gap_ms FROM g GROUP BY ALL"""


def lifetime_peaks(spark, sf):
    return PR.lifetime_peaks(samples(spark, sf))


QUERIES["lifetime_peaks"] = lifetime_peaks
ORACLE["lifetime_peaks"] = f"""{SQL_RUNS} SELECT run, process, max(lp) AS lifetime_peak_bytes FROM sm
WHERE ws IS NOT NULL AND pb IS NOT NULL AND lp IS NOT NULL GROUP BY ALL"""


def latency_summary(spark, sf):
    """Extended price as an elapsed time seen ``quantity`` times, flags as region and process."""
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("region"), F.col("l_linestatus").alias("process"),
                                             F.col("l_extendedprice").alias("elapsed"), F.col("l_quantity").cast("long").alias("count"))
    return rounded(PR.latency_summary(li, "region", "process", "elapsed", "count"), 4)


QUERIES["latency_summary"] = latency_summary
ORACLE["latency_summary"] = f"""WITH g AS (SELECT l_returnflag AS region, unnest([l_linestatus, 'ALL']) AS process, l_extendedprice AS v, CAST(l_quantity AS BIGINT) AS w FROM lineitem),
  s AS (SELECT region, process, v, sum(w) AS w FROM g GROUP BY ALL),
  c AS (SELECT *, sum(w) OVER (PARTITION BY region, process ORDER BY v) AS u, sum(w) OVER (PARTITION BY region, process) AS n FROM s),
  p AS (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS p),
  q AS (SELECT region, process, p, (any_value(n) - 1) * p AS pos, min(v) FILTER (u > floor((n - 1) * p)) AS lo,
     min(v) FILTER (u > least(floor((n - 1) * p) + 1, n - 1)) AS hi FROM c, p GROUP BY region, process, p),
  z AS (SELECT region, process, p, lo + (pos - floor(pos)) * (hi - lo) AS v FROM q)
SELECT region, process, CAST(any_value(n) AS BIGINT) AS n, {r('min(c.v)', 4)} AS "min", {r('max(c.v)', 4)} AS "max", {r('sum(c.v * w) / sum(w)', 4)} AS mean,
  {r('any_value((SELECT z.v FROM z WHERE z.region = c.region AND z.process = c.process AND p = .5))', 4)} AS p50,
  {r('any_value((SELECT z.v FROM z WHERE z.region = c.region AND z.process = c.process AND p = .95))', 4)} AS p95,
  {r('any_value((SELECT z.v FROM z WHERE z.region = c.region AND z.process = c.process AND p = .99))', 4)} AS p99
FROM c GROUP BY region, process"""


def stage_timing(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("candidate"),
                                          F.year("o_orderdate").alias("fork"), F.round(F.col("o_totalprice") * 100).alias("elapsed"))
    return rounded(PR.stage_timing(o, "stage", "candidate", "fork", "elapsed"), 3)


QUERIES["stage_timing"] = stage_timing
ORACLE["stage_timing"] = f"""WITH g AS (SELECT o_orderpriority AS stage, o_orderstatus AS candidate, unnest([CAST(year(o_orderdate) AS VARCHAR), 'ALL']) AS fork, round(o_totalprice * 100) AS v FROM orders)
SELECT stage, candidate, fork, count(*) AS n, {r('min(v)', 3)} AS "min", {r('max(v)', 3)} AS "max", {r('avg(v)', 3)} AS mean, {r('quantile_cont(v, .5)', 3)} AS p50,
  {r('quantile_cont(v, .95)', 3)} AS p95, {r('quantile_cont(v, .99)', 3)} AS p99 FROM g GROUP BY ALL"""


def coverage(spark, sf):
    """Documents attempted and labelled per source and over all sources of a language."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    known = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("usable"))
    rows = docs.join(known, "doc_id", "left").withColumn("usable", F.coalesce("usable", F.lit(False)))
    return PR.coverage(rows, ["lang"], "source", "usable")


QUERIES["coverage"] = coverage
ORACLE["coverage"] = """WITH d AS (SELECT lang, source, labels.doc_id IS NOT NULL AS ok FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, source, count(*) AS attempted, count_if(ok) AS usable, count_if(NOT ok) AS failed,
  CASE WHEN count_if(NOT ok) = 0 THEN 'FULL_POPULATION' ELSE 'SURVIVOR_ONLY' END AS scope FROM d
GROUP BY GROUPING SETS ((lang, source), (lang))"""


# Poses read from the vectors --------------------------------------------------------------------------------------------

STATES = ("OK", "WEAK_AXIS", "WEAK_POLARITY", "SEGMENTATION_FAILURE")


def poses(spark, sf):
    e = lambda i: F.col("embedding")[i].cast("double")
    state = (F.when(e(8) > 0.2, "SEGMENTATION_FAILURE").when(F.abs(e(5)) < 0.02, "WEAK_AXIS")
             .when(F.abs(e(6)) < 0.02, "WEAK_POLARITY").otherwise("OK"))
    return images(spark, sf).select(
        "category", "image", "defect", "split", "anomaly", state.alias("state"), (349.5 + 100 * e(0)).alias("cx"),
        (349.5 + 100 * e(1)).alias("cy"), F.degrees(F.atan2(e(3), e(2))).alias("angle"), (0.5 + e(4)).alias("area"),
        F.abs(e(5)).alias("anisotropy"), e(6).alias("polarity"), F.abs(e(7)).alias("h4"), (e(9) > 0.15).alias("border"),
        F.greatest(e(10), F.lit(0.0)).alias("clipped_fraction"))


SQL_POSES = """poses AS (SELECT 'c' || (label % 2) AS category, vec_id AS image, CASE WHEN label < 6 THEN 'good' ELSE 'd' || label END AS defect,
     CASE WHEN label < 2 THEN 'fit' WHEN label < 4 THEN 'calibration' ELSE 'test' END AS split, label >= 6 AS anomaly,
     CASE WHEN e[9] > .2 THEN 'SEGMENTATION_FAILURE' WHEN abs(e[6]) < .02 THEN 'WEAK_AXIS' WHEN abs(e[7]) < .02 THEN 'WEAK_POLARITY' ELSE 'OK' END AS state,
     349.5::DOUBLE + 100 * e[1] AS cx, 349.5::DOUBLE + 100 * e[2] AS cy, degrees(atan2(e[4], e[3])) AS angle, 0.5::DOUBLE + e[5] AS area, abs(e[6]) AS anisotropy,
     e[7] AS polarity, abs(e[8]) AS h4, e[10] > .15 AS border, greatest(e[11], 0) AS clipped_fraction, e
   FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""


def pose_group_counts(spark, sf):
    return R.pose_groups(poses(spark, sf), ["category"], "defect", "good", STATES, ["cx"])[0]


QUERIES["pose_group_counts"] = pose_group_counts
SQL_GROUPED = SQL_POSES + """,
  grouped AS (SELECT *, unnest([defect, CASE WHEN defect = 'good' THEN 'NORMAL' ELSE 'ANOMALY' END]) AS grp FROM poses)"""
ORACLE["pose_group_counts"] = f"""WITH {SQL_GROUPED} SELECT category, grp, count(*) AS n, {", ".join(f"count_if(state = '{s}') AS state_{s.lower()}" for s in STATES)},
  count_if(border) AS border, count_if(clipped_fraction > 0) AS clipped, count_if(state <> 'SEGMENTATION_FAILURE' AND polarity < 0) AS negative_polarity
FROM grouped GROUP BY ALL"""


def pose_group_distributions(spark, sf):
    p = poses(spark, sf).withColumn("abs_polarity", F.abs("polarity"))
    return rounded(R.pose_groups(p, ["category"], "defect", "good", STATES, ["cx", "angle", "area", "abs_polarity"])[1], 5)


QUERIES["pose_group_distributions"] = pose_group_distributions
ORACLE["pose_group_distributions"] = f"""WITH {SQL_GROUPED},
  f AS (SELECT category, grp, unnest([{{'k': 'cx', 'v': cx}}, {{'k': 'angle', 'v': angle}}, {{'k': 'area', 'v': area}}, {{'k': 'abs_polarity', 'v': abs(polarity)}}]) AS s
     FROM grouped WHERE state <> 'SEGMENTATION_FAILURE')
SELECT category, grp, s.k AS field, count(*) AS n, {r('min(s.v)', 5)} AS "min", {r('max(s.v)', 5)} AS "max", {r('avg(s.v)', 5)} AS mean,
  {", ".join(f"{r(f'quantile_cont(s.v, {q})', 5)} AS p{round(q * 100)}" for q in (.25, .5, .75, .9, .95))} FROM f GROUP BY ALL"""


# The eight geometric changes (shift as a fraction of the size, angle in degrees).
CHANGES = ((-.02, 0, 0), (.02, 0, 0), (0, -.02, 0), (0, .02, 0), (0, 0, -10), (0, 0, -5), (0, 0, 5), (0, 0, 10))


def pose_changes(spark, sf):
    """Every pose under every geometric change; the second pose is read from other entries of the vector and knows nothing of the first."""
    e = images(spark, sf).select("image", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    grid = F.array(*[F.struct(F.lit(float(a)).alias("dx"), F.lit(float(b)).alias("dy"), F.lit(float(c)).alias("turn")) for a, b, c in CHANGES])
    rows = poses(spark, sf).join(e, "image").withColumn("_g", F.explode(grid)).select("*", "_g.*").drop("_g")
    x, y = R.expected_centre(F.col("cx"), F.col("cy"), F.col("dx"), F.col("dy"), F.col("turn"), 700)
    at = lambda i: F.col("e")[i]
    rows = rows.withColumn("cx1", 349.5 + 300 * at(11)).withColumn("cy1", 349.5 + 300 * at(12)).withColumn(
        "angle1", 90 + 200 * at(13)).withColumn("polarity1", F.col("polarity") + at(14) / 2).withColumn(
        "border1", at(15) > 0.15).withColumn("state0", F.col("state")).withColumn(
        "state1", F.when(at(16) > 0.2, "SEGMENTATION_FAILURE").otherwise("OK"))
    seen = (F.col("state0") != "SEGMENTATION_FAILURE") & (F.col("state1") != "SEGMENTATION_FAILURE")
    x2, y2 = x, y
    level = (F.when(F.col("turn") != 0, F.concat(F.lit("ROTATION_"), F.col("turn").cast("int").cast("string")))
             .when(F.col("dx") != 0, F.when(F.col("dx") > 0, "X_PLUS").otherwise("X_MINUS"))
             .otherwise(F.when(F.col("dy") > 0, "Y_PLUS").otherwise("Y_MINUS")))
    return rows.withColumn("centroid_error", F.when(seen, F.hypot(F.col("cx1") - x2, F.col("cy1") - y2))).withColumn(
        "angular_error", F.when(seen, G.circular_error(F.col("angle1") - F.col("angle") - F.col("turn"), 180.0))).withColumn(
        "polarity_flip", seen & ((F.col("polarity") < 0) != (F.col("polarity1") < 0))).withColumn("level", level)


def change_groups(spark, sf):
    return rounded(R.change_groups(pose_changes(spark, sf), ["category"], "level"))


QUERIES["change_groups"] = change_groups
SQL_CHANGES = SQL_POSES + """,
  gr AS (SELECT unnest([{'dx': -.02::DOUBLE, 'dy': 0::DOUBLE, 't': 0, 'l': 'X_MINUS'}, {'dx': .02::DOUBLE, 'dy': 0::DOUBLE, 't': 0, 'l': 'X_PLUS'},
     {'dx': 0::DOUBLE, 'dy': -.02::DOUBLE, 't': 0, 'l': 'Y_MINUS'}, {'dx': 0::DOUBLE, 'dy': .02::DOUBLE, 't': 0, 'l': 'Y_PLUS'},
     {'dx': 0::DOUBLE, 'dy': 0::DOUBLE, 't': -10, 'l': 'ROTATION_-10'}, {'dx': 0::DOUBLE, 'dy': 0::DOUBLE, 't': -5, 'l': 'ROTATION_-5'},
     {'dx': 0::DOUBLE, 'dy': 0::DOUBLE, 't': 5, 'l': 'ROTATION_5'}, {'dx': 0::DOUBLE, 'dy': 0::DOUBLE, 't': 10, 'l': 'ROTATION_10'}]) AS g),
  chg AS (SELECT poses.*, g.l AS level, g.t AS turn, CASE WHEN e[17] > .2 THEN 'SEGMENTATION_FAILURE' ELSE 'OK' END AS state1, e[16] > .15 AS border1,
      cos(radians(g.t)) * (cx - 349.5::DOUBLE) - sin(radians(g.t)) * (cy - 349.5::DOUBLE) + 349.5::DOUBLE + g.dx * 700 AS ex,
      sin(radians(g.t)) * (cx - 349.5::DOUBLE) + cos(radians(g.t)) * (cy - 349.5::DOUBLE) + 349.5::DOUBLE + g.dy * 700 AS ey,
      90 + 200 * e[14] AS angle1, polarity + e[15] / 2 AS polarity1 FROM poses, gr),
  er AS (SELECT *, state <> 'SEGMENTATION_FAILURE' AND state1 <> 'SEGMENTATION_FAILURE' AS seen, 349.5::DOUBLE + 300 * e[12] AS cx1, 349.5::DOUBLE + 300 * e[13] AS cy1 FROM chg),
  e2 AS (SELECT *, CASE WHEN seen THEN sqrt((cx1 - ex) ** 2 + (cy1 - ey) ** 2) END AS ce,
      CASE WHEN seen THEN abs((angle1 - angle - turn) - 180 * floor((angle1 - angle - turn) / 180 + .5)) END AS ae,
      seen AND (polarity < 0) <> (polarity1 < 0) AS flip FROM er)"""
ORACLE["change_groups"] = f"""WITH {SQL_CHANGES}, s AS (SELECT *, unnest([level, 'ALL']) AS lv FROM e2)
SELECT category, lv AS level, count(*) AS n, count_if(state = 'OK' AND state1 = 'OK') AS trusted_pairs, count_if(state1 <> 'OK') AS weak_or_failure,
  count_if(border1) AS source_border, count_if(flip) AS polarity_flips, count(ae) AS comparable_pairs, {r('avg(ce)')} AS mean_centroid_error,
  {r('max(ce)')} AS max_centroid_error, {r('avg(ae)')} AS mean_angular_error, {r('max(ae)')} AS max_angular_error FROM s GROUP BY ALL"""


def pose_reliability(spark, sf):
    """Largest centre and angle error, branch crossings and failures per role."""
    c = pose_changes(spark, sf)
    return rounded(c.groupBy("category", "split").agg(
        F.max("centroid_error").alias("max_centroid_error"), F.max("angular_error").alias("max_angular_error"),
        R.branch_crossings("angle", "angle1", 90.0).alias("branch_crossings"), F.count_if(F.col("state1") != "OK").alias("failures")))


QUERIES["pose_reliability"] = pose_reliability
ORACLE["pose_reliability"] = f"""WITH {SQL_CHANGES} SELECT category, split, {r('max(ce)')} AS max_centroid_error, {r('max(ae)')} AS max_angular_error,
  count_if(floor((angle + 45) / 90) <> floor((angle1 + 45) / 90)) AS branch_crossings, count_if(state1 <> 'OK') AS failures FROM e2 GROUP BY ALL"""


def nearest_fit_angle(spark, sf):
    """Circular distance of every test angle to the closest FIT angle of its category."""
    p = poses(spark, sf).where("state <> 'SEGMENTATION_FAILURE'")
    near = O.nearest_on_circle(p.where("split = 'test'").select("category", "image", "angle"), p.where("split = 'fit'").select(
        "category", "angle"), ["category"], "angle", 180.0, "image", "distance")
    return rounded(near.select("category", "image", "distance"))


QUERIES["nearest_fit_angle"] = nearest_fit_angle
ORACLE["nearest_fit_angle"] = f"""WITH {SQL_POSES}
SELECT a.category, a.image, {r('min(abs((a.angle - b.angle) - 180 * floor((a.angle - b.angle) / 180 + .5)))')} AS distance
FROM poses a JOIN poses b ON a.category = b.category AND b.split = 'fit' AND b.state <> 'SEGMENTATION_FAILURE'
WHERE a.split = 'test' AND a.state <> 'SEGMENTATION_FAILURE' GROUP BY ALL"""


def pose_outliers(spark, sf):
    p = poses(spark, sf).where("state <> 'SEGMENTATION_FAILURE'")
    return R.outside_ranges(p.where("split = 'test'").select("category", "image", "cx", "cy", "area"), p.where("split = 'fit'"), ["category"],
                            {"centroid_outside": ["cx", "cy"], "area_outside": ["area"]}).select(
        "category", "image", "centroid_outside", "area_outside")


QUERIES["pose_outliers"] = pose_outliers
ORACLE["pose_outliers"] = f"""WITH {SQL_POSES}, b AS (SELECT category, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1, min(area) AS a0, max(area) AS a1
  FROM poses WHERE split = 'fit' AND state <> 'SEGMENTATION_FAILURE' GROUP BY ALL)
SELECT category, image, NOT (cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1) AS centroid_outside, NOT (area BETWEEN a0 AND a1) AS area_outside
FROM poses JOIN b USING (category) WHERE split = 'test' AND state <> 'SEGMENTATION_FAILURE'"""


def circular_statistics(spark, sf):
    p = poses(spark, sf)
    stats = p.groupBy("category", "split").agg(*G.circular_moments("angle", 180.0))
    dev = p.join(stats, ["category", "split"]).groupBy("category", "split").agg(
        F.avg(G.circular_deviation(F.col("angle"), F.col("circular_mean"), 180.0)).alias("mean_deviation"))
    return rounded(stats.join(dev, ["category", "split"]))


QUERIES["circular_statistics"] = circular_statistics
ORACLE["circular_statistics"] = f"""WITH {SQL_POSES},
  m AS (SELECT category, split, avg(sin(angle * pi() / 90)) AS s, avg(cos(angle * pi() / 90)) AS c FROM poses GROUP BY ALL),
  k AS (SELECT *, atan2(s, c) * 90 / pi() AS a, least(sqrt(s * s + c * c), 1) AS resultant FROM m),
  k2 AS (SELECT *, a - 180 * floor(a / 180) AS cm FROM k)
SELECT category, split, {r('any_value(cm)')} AS circular_mean, {r('any_value(sqrt(-2 * ln(resultant)) * 90 / pi())')} AS circular_std,
  {r('any_value(resultant)')} AS resultant, {r('avg(abs((angle - cm + 90) - 180 * floor((angle - cm + 90) / 180) - 90))')} AS mean_deviation
FROM poses JOIN k2 USING (category, split) GROUP BY ALL"""


def angle_histogram(spark, sf):
    return R.angle_histogram(poses(spark, sf), ["category"], "angle", 180.0, 18)


QUERIES["angle_histogram"] = angle_histogram
ORACLE["angle_histogram"] = f"""WITH {SQL_POSES} SELECT category, CAST(least(floor((angle - 180 * floor(angle / 180)) / 10), 17) AS INTEGER) AS bin, count(*) AS images
FROM poses GROUP BY ALL"""


# Cell transport, bands and responses ------------------------------------------------------------------------------------

CELL = 50.0


def transforms(spark, sf):
    """Turn of each image about the middle of its 200x100 frame by the direction of its first two entries."""
    e = lambda i: F.col("embedding")[i].cast("double")
    t = G.rigid_about(F.atan2(e(1), e(0)), F.lit(99.5), F.lit(49.5), F.lit(99.5), F.lit(49.5))
    return images(spark, sf).select("category", "image", t.alias("transform"))


SQL_MOVED = SQL_SCORED + """,
  tr AS (SELECT vec_id AS image, cos(a) AS co, sin(a) AS si, 99.5::DOUBLE - (cos(a) * 99.5::DOUBLE - sin(a) * 49.5::DOUBLE) AS tx,
      49.5::DOUBLE - (sin(a) * 99.5::DOUBLE + cos(a) * 49.5::DOUBLE) AS ty
    FROM (SELECT vec_id, atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)) AS a FROM embeddings)),
  ce AS (SELECT maps.*, co, si, tx, ty, (cell % 4 + .5::DOUBLE) * 50 - .5::DOUBLE AS x, (cell // 4 + .5::DOUBLE) * 50 - .5::DOUBLE AS y FROM maps JOIN tr USING (image)),
  mv AS (SELECT *, floor((co * (x - tx) + si * (y - ty) + .5) / 50) AS sc, floor((-si * (x - tx) + co * (y - ty) + .5) / 50) AS sr,
      co * x - si * y + tx AS fx, si * x + co * y + ty AS fy FROM ce)"""


def cell_transport(spark, sf):
    maps = scored(spark, sf).where("split = 'test'").join(transforms(spark, sf), ["category", "image"])
    return R.transported(maps, "transform", CELL, HEIGHT, WIDTH).select("category", "image", "cell", "source_cell")


QUERIES["cell_transport"] = cell_transport
ORACLE["cell_transport"] = f"""WITH {SQL_MOVED} SELECT category, image, cell,
  CAST(CASE WHEN sc BETWEEN 0 AND 3 AND sr BETWEEN 0 AND 1 THEN sr * 4 + sc END AS INTEGER) AS source_cell FROM mv WHERE split = 'test'"""


def calibration_difference(spark, sf):
    """Canonical cells against the cells they come from: raw, centring and scale terms of the change of z."""
    _, _, calibration = fitted(spark, sf)
    maps = kept(scored(spark, sf).where("split = 'test'").select("category", "image", "cell", "raw"), "maps")
    state = maps.join(calibration.select("category", "cell", "alpha", "beta"), ["category", "cell"])
    moved = R.transported(maps.join(transforms(spark, sf), ["category", "image"]), "transform", CELL, HEIGHT, WIDTH).where(
        "source_cell IS NOT NULL").select("category", "image", "cell", "source_cell")
    a = moved.join(state.withColumnRenamed("cell", "source_cell"), ["category", "image", "source_cell"])
    b = moved.select("category", "image", "cell").join(state, ["category", "image", "cell"])
    return rounded(R.calibration_difference(a.drop("source_cell"), b, ["category", "image", "cell"]), 5)


QUERIES["calibration_difference"] = calibration_difference
ORACLE["calibration_difference"] = f"""WITH {SQL_MOVED},
  p AS (SELECT category, image, cell, CAST(sr * 4 + sc AS INTEGER) AS source_cell FROM mv WHERE split = 'test' AND sc BETWEEN 0 AND 3 AND sr BETWEEN 0 AND 1),
  s AS (SELECT category, image, cell, raw, alpha, beta FROM raw JOIN calibration USING (category, cell)),
  j AS (SELECT p.category, p.image, p.cell, a.raw AS ra, a.alpha AS aa, a.beta AS ba, b.raw AS rb, b.alpha AS ab, b.beta AS bb
    FROM p JOIN s a ON a.category = p.category AND a.image = p.image AND a.cell = p.source_cell
      JOIN s b ON b.category = p.category AND b.image = p.image AND b.cell = p.cell)
SELECT category, image, cell, {r('(rb - ra) / ba', 5)} AS raw_term, {r('-(ab - aa) / ba', 5)} AS centring_term,
  {r('(rb - ab) * (1 / bb - 1 / ba)', 5)} AS scale_term, {r('(rb - ab) / bb - (ra - aa) / ba', 5)} AS delta FROM j"""


def supports(spark, sf):
    """Object box of every image from four of its entries."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return images(spark, sf).select("category", "image", "split", (20 + 40 * e(17)).alias("min_x"), (180 + 40 * e(18)).alias("max_x"),
                                    (5 + 20 * e(19)).alias("min_y"), (95 + 20 * e(20)).alias("max_y"))


SQL_BANDS = SQL_MOVED + """,
  su AS (SELECT 'c' || (label % 2) AS category, label, vec_id AS image, 20 + 40 * CAST(embedding[18] AS DOUBLE) AS x0, 180 + 40 * CAST(embedding[19] AS DOUBLE) AS x1,
     5 + 20 * CAST(embedding[20] AS DOUBLE) AS y0, 95 + 20 * CAST(embedding[21] AS DOUBLE) AS y1 FROM embeddings),
  md AS (SELECT category, median(x0) AS x0, median(x1) AS x1, median(y0) AS y0, median(y1) AS y1 FROM su WHERE label < 2 GROUP BY ALL),
  bands AS (SELECT category, 'head' AS region, x0 + .75::DOUBLE * (x1 - x0) AS x0, x1, y0, y1 FROM md
     UNION ALL SELECT category, 'neck', (x0 + x1) / 2, x0 + .75::DOUBLE * (x1 - x0), y0, y1 FROM md
     UNION ALL SELECT category, 'thread', x0, (x0 + x1) / 2, y0, y1 FROM md),
  rg AS (SELECT mv.*, coalesce(region, 'other') AS region FROM mv LEFT JOIN bands b ON b.category = mv.category AND fx >= b.x0 AND fx < b.x1 AND fy >= b.y0 AND fy < b.y1)"""


def semantic_bands(spark, sf):
    return rounded(R.bands(supports(spark, sf).where("split = 'fit'"), ["category"]))


QUERIES["semantic_bands"] = semantic_bands
ORACLE["semantic_bands"] = f"""WITH {SQL_BANDS} SELECT category, region, {r('x0')} AS x0, {r('x1')} AS x1, {r('y0')} AS y0, {r('y1')} AS y1 FROM bands"""


def banded(spark, sf, split):
    b = kept(R.bands(supports(spark, sf).where("split = 'fit'"), ["category"]), "bands")
    maps = scored(spark, sf).where(F.col("split") == split).join(transforms(spark, sf), ["category", "image"])
    return R.in_band(maps, b, ["category"], "transform", CELL, WIDTH).drop("transform")


def cell_bands(spark, sf):
    return banded(spark, sf, "test").select("category", "image", "cell", "region")


QUERIES["cell_bands"] = cell_bands
ORACLE["cell_bands"] = f"WITH {SQL_BANDS} SELECT category, image, cell, region FROM rg WHERE split = 'test'"


def region_response(spark, sf):
    return rounded(R.region_response(banded(spark, sf, "test"), ["category", "image"], "head"))


QUERIES["region_response"] = region_response
ORACLE["region_response"] = f"""WITH {SQL_BANDS},
  g AS (SELECT category, image, max(z) AS gm, first(cell ORDER BY z DESC, cell) AS ga, max(z) FILTER (region = 'head') AS rm,
     first(cell ORDER BY z DESC, cell) FILTER (region = 'head') AS ra FROM rg WHERE split = 'test' GROUP BY ALL)
SELECT g.category, g.image, {r('any_value(gm)')} AS global_max, any_value(ga) AS argmax, {r('any_value(rm)')} AS region_max, any_value(ra) AS region_argmax,
  CAST(count_if(z > rm) + 1 AS INTEGER) AS region_rank, {r('any_value(rm - gm)')} AS region_minus_global
FROM g JOIN rg USING (category, image) WHERE rm IS NOT NULL GROUP BY g.category, g.image"""


def region_state(spark, sf):
    """Calibration state per band, a cell weighted by the number of FIT images that put it there."""
    _, _, calibration = fitted(spark, sf)
    member = banded(spark, sf, "fit").where("region <> 'other'").select("category", "region", "cell")
    return rounded(R.weighted_state(member, calibration.select("category", "cell", "alpha", "beta"), ["category"], ["alpha", "beta"]))


QUERIES["region_state"] = region_state
ORACLE["region_state"] = f"""WITH {SQL_BANDS},
  m AS (SELECT rg.category, rg.region, c.alpha, c.beta FROM rg JOIN calibration c ON c.category = rg.category AND c.cell = rg.cell WHERE rg.split = 'fit' AND region <> 'other'),
  f AS (SELECT category, region, 'alpha' AS field, alpha AS v FROM m UNION ALL SELECT category, region, 'beta', beta FROM m)
SELECT category, region, field, count(*) AS n, {r('min(v)')} AS "min", {r('max(v)')} AS "max", {r('avg(v)')} AS mean, {r('quantile_cont(v, .05)')} AS p05,
  {r('quantile_cont(v, .5)')} AS p50, {r('quantile_cont(v, .95)')} AS p95 FROM f GROUP BY ALL"""


# Framing: silhouettes are the 8x8 positions where an entry is positive, about the middle of a 100-pixel frame.

SIZE, MARGIN = 100.0, 2.0


def silhouette_points(spark, sf):
    e = images(spark, sf).select("category", "image", "split", F.posexplode("embedding").alias("i", "v")).where("v > 0.05")
    return e.select("category", "image", "split", (12.0 * F.pmod(F.col("i"), F.lit(8)) - 42).alias("x"),
                    (12.0 * F.floor(F.col("i") / 8) - 42).alias("y"), (6 + 10 * F.abs(F.col("v").cast("double"))).alias("radius"))


SQL_POINTS = """pt AS (SELECT * EXCLUDE (i, v), 12.0::DOUBLE * (i % 8) - 42 AS x, 12.0::DOUBLE * (i // 8) - 42 AS y, 6 + 10 * abs(CAST(v AS DOUBLE)) AS radius FROM
    (SELECT 'c' || (label % 2) AS category, vec_id AS image, CASE WHEN label < 2 THEN 'fit' WHEN label < 4 THEN 'calibration' ELSE 'test' END AS split,
      unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE v > CAST(0.05 AS DOUBLE)),
  ex AS (SELECT category, image, split, min(x) - max(radius) AS min_x, max(x) + max(radius) AS max_x, min(y) - max(radius) AS min_y, max(y) + max(radius) AS max_y,
     count(*) AS points FROM pt GROUP BY ALL),
  en AS (SELECT category, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y, min_by(image, (min_x, image)) AS min_x_image,
     max_by(image, (max_x, image)) AS max_x_image, min_by(image, (min_y, image)) AS min_y_image, max_by(image, (max_y, image)) AS max_y_image FROM ex WHERE split = 'fit' GROUP BY ALL),
  fr AS (SELECT *, least(1, 47.5::DOUBLE / greatest(-min_x, max_x, -min_y, max_y)) AS centred_scale,
     least(1, 95::DOUBLE / (max_x - min_x), 95::DOUBLE / (max_y - min_y)) AS movable_scale FROM en),
  f2 AS (SELECT *, 2 - movable_scale * min_x AS lo_x, 97 - movable_scale * max_x AS hi_x, 2 - movable_scale * min_y AS lo_y, 97 - movable_scale * max_y AS hi_y FROM fr)"""


def framing_contract(spark, sf):
    ex = R.extents(silhouette_points(spark, sf).where("split = 'fit'"), ["category", "image"], "radius")
    return rounded(R.framing(R.envelope(ex, ["category"]), SIZE, MARGIN))


QUERIES["framing_contract"] = framing_contract
ORACLE["framing_contract"] = f"""WITH {SQL_POINTS} SELECT category, {", ".join(f"{r(c)} AS {c}" for c in ('min_x', 'max_x', 'min_y', 'max_y'))},
  min_x_image, max_x_image, min_y_image, max_y_image, {", ".join(f"{r(c)} AS {c}" for c in ('centred_scale', 'movable_scale', 'lo_x', 'hi_x', 'lo_y', 'hi_y'))},
  lo_x <= hi_x + 1e-10 AND lo_y <= hi_y + 1e-10 AS feasible, {r('(lo_x + hi_x) / 2')} AS target_x, {r('(lo_y + hi_y) / 2')} AS target_y FROM f2"""


def framed_images(spark, sf):
    points = silhouette_points(spark, sf)
    ex = R.extents(points.where("split = 'fit'"), ["category", "image"], "radius")
    contract = kept(R.framing(R.envelope(ex, ["category"]), SIZE, MARGIN), "framing")
    return rounded(R.framed(points, contract, ["category", "split", "image"], ["category"], SIZE, "radius"))


QUERIES["framed_images"] = framed_images
SQL_FRAMED = SQL_POINTS + """,
  fp AS (SELECT pt.*, movable_scale AS s, movable_scale * x + (lo_x + hi_x) / 2 AS px, movable_scale * y + (lo_y + hi_y) / 2 AS py, movable_scale * radius AS rr FROM pt JOIN f2 USING (category)),
  fm AS (SELECT category, split, image, count(*) AS points, count_if(px < 0 OR px > 99 OR py < 0 OR py > 99) AS outside,
     count_if(px - rr < 0 OR px + rr > 99 OR py - rr < 0 OR py + rr > 99) AS support_outside,
     least(min(px - rr), 99 - max(px + rr), min(py - rr), 99 - max(py + rr)) AS clearance, max(px + rr) - min(px - rr) AS width, max(py + rr) - min(py - rr) AS height,
     count(*) * any_value(s) ** 2 / 10000 AS occupancy FROM fp GROUP BY ALL)"""
ORACLE["framed_images"] = f"""WITH {SQL_FRAMED} SELECT category, split, image, points, outside, support_outside, {r('clearance')} AS clearance, {r('width')} AS width,
  {r('height')} AS height, {r('occupancy')} AS occupancy FROM fm"""


def framing_summary(spark, sf):
    from gridsift.operators.describe import describe
    points = silhouette_points(spark, sf)
    ex = R.extents(points.where("split = 'fit'"), ["category", "image"], "radius")
    contract = kept(R.framing(R.envelope(ex, ["category"]), SIZE, MARGIN), "framing")
    rows = R.framed(points, contract, ["category", "split", "image"], ["category"], SIZE, "radius")
    return rounded(describe(rows, ["category", "split"], ["clearance", "width", "occupancy"], [.05, .5, .95]))


QUERIES["framing_summary"] = framing_summary
ORACLE["framing_summary"] = f"""WITH {SQL_FRAMED}, f AS (SELECT category, split, unnest([{{'k': 'clearance', 'v': clearance}}, {{'k': 'width', 'v': width}}, {{'k': 'occupancy', 'v': occupancy}}]) AS s FROM fm)
SELECT category, split, s.k AS field, count(*) AS n, {r('min(s.v)')} AS "min", {r('max(s.v)')} AS "max", {r('avg(s.v)')} AS mean, {r('quantile_cont(s.v, .05)')} AS p05,
  {r('quantile_cont(s.v, .5)')} AS p50, {r('quantile_cont(s.v, .95)')} AS p95 FROM f GROUP BY ALL"""

