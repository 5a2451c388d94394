"""Qualification: fits without the images that failed, coverage, gates against a reference, and evaluation behind a gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridsift.functions import vectors as V
from gridsift.operators.evaluate import auroc, localisation
from gridsift.operators.moments import at_least_two

# Limits of the relative gates and of the diagnosis of one defect.
QUALITY_LOSS, STD_FACTOR, COSINE_LOSS, ROTATION_LIMIT = 0.01, 1.10, 0.02, 1.0
POOR_IMAGE_AUROC, CALIBRATION_DAMAGE = 0.70, -0.10


def taken_back(moments: DataFrame, part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments (n, mean, std_sample per channel) of the observations that are left when those behind ``part`` are taken out.

    It undoes the merge of two partials, so no descriptor that stays is read again. Keys without a row in ``part`` stay as
    they are. Where nothing is left, mean and std_sample are null and n is 0; more than there was is an error.
    """
    other = part.select(*keys, F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("std_sample").alias("_std"))
    # The counts have names of their own: inside a lambda, "n" would be the new column of that name.
    j = moments.withColumnsRenamed({"n": "_all", "mean": "_whole", "std_sample": "_own"}).join(other, list(keys), "left")
    n, m = F.col("_all"), F.col("_n")
    left = n - F.coalesce(m, F.lit(0))
    mean_of = lambda a, i: (n * a - m * F.get("_mean", i)) / left

    def squares(a: Column, i: Column) -> Column:
        gap = F.get("_mean", i) - mean_of(a, i)
        own, out = F.get("_own", i), F.get("_std", i)
        rest = own * own * (n - 1) - F.when(m > 1, out * out * (m - 1)).otherwise(0.0) - gap * gap * m * left / n
        return F.when(left > 1, F.sqrt(F.greatest(rest, F.lit(0.0)) / (left - 1))).otherwise(0.0)

    checked = F.when(left < 0, F.raise_error(F.lit("more observations taken back than there are"))).otherwise(left)
    pick = lambda name, new: F.when(m.isNull(), F.col(name)).when(left > 0, F.transform("_whole", new))
    return j.select(*keys, checked.cast("long").alias("n"), pick("_whole", mean_of).alias("mean"), pick("_own", squares).alias("std_sample"))


def model_of(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The positional model of moments that are at hand; fewer than two observations are an error."""
    return moments.withColumn("std_sample", at_least_two(F.col("n"), F.col("std_sample"))).withColumn("std", V.floored(F.col("std_sample")))


def survivor_coverage(attempts: DataFrame, keys: Sequence[str], usable: str = "usable") -> DataFrame:
    """Attempted, usable and failed rows per key, and whether a metric over the usable ones speaks for all."""
    ok = F.col(usable)
    return attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("usable"), F.count_if(~ok).alias("failed")).withColumn(
        "metric_scope", F.when(F.col("failed") == 0, "FULL_POPULATION").otherwise("SURVIVOR_ONLY"))


def relative_gates(evidence: DataFrame, reference: DataFrame, baseline: DataFrame, keys: Sequence[str], qualities: Sequence[str]) -> DataFrame:
    """Six gates of each candidate and whether it qualifies.

    ``evidence(keys, ..., qualities, median_std, cosine_mean, rotation, geometry)`` has a row per candidate, ``reference`` the
    same columns for the one candidate of each key that the others are held against, ``baseline(keys, qualities)`` the
    qualities without the step under test. A missing value, reference or baseline fails its gate.
    """
    ref = reference.select(*keys, *[F.col(c).alias(f"_ref_{c}") for c in (*qualities, "median_std", "cosine_mean")])
    base = baseline.select(*keys, *[F.col(c).alias(f"_base_{c}") for c in qualities])
    j = evidence.join(ref, list(keys), "left").join(base, list(keys), "left")
    every = lambda test: F.aggregate(F.array(*[F.coalesce(test(c), F.lit(False)) for c in qualities]), F.lit(True), lambda a, b: a & b)
    gates = {"quality_loss": every(lambda c: F.col(c) >= F.col(f"_ref_{c}") - QUALITY_LOSS),
             "above_unaligned": every(lambda c: F.col(c) > F.col(f"_base_{c}")),
             "median_std_gate": F.col("median_std") <= STD_FACTOR * F.col("_ref_median_std"),
             "cosine_gate": F.col("cosine_mean") >= F.col("_ref_cosine_mean") - COSINE_LOSS,
             "rotation_gate": F.col("rotation") <= ROTATION_LIMIT, "geometry_gate": F.col("geometry")}
    judged = j.select(*evidence.columns, *[F.coalesce(test, F.lit(False)).alias(name) for name, test in gates.items()])
    return judged.withColumn("qualifies", F.expr(" AND ".join(gates)))


def defect_label(raw: Column, z: Column) -> Column:
    """Why a defect separates badly: already in the raw score, through the calibration, or neither clearly."""
    return (F.when((raw < POOR_IMAGE_AUROC) & (z < POOR_IMAGE_AUROC), "RAW_REPRESENTATION_LIMIT")
            .when(z - raw < CALIBRATION_DAMAGE, "Z_CALIBRATION_DAMAGE").otherwise("MIXED"))


def run_problems(predictions: DataFrame, expected: DataFrame, map_problems: DataFrame, run: Sequence[str] = ("run_id", "category")) -> DataFrame:
    """Number of broken rules per run and rule (run, rule, n); only rules that are broken have a row.

    ``predictions(run, filename, label, defect, image_score)``; ``expected(run, filename, defect)`` is the test manifest of
    every run; ``map_problems(run, filename, problem)`` what is wrong with the map files. One join of predictions and manifest.
    """
    run = list(run)
    seen = predictions.groupBy(*run, "filename").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("label").alias("_label"), F.min("defect").alias("_defect"),
        F.bool_and(F.coalesce(F.abs("image_score") < float("inf"), F.lit(False)) & ~F.isnan("image_score")).alias("_finite"))
    j = expected.select(*run, "filename", F.col("defect").alias("_true")).join(seen, [*run, "filename"], "full")
    label = F.when(F.col("_true") == "good", "good").otherwise("anomaly")
    both = F.col("_rows").isNotNull() & F.col("_true").isNotNull()
    rules = F.array_compact(F.array(
        F.when(F.col("_rows").isNull(), F.lit("missing")), F.when(F.col("_true").isNull(), F.lit("unexpected")),
        F.when(F.col("_rows") > 1, F.lit("duplicate")), F.when(both & ~F.col("_defect").eqNullSafe(F.col("_true")), F.lit("defect")),
        F.when(both & ~F.col("_label").eqNullSafe(label), F.lit("label")), F.when(~F.col("_finite"), F.lit("score"))))
    broken = j.select(*run, F.explode(rules).alias("rule")).unionByName(map_problems.select(*run, F.concat(F.lit("map_"), "problem").alias("rule")))
    return broken.groupBy(*run, "rule").agg(F.count(F.lit(1)).alias("n"))


def evaluated(predictions: DataFrame, pixels: DataFrame, expected: DataFrame, problems: DataFrame, run: Sequence[str] = ("run_id", "category")) -> DataFrame:
    """One row per run of ``expected``: ``verified`` with all metrics, or ``refused`` with the number of problems and none.

    ``problems`` is the written table of ``run_problems``: runs in it are left out before a pixel or score is swept.
    """
    run = list(run)
    faults = problems.groupBy(*run).agg(F.sum("n").alias("problems"))
    sound = expected.select(*run).distinct().join(faults, run, "left_anti")
    scores = predictions.join(sound, run, "left_semi").withColumn("anomaly", F.col("label") == "anomaly")
    image = auroc(scores, run, "image_score").select(*run, F.col("positives").alias("n_anomaly"), F.col("negatives").alias("n_good"), F.col("auroc").alias("image_auroc"))
    local = localisation(pixels.join(sound, run, "left_semi"), run)
    metrics = image.join(local, run).withColumnsRenamed({"positive_pixels": "foreground_pixels", "negative_pixels": "background_pixels"})
    rows = expected.select(*run).distinct().join(faults, run, "left").join(metrics, run, "left").na.fill(0, ["problems"])
    return rows.withColumn("status", F.when(F.col("problems") == 0, "verified").otherwise("refused"))


def commit_new(df: DataFrame, path: str) -> DataFrame:
    """Write a result that must not exist yet and read it back; a folder without the mark of a finished job is refused."""
    df.write.mode("errorifexists").parquet(path)
    return committed(df.sparkSession, path)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The result that a finished job left in ``path``; an unfinished one is an error."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        raise ValueError(f"{path} holds no finished result")
    return spark.read.parquet(path)
