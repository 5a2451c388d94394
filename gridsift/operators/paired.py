"""Paired observations: the same image before and after a change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridsift.operators.describe import describe, long_form, quantiles
from gridsift.operators.ordered import average_ranks

TOLERANCE = 1e-12


def paired(changed: DataFrame, originals: DataFrame, keys: Sequence[str] = ("category", "image"),
           before: str = "s0", after: str = "st") -> DataFrame:
    """Changed observations with the score of their own original and the difference."""
    return changed.join(originals.select(*keys, before), list(keys)).withColumn("delta", F.col(after) - F.col(before))


def with_reference(pairs: DataFrame, calibration_scores: DataFrame, key: str = "category") -> DataFrame:
    """The largest calibration score of the category, and whether the changed score is strictly above it."""
    reference = calibration_scores.groupBy(key).agg(F.max("score").alias("reference"))
    return pairs.join(reference, key).withColumn("exceeds", F.col("st") > F.col("reference"))


def pairing_problems(pairs: DataFrame, levels: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """Counts of broken pairing rules per category: changed originals, duplicates, wrong deltas or flags, unknown levels."""
    known = F.lit(True)
    if levels:
        known = F.lit(False)
        for family, values in levels.items():
            known = known | ((F.col("family") == family) & F.col("level").isin([float(v) for v in values]))
    wrong_delta = F.abs(F.col("delta") - (F.col("st") - F.col("s0"))) > TOLERANCE
    wrong_flag = F.col("exceeds") != (F.col("st") > F.col("reference"))
    per_observation = pairs.groupBy("category", "image", "family", "level").agg(
        F.count(F.lit(1)).alias("_n"), F.min("s0").alias("_lo"), F.max("s0").alias("_hi"),
        F.count_if(wrong_delta).alias("_d"), F.count_if(wrong_flag).alias("_f"), F.count_if(~known).alias("_u"))
    per_image = per_observation.groupBy("category", "image").agg(
        (F.max("_hi") > F.min("_lo")).alias("_changed"), F.count_if(F.col("_n") > 1).alias("_dup"),
        F.sum("_n").alias("_n"), F.sum("_d").alias("_d"), F.sum("_f").alias("_f"), F.sum("_u").alias("_u"))
    return per_image.groupBy("category").agg(
        F.sum("_n").alias("observations"), F.count_if("_changed").alias("changed_originals"),
        F.sum("_dup").alias("duplicates"), F.sum("_d").alias("wrong_deltas"), F.sum("_f").alias("wrong_flags"),
        F.sum("_u").alias("unknown_levels"))


def grid_gaps(pairs: DataFrame, images: DataFrame, levels: Mapping[str, Sequence[float]]) -> DataFrame:
    """Expected (category, image, family, level) without an observation; the level grid is a short fixed list."""
    grid = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(float(v)).alias("level"))
                     for f, values in levels.items() for v in values])
    expected = images.select("category", "image", F.explode(grid).alias("_g")).select("category", "image", "_g.*")
    return expected.join(pairs.select("category", "image", "family", "level"), ["category", "image", "family", "level"],
                         "left_anti")


def robustness_summary(pairs: DataFrame, keys: Sequence[str] = ("category", "family", "level"),
                       prefixes: Sequence[str] = ("",)) -> DataFrame:
    """Medians of both scores, distribution of the differences (never differences of medians), exceedance share."""
    keys = list(keys)
    fields = [f"{p}{name}" for p in prefixes for name in ("s0", "st", "delta")]
    wide = describe(pairs, keys, fields, [.5, .9, .95])
    pick = lambda field, column: F.max(F.when(F.col("field") == field, F.col(column)))
    columns: list[Column] = []
    for p in prefixes:
        columns += [pick(f"{p}s0", "p50").alias(f"{p}median_s0"), pick(f"{p}st", "p50").alias(f"{p}median_st"),
                    pick(f"{p}delta", "p50").alias(f"{p}median_delta"), pick(f"{p}delta", "mean").alias(f"{p}mean_delta"),
                    pick(f"{p}delta", "p90").alias(f"{p}p90_delta"), pick(f"{p}delta", "p95").alias(f"{p}p95_delta"),
                    pick(f"{p}delta", "max").alias(f"{p}max_delta")]
    rows = wide.groupBy(*keys).agg(F.max("n").alias("n"), *columns)
    share = pairs.groupBy(*keys).agg(F.avg(F.col("exceeds").cast("double")).alias("exceedance"),
                                     F.max("reference").alias("reference"))
    return rows.join(share, keys)


def recovery_summary(triples: DataFrame, keys: Sequence[str], minimum: float = 0.1) -> DataFrame:
    """How much of a perturbation's effect a correction takes back.

    ``s0, sp, sc`` are the original, perturbed and corrected score; the ratio
    1 - dc/dp counts only where \\|dp\\| exceeds ``minimum``.
    """
    d = triples.withColumn("dp", F.col("sp") - F.col("s0")).withColumn("dc", F.col("sc") - F.col("s0")).withColumn(
        "ratio", F.when(F.abs(F.col("sp") - F.col("s0")) > minimum, 1 - (F.col("sc") - F.col("s0")) / (F.col("sp") - F.col("s0"))))
    within = [F.avg((F.abs(F.col("dc")) <= k).cast("double")).alias(f"within_{k}") for k in (1, 2, 5)]
    base = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("ratio").alias("recovery_count"), *within)
    q = describe(d, keys, ["dp", "dc", "ratio"], [.5, .9, .95])
    pick = lambda field, column: F.max(F.when(F.col("field") == field, F.col(column)))
    medians = q.groupBy(*keys).agg(
        pick("dp", "p50").alias("median_dp"), pick("dc", "p50").alias("median_dc"), pick("dc", "mean").alias("mean_dc"),
        pick("dc", "p90").alias("p90_dc"), pick("dc", "p95").alias("p95_dc"), pick("ratio", "p50").alias("median_recovery"))
    return base.join(medians, list(keys))


def pearson(x: str, y: str) -> Column:
    """Correlation, null when either side is constant."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy))


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; null when either side is constant."""
    ranked = rows
    for column in (x, y):
        ranks = average_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, column, f"_rank_{column}")
        ranked = ranked.join(ranks.drop("ties"), [*keys, column])
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(f"_rank_{x}", f"_rank_{y}").alias("spearman"))


def map_errors(a: DataFrame, b: DataFrame, keys: Sequence[str], place: str, value: str, inside: Column | None = None,
               ) -> DataFrame:
    """Mean absolute, root mean square and largest difference of two maps of the same image."""
    joined = a.join(b.select(*keys, place, F.col(value).alias("_b")), [*keys, place])
    if inside is not None:
        joined = joined.where(inside)
    d = F.col(value) - F.col("_b")
    return joined.groupBy(*keys).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max"))


def seed_summary(runs: DataFrame, metrics: Sequence[str], branch: str = "branch") -> DataFrame:
    """Mean, sample std, min and max over seeds per (branch, metric), with branch ``delta`` added per seed.

    ``runs(seed, branch in raw/calibrated, metrics...)``.
    """
    rows = long_form(runs, ["seed", branch], metrics)
    both = rows.groupBy("seed", "field").agg(
        F.max(F.when(F.col(branch) == "raw", F.col("value"))).alias("raw"),
        F.max(F.when(F.col(branch) == "calibrated", F.col("value"))).alias("calibrated"))
    spread = both.select("seed", "field", F.explode(F.array(
        F.struct(F.lit("raw").alias("branch"), F.col("raw").alias("value")),
        F.struct(F.lit("calibrated").alias("branch"), F.col("calibrated").alias("value")),
        F.struct(F.lit("delta").alias("branch"), (F.col("calibrated") - F.col("raw")).alias("value")))).alias("_b"))
    return spread.select("seed", F.col("field").alias("metric"), "_b.branch", "_b.value").groupBy("branch", "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sample_std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def sign_counts(deltas: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    """Exact sign counts and whether every difference is positive."""
    d = F.col(value)
    return deltas.groupBy(*keys).agg(F.count_if(d > 0).alias("positive"), F.count_if(d == 0).alias("zero"),
                                     F.count_if(d < 0).alias("negative"), F.bool_and(d > 0).alias("all_positive"))


def rotation_summary(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Signed median difference of each level first, then the mean of their absolute values."""
    medians = quantiles(pairs.select(*keys, "level", F.col("delta").alias("value")), [*keys, "level"], [.5])
    return medians.groupBy(*keys).agg(F.count(F.lit(1)).alias("levels"), F.avg(F.abs("p50")).alias("mean_absolute_median"))


def acceptance(metrics: DataFrame, gates: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """Gate columns (name -> (column, '>=' or '<=', bound)) and their conjunction."""
    out, every = metrics, F.lit(True)
    for name, (column, way, bound) in gates.items():
        passed = F.coalesce(F.col(column) >= bound if way == ">=" else F.col(column) <= bound, F.lit(False))
        out, every = out.withColumn(name, passed), every & F.col(name)
    return out.withColumn("qualifies", every)
