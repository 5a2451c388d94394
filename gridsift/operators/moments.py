"""Positional statistics: fit, calibrate and score the diagonal model.

Tables: ``units(category, image, cell, u)``, ``model(category, cell, n, mean,
std_sample, std)``, ``maps(category, image, cell, raw)``,
``calibration(category, cell, n, alpha, beta_sample, beta)``. Any further key
columns (seed, method) may precede ``cell``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from gridsift.functions import vectors as V
from gridsift.functions.vectors import NORM_GUARD
from gridsift.operators.positional import by_position, complete, deviation, unit_rows

POSITION = ("category", "cell")


def units(features: DataFrame) -> DataFrame:
    """Unit descriptors; tiny or non-finite ones fail the job."""
    return features.withColumn("u", V.unit("x")).drop("x")


def at_least_two(count: Column, value: Column) -> Column:
    """A sample deviation of one observation is an error, not the floor."""
    return F.when(count >= 2, value).otherwise(F.raise_error(F.lit("at least two observations are required")))


def channel_moments(vectors: DataFrame, keys: Sequence[str], column: str = "u") -> DataFrame:
    """n, per-channel mean and sample std; merged map side, so a hot key ships one partial per task."""
    m = Summarizer.metrics("count", "mean", "std").summary(array_to_vector(F.col(column)))
    return vectors.groupBy(*keys).agg(m.alias("_m")).select(
        *keys, F.col("_m.count").alias("n"), vector_to_array("_m.mean").alias("mean"),
        vector_to_array("_m.std").alias("std_sample"))


def position_model(units: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """Mean and floored sample std per position and channel."""
    moments = channel_moments(units, keys)
    checked = at_least_two(F.col("n"), F.col("std_sample"))
    return moments.withColumn("std_sample", checked).withColumn("std", V.floored(F.col("std_sample")))


def uncalibrated(model: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """Identity calibration for a model without a held-out split."""
    return model.select(*keys, F.lit(0.0).alias("alpha"), F.lit(1.0).alias("beta_sample"), F.lit(1.0).alias("beta"))


def raw_maps(units: DataFrame, model: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """Mean squared standardised deviation of every unit descriptor; the model has one row per position."""
    return by_position(units, "u", model, keys, ["mean", "std"], deviation, "raw")


def feature_maps(features: DataFrame, model: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """The same straight from raw descriptors: normalisation and distance in one Python pass."""

    def kernel(x, at, mean, std):
        return deviation(unit_rows(x, NORM_GUARD), at, mean, std)

    return by_position(features, "x", model, keys, ["mean", "std"], kernel, "raw")


def position_calibration(maps: DataFrame, keys: Sequence[str] = POSITION, value: str = "raw") -> DataFrame:
    """Mean and floored sample std of the held-out scores per position."""
    stats = maps.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("alpha"),
                                    F.stddev_samp(value).alias("beta_sample"))
    return stats.withColumn("beta_sample", at_least_two(F.col("n"), F.col("beta_sample"))).withColumn(
        "beta", F.greatest(F.col("beta_sample"), F.lit(V.STD_FLOOR)))


def calibrated(maps: DataFrame, calibration: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """z = (raw - alpha) / beta; a cell without calibration is an error, since the image maximum would lack it."""
    return complete(maps, calibration, keys, ["alpha", "beta"], "calibration").withColumn(
        "z", (F.col("raw") - F.col("alpha")) / F.col("beta")).drop("alpha", "beta")


def image_scores(maps: DataFrame, keys: Sequence[str] = ("category", "image"), value: str = "z") -> DataFrame:
    """Largest value of the map."""
    return maps.groupBy(*keys).agg(F.max(V.finite(F.col(value))).alias("score"))


def map_summary(maps: DataFrame, keys: Sequence[str] = ("category", "image"), value: str = "z") -> DataFrame:
    """min, mean, max and the first cell that holds the maximum."""
    v = V.finite(F.col(value))
    return maps.groupBy(*keys).agg(
        F.count(value).alias("cells"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"),
        (-F.max(F.struct(v.alias("v"), (-F.col("cell")).alias("c")))["c"]).alias("argmax"))


def top_cells(maps: DataFrame, k: int, keys: Sequence[str] = ("category", "image"), value: str = "z") -> DataFrame:
    """The k largest cells of each map, value descending then cell; a map is one bounded grid."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col("cell").alias("cell"))))
    picked = maps.groupBy(*keys).agg(F.slice(ordered, 1, k).alias("_top"))
    return picked.select(*keys, F.posexplode("_top").alias("place", "_t")).select(
        *keys, (F.col("place") + 1).cast("int").alias("place"), F.col("_t.cell").alias("cell"),
        (-F.col("_t.v")).alias(value))


def parameter_report(calibration: DataFrame, height: int, width: int) -> DataFrame:
    """Mean and deviation of each position, with the floored positions marked."""
    from gridsift.functions.grid import column_of, row_of
    return calibration.select(
        "category", "cell", row_of(F.col("cell"), width).alias("row"), column_of(F.col("cell"), width).alias("col"),
        "n", F.col("alpha").alias("mu"), F.col("beta_sample").alias("sigma_sample"), F.col("beta").alias("sigma"),
        (F.col("beta_sample") < V.STD_FLOOR).alias("floored"))


def visual_thresholds(maps: DataFrame, keys: Sequence[str] = ("category",), nominal: float = 0.5,
                      anomaly: float = 0.99, minimum_span: float = 1e-6) -> DataFrame:
    """Nearest-rank thresholds of the pooled held-out scores, kept at least ``minimum_span`` apart."""
    from gridsift.operators.describe import quantiles
    q = quantiles(maps.select(*keys, F.col("raw").alias("value")), keys, [nominal, anomaly], nearest_rank=True)
    low, high = (F.col(f"p{round(p * 100):02d}") for p in (nominal, anomaly))
    return q.select(*keys, "n", low.alias("lower"),
                    F.when(high - low < minimum_span, low + minimum_span).otherwise(high).alias("upper"))


def visual_score(raw: Column, lower: Column, upper: Column) -> Column:
    """Linear between the thresholds, clamped to [0, 1]."""
    return F.least(F.greatest((raw - lower) / (upper - lower), F.lit(0.0)), F.lit(1.0))


def state_bytes(model: DataFrame, calibration: DataFrame) -> DataFrame:
    """Bytes of the model state per category: two doubles per channel and two per cell."""
    local = model.groupBy("category").agg(
        F.sum((F.size("mean") + F.size("std")) * F.lit(8)).cast("long").alias("local_bytes"),
        F.count(F.lit(1)).alias("cells"))
    cal = calibration.groupBy("category").agg((F.count(F.lit(1)) * 16).cast("long").alias("calibration_bytes"))
    return local.join(cal, "category").select(
        "category", "cells", "local_bytes", "calibration_bytes",
        (F.col("local_bytes") + F.col("calibration_bytes")).alias("total_bytes"))
