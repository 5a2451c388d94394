"""Comparisons of variants and short ranked reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, NumericType, StringType, StructField, StructType

from gridsift.functions.grid import column_of, displacement, row_of
from gridsift.functions.vectors import matrix
from gridsift.operators.describe import describe
from gridsift.operators.paired import pearson


def map_relationships(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int, value: str = "z") -> DataFrame:
    """Correlation, distance of the peaks and change of the peak between two maps of the same image."""
    other = b.select(*keys, "cell", F.col(value).alias("_b"))
    j = a.select(*keys, "cell", F.col(value).alias("_a")).join(other, [*keys, "cell"])
    peak = lambda c: F.max(F.struct(F.col(c).alias("v"), (-F.col("cell")).alias("c")))
    out = j.groupBy(*keys).agg(pearson("_a", "_b").alias("correlation"), peak("_a").alias("_pa"), peak("_b").alias("_pb"))
    return out.select(*keys, "correlation", displacement(-F.col("_pa.c"), -F.col("_pb.c"), width).alias("hotspot_distance"),
                      (F.col("_pb.v") - F.col("_pa.v")).alias("score_delta"))


def variant_deltas(metrics: DataFrame, keys: Sequence[str], variant: str, order: Sequence[str], value: str) -> DataFrame:
    """One row per key with the value of every variant and the differences of consecutive variants."""
    wide = metrics.groupBy(*keys).agg(*[F.max(F.when(F.col(variant) == v, F.col(value))).alias(v) for v in order])
    return wide.select(*keys, *order, *[(F.col(b) - F.col(a)).alias(f"{a}_to_{b}") for a, b in zip(order, order[1:])])


def ranked_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key in the given order; the rank limit is applied before the shuffle (window group limit)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def summarised(records: DataFrame, keys: Sequence[str], counted: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(distribution of every numeric field, counts of every boolean and of the ``counted`` text fields) per group."""
    fields = [f for f in records.schema.fields if f.name not in keys]
    numeric = [f.name for f in fields if isinstance(f.dataType, NumericType)]
    labels = [f.name for f in fields if isinstance(f.dataType, BooleanType) or (f.name in counted and isinstance(f.dataType, StringType))]
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in labels])).alias("_v")
    counts = records.select(*keys, values).select(*keys, "_v.*").where("value IS NOT NULL").groupBy(*keys, "field", "value").agg(
        F.count(F.lit(1)).alias("n"))
    return describe(records, keys, numeric, [.05, .5, .95]), counts


def _interpolation(out: int, size: int) -> np.ndarray:
    """Weights of the ``size`` source places for each of ``out`` places: half-pixel centres, borders go on outwards."""
    at = np.clip((np.arange(out) + 0.5) * (size / out) - 0.5, 0, size - 1)
    low = np.floor(at).astype(int)
    weights = np.zeros((out, size))
    weights[np.arange(out), low] += 1 - (at - low)
    weights[np.arange(out), np.minimum(low + 1, size - 1)] += at - low
    return weights


PEAKS = ArrayType(StructType([StructField("region", IntegerType()), StructField("peak", DoubleType()), StructField("area", LongType()), StructField("percentile", DoubleType())]))


def component_peaks(maps: DataFrame, keys: Sequence[str], height: int, width: int, out_height: int, out_width: int) -> DataFrame:
    """Peak of every annotated region and the share of the image's pixels at or below it.

    ``maps`` holds an image a row with its ``map`` and ``regions``. Its pixels are made, sorted once and searched for the
    peaks inside the row: they are neither written nor joined, and an image without a region has no row.
    """
    down, across = _interpolation(out_height, height), _interpolation(out_width, width)

    @arrow_udf(PEAKS)
    def found(values: pa.Array, regions: pa.Array) -> pa.Array:
        n = len(values)
        scores = (down @ matrix(values).reshape(n, height, width) @ across.T).reshape(n, out_height * out_width)
        labels = matrix(regions).astype(np.int64)
        if labels.shape != scores.shape:
            raise ValueError("mask and map sizes differ")
        ordered, rows, counts = np.sort(scores, axis=1), [], []
        for score, label, low in zip(scores, labels, ordered):
            inside = np.flatnonzero(label > 0)
            area = np.bincount(label[inside])
            names = np.flatnonzero(area)
            peak = np.full(len(area), -np.inf)
            np.maximum.at(peak, label[inside], score[inside])
            rows.append((names, peak[names], area[names], np.searchsorted(low, peak[names], side="right") / len(low)))
            counts.append(len(names))
        columns = [np.concatenate(c) if rows else np.zeros(0) for c in (zip(*rows) if rows else [()] * 4)]
        cells = pa.StructArray.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, ("int32", "float64", "int64", "float64"))], ["region", "peak", "area", "percentile"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), cells)

    return maps.where("map is not null and regions is not null").select(*keys, F.explode(found("map", "regions")).alias("_p")).select(*keys, "_p.*")


def frame_state(status: Column, support_outside: Column, clearance: Column, margin: float = 4.0) -> Column:
    """Whether a usable silhouette fits its frame: CLIPPED, MARGIN_VIOLATION, SAFE, or NOT_AVAILABLE after a failed pose."""
    return (F.when(status != "OK", "NOT_AVAILABLE").when(support_outside > 0, "CLIPPED").when(clearance < margin, "MARGIN_VIOLATION")
            .otherwise("SAFE"))


def inverse_level(family: Column, level: Column) -> Column:
    """Parameter that undoes a rotation or a scale; other families have none."""
    return F.when(family == "ROTATION", -level).when((family == "SCALE") & (level > 0), 1 / level).otherwise(
        F.raise_error(F.lit("only rotation and positive scale can be inverted")).cast("double"))


# Pixel supports --------------------------------------------------------------------------------------------------------

def _inner(index: Column, out: int, cells: int) -> Column:
    nominal = F.floor(index * F.lit(cells) / F.lit(out))
    return nominal.between(1, cells - 2)


def nominal_support(out_height: int, out_width: int, height: int, width: int):
    """Pixels whose nominal cell is not on the border: px -> condition."""
    return lambda px: _inner(row_of(px, out_width), out_height, height) & _inner(column_of(px, out_width), out_width, width)


def _clear(index: Column, out: int, cells: int) -> Column:
    at = (index + F.lit(0.5)) * F.lit(cells / out) - F.lit(0.5)
    return (at >= 1) & (at <= cells - 2)


def strict_support(out_height: int, out_width: int, height: int, width: int):
    """Pixels whose interpolation takes nothing from a border cell: px -> condition."""
    return lambda px: _clear(row_of(px, out_width), out_height, height) & _clear(column_of(px, out_width), out_width, width)

