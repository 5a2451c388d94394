"""Signed random projections: statistics, archetypes, compiled filters, and the projected models.

A projection y = R u / sqrt(D) is linear, so its statistics follow from the
channel sums and the channel cross products of u. The D-dimensional vectors of
the images are never formed: one pass gathers n, sum(u), sum(u u') (map-side
blocks), and only the small model tables are projected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from gridsift.functions.vectors import lists, matrix
from gridsift.operators.positional import by_position, deviation, quadratic, unit_rows

# The public 48-bit linear congruential generator the sign order is defined by.
MULTIPLIER, INCREMENT, MODULUS_BITS = 0x5DEECE66D, 0xB, 48
STD_FLOOR, NORM_EPSILON, CENTROID_GUARD = 1e-6, 1e-6, 1e-12


def signs(seed: int, channels: int, dimensions: int) -> np.ndarray:
    """(dimensions, channels) matrix of +1/-1 bytes; the generator's top bit, drawn channel by channel.

    Made once on the driver (its size is fixed by the parameters, about 1 MB for 96 x 10,000) and sent along with the job.
    """
    mask = (1 << MODULUS_BITS) - 1
    state = (seed ^ MULTIPLIER) & mask
    bits = np.empty(channels * dimensions, dtype=bool)
    for i in range(bits.size):
        state = (state * MULTIPLIER + INCREMENT) & mask
        bits[i] = state >> (MODULUS_BITS - 1)
    return np.where(bits.reshape(channels, dimensions).T, 1, -1).astype(np.int8)


def projected(r: np.ndarray):
    """Arrow UDF: x -> R x / sqrt(D)."""

    @arrow_udf(ArrayType(DoubleType()))
    def project(x: pa.Array) -> pa.Array:
        values = matrix(x)
        if not len(values):
            return lists(values)
        return lists(values @ r.T.astype(np.float64) / math.sqrt(len(r)))

    return project


def length_ratio(r: np.ndarray):
    """Arrow UDF: |R x| / (sqrt(D) |x|), null for vectors at or below the norm epsilon.

    The length follows from the channels' Gram matrix, |R x|^2 = x' (R'R) x, so no vector of D values is formed.
    """
    gram, dimensions = r.T.astype(np.float64) @ r.astype(np.float64), len(r)

    @arrow_udf(DoubleType())
    def ratio(x: pa.Array) -> pa.Array:
        values = matrix(x)
        if not len(values):
            return pa.array([], pa.float64())
        if not np.isfinite(values).all():
            raise ValueError("descriptor is not finite")
        length = np.sqrt((values * values).sum(axis=1))
        square = np.maximum(((values @ gram) * values).sum(axis=1), 0.0)
        keep = length > NORM_EPSILON
        rho = np.sqrt(square) / (math.sqrt(dimensions) * np.where(keep, length, 1.0))
        return pa.array(rho, mask=~keep)

    return ratio


def sign_words(column: str, channels: int) -> Column:
    """Signs of a descriptor, 64 channels to a word: a bit is set where a channel is negative."""
    words = []
    for low in range(1, channels + 1, 64):
        bits = F.transform(F.slice(column, low, 64), lambda v, i: F.when(v < 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    return F.array(*words)


def packed_signs(r: np.ndarray) -> Column:
    """The sign matrix as a constant: for each dimension the words of its row, like those of ``sign_words``."""
    rows = []
    for row in r:
        words = [sum(1 << i for i, s in enumerate(row[low:low + 64].tolist()) if s < 0) for low in range(0, len(row), 64)]
        rows.append(F.array(*[F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in words]))
    return F.array(*rows)


def sign_products(words: str, packed: Column, channels: int) -> Column:
    """For each dimension the sum of products of two sign vectors: channels less twice the bits in which they differ."""
    differ = lambda row: F.aggregate(F.zip_with(row, F.col(words), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return F.transform(packed, lambda row: F.lit(channels) - 2 * differ(row))


def isometry_report(features: DataFrame, keys: Sequence[str], r: np.ndarray) -> DataFrame:
    """How well the projection keeps lengths: mean ratio, nearest-rank p99 and largest error, excluded vectors."""
    from gridsift.operators.describe import quantiles
    from gridsift.session import kept
    rho = kept(features.select(*keys, length_ratio(r)("x").alias("rho")), "rho")
    mean = rho.groupBy(*keys).agg(F.count("rho").alias("used"), F.count_if(F.col("rho").isNull()).alias("excluded"),
                                  F.avg("rho").alias("mean_ratio"))
    errors = quantiles(rho.where("rho IS NOT NULL").select(*keys, F.abs(F.col("rho") - 1).alias("value")), keys, [.99],
                       nearest_rank=True)
    return mean.join(errors.select(*keys, F.col("p99").alias("p99_error"), F.col("max").alias("max_error")), list(keys), "left")


def cross_products(units: DataFrame, keys: Sequence[str], column: str = "u") -> DataFrame:
    """Per key: n, sum(u) and sum(u u') flattened by rows; one block per task batch and key, then a sum."""
    keys = list(keys)
    fields = [f for f in units.schema.fields if f.name in keys]
    schema = units.select(*keys).schema.add("n", "long").add("s", ArrayType(DoubleType())).add("g", ArrayType(DoubleType()))
    assert fields

    def blocks(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            codes = table.select(keys).append_column("_i", pa.array(np.arange(table.num_rows)))
            groups = codes.group_by(keys).aggregate([("_i", "list")])
            values = matrix(table.column(column).combine_chunks())
            s, g, n = [], [], []
            for members in groups.column("_i_list").combine_chunks():
                x = values[members.values.to_numpy()]
                s.append(x.sum(axis=0))
                g.append((x.T @ x).ravel())
                n.append(len(x))
            arrays = [groups.column(k).combine_chunks() for k in keys]
            arrays += [pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.float64())), pa.array(g, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, "n", "s", "g"])

    parts = units.select(*keys, column).mapInArrow(blocks, schema)
    add = lambda c: vector_to_array(Summarizer.sum(array_to_vector(F.col(c)))).alias(c)
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), add("s"), add("g"))


def _moments(n: float, s: np.ndarray, g: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample std of the projected coordinates from n, sum and cross products."""
    r = r.astype(np.float64)
    mean_u = s / n
    centred = g.reshape(len(s), len(s)) - n * np.outer(mean_u, mean_u)
    variance = np.einsum("dc,ce,de->d", r, centred, r, optimize=True) / len(r) / (n - 1)
    return r @ mean_u / math.sqrt(len(r)), np.sqrt(np.clip(variance, 0.0, None))


def _small(df: DataFrame, function: Callable[[pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``function`` to every row of a model table."""

    def each(frames):
        for frame in frames:
            yield pd.DataFrame([function(row) for row in frame.to_dict("records")])

    return df.mapInPandas(each, schema)


def projection_statistics(products: DataFrame, r: np.ndarray, keys: str = "category string") -> DataFrame:
    """Mean and floored sample std of every projected coordinate, pooled over images and cells."""
    names = [k.split()[0] for k in keys.split(",")]

    def stats(row):
        if row["n"] < 2:
            raise ValueError("at least two observations are required")
        mean, std = _moments(row["n"], np.asarray(row["s"]), np.asarray(row["g"]), r)
        return {**{k: row[k] for k in names}, "n": row["n"], "mean": mean, "std": np.maximum(std, STD_FLOOR)}

    return _small(products, stats, f"{keys}, n long, mean array<double>, std array<double>")


def archetypes(position_sums: DataFrame, statistics: DataFrame, r: np.ndarray) -> DataFrame:
    """Unit archetype of each cell: the normalised sum of standardised projections of its images.

    ``position_sums(category, cell, n, mean)`` are channel means, so the sum is (n R mean / sqrt(D) - n mu) / sigma.
    """
    joined = position_sums.select("category", "cell", "n", F.col("mean").alias("u")).join(
        statistics.select("category", "mean", "std"), "category")

    def archetype(row):
        u = np.asarray(row["u"])
        total = row["n"] * (r.astype(np.float64) @ u / math.sqrt(len(r)) - row["mean"]) / row["std"]
        length = math.sqrt(float(total @ total))
        if not length > NORM_EPSILON:
            raise ValueError(f"degenerate archetype at cell {row['cell']}")
        return {"category": row["category"], "cell": row["cell"], "n": row["n"], "a": total / length}

    return _small(joined, archetype, "category string, cell int, n long, a array<double>")


def compiled_filters(archetypes: DataFrame, statistics: DataFrame, r: np.ndarray) -> DataFrame:
    """Fold projection, standardisation and archetype into one weight per channel and a bias per cell."""
    joined = archetypes.join(statistics.select("category", "mean", "std"), "category")

    def compile_row(row):
        scaled = np.asarray(row["a"]) / row["std"]
        weight = r.T.astype(np.float64) @ scaled / math.sqrt(len(r))
        return {"category": row["category"], "cell": row["cell"], "w": weight, "b": -float(np.dot(row["mean"], scaled))}

    return _small(joined, compile_row, "category string, cell int, w array<double>, b double")


def filter_maps(clamped: DataFrame, filters: DataFrame) -> DataFrame:
    """raw = 1 - (w . u + b), u = x / max(norm, epsilon)."""

    def kernel(u, at, w, b):
        return 1 - (np.einsum("ij,ij->i", u, w[at]) + b[at])

    return by_position(clamped, "u", filters, ["category", "cell"], ["w", "b"], kernel, "raw")


def explicit_maps(clamped: DataFrame, archetypes: DataFrame, statistics: DataFrame, r: np.ndarray) -> DataFrame:
    """The same score through explicit projections; kept to check the compiled filters."""

    @arrow_udf(DoubleType())
    def score(u: pa.Array, a: pa.Array, mean: pa.Array, std: pa.Array) -> pa.Array:
        values = matrix(u)
        if not len(values):
            return pa.array([], pa.float64())
        y = values @ r.T.astype(np.float64) / math.sqrt(len(r))
        return pa.array(1.0 - np.einsum("id,id->i", matrix(a), (y - matrix(mean)) / matrix(std)))

    joined = clamped.join(archetypes.select("category", "cell", "a"), ["category", "cell"]).join(
        statistics.select("category", "mean", "std"), "category")
    return joined.withColumn("raw", score("u", "a", "mean", "std")).drop("u", "a", "mean", "std")


# Centroid models -------------------------------------------------------------------------------------------------------

def centroid_model(moments: DataFrame, r: np.ndarray) -> DataFrame:
    """Unit mean (cosine to the mean) and projected-cosine weights via the Gram matrix R'R / D."""

    def centroid(row):
        mean = np.asarray(row["mean"])
        wide = r.astype(np.float64)
        gram_mean = wide.T @ (wide @ mean) / len(r)
        length, inner = math.sqrt(float(mean @ mean)), math.sqrt(float(mean @ gram_mean))
        if length < CENTROID_GUARD or inner < CENTROID_GUARD:
            raise ValueError(f"degenerate centroid at cell {row['cell']}")
        return {"category": row["category"], "cell": row["cell"], "centroid": mean / length, "weight": gram_mean / inner}

    return _small(moments.select("category", "cell", "mean"), centroid,
                  "category string, cell int, centroid array<double>, weight array<double>")


def _projected_cosine(u: np.ndarray, weight: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """1 - w.u / sqrt(u' G u) with the Gram matrix G = R'R / D: the length of the projection without forming it."""
    square = np.einsum("ij,ij->i", u @ gram, u)
    if (square <= 0).any():
        raise ValueError("projected norm is not positive")
    return 1 - np.einsum("ij,ij->i", u, weight) / np.sqrt(square)


def _by_method(scored: DataFrame, methods: Sequence[str]) -> DataFrame:
    others = [c for c in scored.columns if c != "_raw"]
    each = F.explode(F.arrays_zip(F.array(*[F.lit(m) for m in methods]).alias("method"), F.col("_raw").alias("raw"))).alias("_r")
    return scored.select(*others, each).select("_r.method", *others, "_r.raw")


def gram(r: np.ndarray) -> np.ndarray:
    wide = r.astype(np.float64)
    return wide.T @ wide / len(r)


def centroid_maps(units: DataFrame, model: DataFrame, r: np.ndarray) -> DataFrame:
    """Rows per method: ``c1`` = 1 - cosine to the mean, ``v1`` = 1 - cosine after projection."""
    g = gram(r)

    def kernel(u, at, centroid, weight):
        return np.stack([1 - np.einsum("ij,ij->i", u, centroid[at]), _projected_cosine(u, weight[at], g)], axis=1)

    return _by_method(by_position(units, "u", model, ["category", "cell"], ["centroid", "weight"], kernel, "_raw", several=True), ["c1", "v1"])


METHODS = ("m0", "c1", "v1", "m2", "m3")


def all_methods(features: DataFrame, models: DataFrame, r: np.ndarray) -> DataFrame:
    """Raw maps of the compiled filter (m0), centroid (c1, v1), diagonal (m2) and projected dispersion (m3) models.

    ``models`` holds all five states of a cell in one row, so the descriptors are scanned and scored once.
    """
    g = gram(r)

    def kernel(x, at, w, b, centroid, weight, mean, std, q, l, k):
        u = unit_rows(x, NORM_EPSILON)
        return np.stack([1 - (np.einsum("ij,ij->i", u, w[at]) + b[at]), 1 - np.einsum("ij,ij->i", u, centroid[at]),
                         _projected_cosine(u, weight[at], g), deviation(u, at, mean, std), quadratic(u, at, q, l, k)], axis=1)

    fields = ["w", "b", "centroid", "weight", "mean", "std", "q", "l", "k"]
    return _by_method(by_position(features, "x", models, ["category", "cell"], fields, kernel, "_raw", several=True), METHODS)


# Local projected dispersion --------------------------------------------------------------------------------------------

def dispersion_model(products: DataFrame, r: np.ndarray) -> DataFrame:
    """Quadratic form of mean_d ((y_d - mu_d) / s_d)^2 per cell, from cross products at (category, cell)."""

    def form(row):
        s = np.asarray(row["s"])
        mean, std = _moments(row["n"], s, np.asarray(row["g"]), r)
        precision = 1.0 / np.maximum(std, STD_FLOOR) ** 2
        wide, d = r.astype(np.float64), len(r)
        return {"category": row["category"], "cell": row["cell"],
                "q": ((wide * precision[:, None]).T @ wide / d ** 2).ravel(),
                "l": wide.T @ (mean * precision) / (math.sqrt(d) * d),
                "k": float((mean * mean * precision).mean())}

    return _small(products, form, "category string, cell int, q array<double>, l array<double>, k double")


def dispersion_maps(units: DataFrame, model: DataFrame) -> DataFrame:
    """raw = u'Qu - 2 l.u + k."""
    return by_position(units, "u", model, ["category", "cell"], ["q", "l", "k"], quadratic, "raw")
