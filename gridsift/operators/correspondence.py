"""Scoring against the best reference position, and neighbour statistics inside an image.

Positions of one image meet each other here, so an image is one row holding
its whole grid (the grid is a fixed contract, at most a few hundred cells).
The models of a category are packed into one row too and joined by category.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StructField, StructType)

from gridsift.functions.grid import displacement
from gridsift.functions.vectors import matrix

LOCAL = ArrayType(StructType([StructField("cell", IntegerType()), StructField("own", DoubleType()),
                              StructField("best", DoubleType()), StructField("best_cell", IntegerType())]))
CONTRAST = StructType([StructField("total", DoubleType()), StructField("edges", LongType())])


def grids(units: DataFrame, keys: Sequence[str], column: str = "u") -> DataFrame:
    """One row per image: the descriptors of all cells, in cell order, as one flat array."""
    cells = F.array_sort(F.collect_list(F.struct("cell", column)))
    return units.groupBy(*keys).agg(F.flatten(F.transform(cells, lambda c: c[column])).alias("grid"))


def packed(model: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("category",)) -> DataFrame:
    """One row per category: each model column of all cells as one flat array."""
    cells = F.array_sort(F.collect_list(F.struct("cell", *columns)))
    rows = model.groupBy(*keys).agg(cells.alias("_m"))
    return rows.select(*keys, *[F.flatten(F.col(f"_m.{name}")).alias(name) for name in columns])


def _lists(rows: list[pa.Array], width: int) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(rows))


#: Model bytes up to which all tasks are sent the models; larger ones are joined to the images.
MODEL_BYTES = 128 << 20
#: Distances held at once.
BLOCK = 1 << 22
#: Distances of the matrix product this close to the least, in parts of the terms they are made of, are computed again.
CLOSE = 1e-9


class _References:
    """Models of all cells of a category, ready for one matrix product with the descriptors of many images."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, height: int, width: int):
        count = height * width
        self.mean, self.std = mean.reshape(count, -1), std.reshape(count, -1)
        self.weight = 1.0 / (self.std * self.std)
        self.linear, self.constant = self.mean * self.weight, (self.mean * self.mean * self.weight).sum(axis=1)
        row, column = np.divmod(np.arange(count), width)
        near = (abs(row[:, None] - row) <= 1) & (abs(column[:, None] - column) <= 1)
        self.allowed = {"P": np.eye(count, dtype=bool), "N1": near, "G": np.ones((count, count), dtype=bool)}

    def best(self, units: np.ndarray, modes: Sequence[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Per mode, for images x cells: the least mean squared standardised distance and its lowest reference cell.

        The product u^2 . 1/s^2 - 2 u . m/s^2 + m^2/s^2 finds the candidates; those within rounding of the least are
        computed from their residuals, so values and ties are those of the plain definition.
        """
        count, channels = self.mean.shape
        flat = units.reshape(-1, channels)
        square = (flat * flat) @ self.weight.T
        product = square - 2 * (flat @ self.linear.T) + self.constant
        margin = CLOSE * (square + self.constant)
        own = np.arange(len(flat)) % count
        out = {}
        for mode in modes:
            allowed = self.allowed[mode][own]
            # A bound on the least true value, and every reference that may lie below it.
            top = np.where(allowed, product + margin, np.inf).min(axis=1)
            at, reference = np.nonzero(allowed & (product - margin <= top[:, None]))
            residual = (flat[at] - self.mean[reference]) / self.std[reference]
            exact = (residual * residual).mean(axis=1)
            order = np.lexsort((reference, exact, at))
            first = order[np.concatenate([[True], np.diff(at[order]) > 0])]
            out[mode] = exact[first].reshape(-1, count), reference[first].reshape(-1, count)
        return out


def correspondence_maps(grids: DataFrame, packed_model: DataFrame, height: int, width: int,
                        modes: Sequence[str] = ("N1", "G"), *, key: str = "category", normalise: bool = False, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """Rows (mode, image keys, cell, raw, reference) for ``P`` (own cell), ``N1`` (3x3 neighbourhood) and ``G`` (all cells).

    ``grids`` holds an image a row, the descriptors of its cells as one flat array ``grid``; they are scaled to unit length if
    ``normalise``. One pass over the images serves all modes and shuffles no descriptor: the models, one row per category, go to all
    tasks if they take up to ``model_bytes`` by count, and are joined to the images beyond that.
    """
    count, keys = height * width, [c for c in grids.columns if c != "grid"]
    kinds = dict(grids.dtypes)
    size = packed_model.agg(F.coalesce(F.sum((F.size("mean") + F.size("std")) * 8), F.lit(0))).head()[0]
    shared = None
    if size <= model_bytes:
        sent = packed_model.select(key, "mean", "std").toArrow()  # at most ``model_bytes``
        shared = grids.sparkSession.sparkContext.broadcast(sent)
        rows = grids.select(*keys, "grid").join(packed_model.select(key), key, "left_semi")
    else:
        rows = grids.select(*keys, "grid").join(packed_model.select(key, F.col("mean").alias("_mean"), F.col("std").alias("_std")), key).select(*keys, "grid", "_mean", "_std")

    def run(batches):
        models: dict = {}
        if shared is not None:
            table = shared.value
            means, stds = (matrix(table[c].combine_chunks()) for c in ("mean", "std"))
            models = {k: _References(m, s, height, width) for k, m, s in zip(table[key].to_pylist(), means, stds)}
        for batch in batches:
            if not batch.num_rows:
                continue
            units, names = matrix(batch.column("grid")), np.array(batch.column(key).to_pylist(), dtype=object)
            units = units.reshape(len(units), count, -1)
            if normalise:
                units = units / np.sqrt((units * units).sum(axis=2, keepdims=True))
            for name in dict.fromkeys(names.tolist()):
                rows_of = np.flatnonzero(names == name)
                if shared is None:
                    one = batch.slice(int(rows_of[0]), 1)
                    models = {name: _References(matrix(one.column("_mean"))[0], matrix(one.column("_std"))[0], height, width)}
                for low in range(0, len(rows_of), max(1, BLOCK // (count * count))):
                    part = rows_of[low:low + max(1, BLOCK // (count * count))]
                    kept_keys = [batch.column(c).take(pa.array(part)) for c in keys]
                    for mode, (raw, reference) in models[name].best(units[part], modes).items():
                        pairs = pa.StructArray.from_arrays([pa.array(raw.ravel()), pa.array(reference.ravel().astype(np.int32))], ["raw", "reference"])
                        offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * np.int32(count))
                        yield pa.RecordBatch.from_arrays([pa.array([mode] * len(part)), *kept_keys, pa.ListArray.from_arrays(offsets, pairs)], names=["mode", *keys, "match"])

    schema = "mode string, " + ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", match array<struct<raw: double, reference: int>>"
    return rows.mapInArrow(run, schema).select("mode", *keys, F.posexplode("match").alias("cell", "_m")).select("mode", *keys, "cell", "_m.raw", "_m.reference")


def match_summary(maps: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Share of cells matched at their own position, and mean displacement of the match."""
    return maps.groupBy(*keys).agg(
        F.avg((F.col("reference") == F.col("cell")).cast("double")).alias("same_position"),
        F.avg(displacement(F.col("cell"), F.col("reference"), width)).alias("displacement"))


# Coherence of features -------------------------------------------------------------------------------------------------

def coherence(model: DataFrame, units_mean: str = "mean") -> DataFrame:
    """Mean pairwise cosine and dispersion per position in closed form, channel variance, low deviations.

    The mean over all pairs of unit vectors is (n |mean|^2 - 1) / (n - 1): no pair is formed.
    """
    from gridsift.functions.vectors import dot
    length = dot(units_mean, units_mean)
    low = lambda t: F.size(F.filter("std_sample", lambda s: s <= t))
    square = F.aggregate("std_sample", F.lit(0.0), lambda a, s: a + s * s) / F.size("std_sample")
    return model.withColumn("_l", length).select(
        "category", "cell", "n", ((F.col("n") * F.col("_l") - 1) / (F.col("n") - 1)).alias("cosine_mean"),
        (1 - F.col("_l")).alias("dispersion"), square.alias("channel_variance"),
        low(1e-6).alias("low_1e6"), low(1e-5).alias("low_1e5"), low(1e-4).alias("low_1e4"), low(1e-3).alias("low_001"))


def neighbour_contrast(height: int, width: int):
    """Arrow UDF grid -> summed squared difference over right and down edges, and their number."""

    @arrow_udf(CONTRAST)
    def contrast(grid: pa.Array) -> pa.Array:
        g = matrix(grid)
        g = g.reshape(len(g), height, width, -1)
        total = ((np.diff(g, axis=2) ** 2).sum(axis=(1, 2, 3)) + (np.diff(g, axis=1) ** 2).sum(axis=(1, 2, 3)))
        edges = np.full(len(g), height * (width - 1) + (height - 1) * width, dtype=np.int64)
        return pa.StructArray.from_arrays([pa.array(total), pa.array(edges)], ["total", "edges"])

    return contrast


def held_out_template(height: int, width: int):
    """Arrow UDF (grid, sums) -> per interior cell the cosine to the mean of the other images.

    The template of a cell is the sum over all images minus the image itself;
    the best of the 3x3 neighbourhood counts only when it beats the own cell.
    """

    @arrow_udf(LOCAL)
    def local(grid: pa.Array, sums: pa.Array) -> pa.Array:
        rows = []
        inner = np.array([r * width + c for r in range(1, height - 1) for c in range(1, width - 1)])
        for g, total in zip(matrix(grid), matrix(sums)):
            g = g.reshape(height * width, -1)
            template = total.reshape(height * width, -1) - g
            length = np.sqrt((template * template).sum(axis=1))
            usable = length >= 1e-12
            cosine = lambda p, q: np.where(usable[q], (g[p] * template[q]).sum(axis=1) / np.where(usable[q], length[q], 1), 0.0)
            own = cosine(inner, inner)
            best, cell = own.copy(), inner.copy()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    other = inner + dr * width + dc
                    value = cosine(inner, other)
                    better = value > best
                    best[better], cell[better] = value[better], other[better]
            rows.append(pa.StructArray.from_arrays(
                [pa.array(inner, pa.int32()), pa.array(own), pa.array(best), pa.array(cell, pa.int32())],
                ["cell", "own", "best", "best_cell"]))
        return _lists(rows, len(inner)) if rows else pa.array([], pa.list_(pa.struct(
            [("cell", pa.int32()), ("own", pa.float64()), ("best", pa.float64()), ("best_cell", pa.int32())])))

    return local


def template_drift(grids: DataFrame, model: DataFrame, height: int, width: int) -> DataFrame:
    """Drift, share of unmoved cells and cosine gain of each image against the other images of its category."""
    sums = model.withColumn("sums", F.transform("mean", lambda m: m * F.col("n")))
    joined = grids.join(packed(sums, ["sums"]), "category").withColumn("_l", held_out_template(height, width)("grid", "sums"))
    keys = [c for c in grids.columns if c != "grid"]
    return joined.select(*keys, F.explode("_l").alias("_l")).select(*keys, "_l.*")


def drift_summary(drift: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    moved = displacement(F.col("best_cell"), F.col("cell"), width)
    return drift.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"), F.avg(moved).alias("drift"),
        F.avg((F.col("best_cell") == F.col("cell")).cast("double")).alias("same_cell"),
        F.avg(F.col("best") - F.col("own")).alias("gain"))


# Variance between and within positions ---------------------------------------------------------------------------------

def by_channel(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moment arrays as rows (keys, n, channel, mean, std_sample)."""
    return moments.select(*keys, "n", F.posexplode(F.arrays_zip("mean", "std_sample")).alias("channel", "_m")).select(
        *keys, "n", "channel", "_m.mean", "_m.std_sample")


def variance_shares(position: DataFrame, pooled: DataFrame) -> DataFrame:
    """Per channel: total = within + between positions, the between share, and the residual of the identity."""
    cells = by_channel(position, ["category", "cell"])
    whole = by_channel(pooled, ["category"]).select(
        "category", "channel", F.col("n").alias("_n"), F.col("mean").alias("_mean"),
        (F.col("std_sample") * F.col("std_sample") * (F.col("n") - 1)).alias("total"))
    offset = F.col("mean") - F.col("_mean")
    out = cells.join(whole, ["category", "channel"]).groupBy("category", "channel", "total").agg(
        F.sum((F.col("n") - 1) * F.col("std_sample") * F.col("std_sample")).alias("within"),
        F.sum(F.col("n") * offset * offset).alias("between"))
    return out.select("category", "channel", "total", "within", "between",
                      F.when(F.col("total") > 0, F.col("between") / F.col("total")).alias("share"),
                      F.abs(F.col("total") - F.col("within") - F.col("between")).alias("residual"))


def position_offsets(position: DataFrame, pooled: DataFrame) -> DataFrame:
    """Std ratio and standardised distance of each position from the pooled mean; small distances flagged."""
    whole = by_channel(pooled, ["category"]).select("category", "channel", F.col("mean").alias("_mean"),
                                                    F.col("std_sample").alias("_std"))
    cells = by_channel(position, ["category", "cell"]).join(whole, ["category", "channel"])
    scaled = F.when(F.col("_std") > 0, (F.col("mean") - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    per = cells.groupBy("category", "cell").agg(
        F.sqrt(F.sum(scaled * scaled)).alias("offset_norm"),
        F.avg(F.when(F.col("_std") > 0, F.col("std_sample") / F.col("_std"))).alias("std_ratio"))
    # One value per cell of the grid: a bounded group.
    limit = per.groupBy("category").agg(F.greatest(F.percentile("offset_norm", F.lit(0.10)), F.lit(0.05)).alias("limit"))
    return per.join(limit, "category").withColumn("flagged", F.col("offset_norm") < F.col("limit"))
