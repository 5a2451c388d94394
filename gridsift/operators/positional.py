"""Descriptor rows against the model row of their position.

The model is joined by its keys whatever its size, so the plan and the order of sums never depend on it: Spark decides
between a broadcast and a sort-merge join. A row without a model row is an error, never dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from gridsift.functions.vectors import lists, matrix

Kernel = Callable[..., np.ndarray]


def _values(column: pa.Array) -> np.ndarray:
    return matrix(column) if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else column.to_numpy(zero_copy_only=False)


def _returned(result: np.ndarray) -> pa.Array:
    return pa.array(result) if result.ndim == 1 else lists(result)


def complete(rows: DataFrame, table: DataFrame, keys: Sequence[str], fields: Sequence[str], what: str) -> DataFrame:
    """``rows`` with ``fields`` of the row of ``table`` that has their keys; a row that finds none is an error."""
    own = table.select(*keys, *fields, F.lit(True).alias("_known"))
    missing = F.raise_error(F.concat(F.lit(f"no {what} for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    joined = rows.join(own, list(keys), "left")
    return joined.withColumns({f: F.when(F.col("_known"), F.col(f)).otherwise(missing) for f in fields}).drop("_known")


def by_position(rows: DataFrame, column: str, model: DataFrame, keys: Sequence[str], fields: Sequence[str], kernel: Kernel,
                name: str, several: bool = False) -> DataFrame:
    """Add ``name`` = kernel(x, index, *model arrays); rows whose keys are not in the model are an error.

    ``kernel`` gets the batch's descriptors as a matrix, the model row of each, and the model's fields as arrays; it
    returns one value per descriptor, or a row of values with ``several``.
    """
    empty = pa.array([], pa.list_(pa.float64()) if several else pa.float64())

    @arrow_udf(ArrayType(DoubleType()) if several else DoubleType())
    def scored(x: pa.Array, *own: pa.Array) -> pa.Array:
        return _returned(kernel(matrix(x), np.arange(len(x)), *[_values(a) for a in own])) if len(x) else empty

    held = [f"_model_{f}" for f in fields]
    named = model.select(*keys, *[F.col(f).alias(h) for f, h in zip(fields, held)])
    return complete(rows, named, keys, held, "model").withColumn(name, scored(column, *held)).drop(column, *held)


# Kernels -----------------------------------------------------------------------------------------------------------------

def unit_rows(x: np.ndarray, guard: float) -> np.ndarray:
    """Rows over their norm; tiny or non-finite rows are an error."""
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    if not np.isfinite(length).all() or (length < guard).any():
        raise ValueError("descriptor is not finite or its norm is below 1e-6")
    return x / length[:, None]


def deviation(u: np.ndarray, at: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Mean over channels of ((u - mean) / std)^2."""
    d = u - mean[at]
    d /= std[at]
    return np.einsum("ij,ij->i", d, d) / d.shape[1]


def quadratic(u: np.ndarray, at: np.ndarray, q: np.ndarray, l: np.ndarray, k: np.ndarray) -> np.ndarray:
    """u'Qu - 2 l.u + k, one matrix product per model row present in the batch."""
    channels = u.shape[1]
    out = -2 * np.einsum("ij,ij->i", u, l[at]) + k[at]
    order = np.argsort(at, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        form = q[at[members[0]]].reshape(channels, channels)
        out[members] += np.einsum("ij,ij->i", u[members] @ form, u[members])
    return out
