"""Deterministic FIT / calibration splits and set checks between them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gridsift.operators.ordered import numbered

# The public 48-bit linear congruential generator that defines the seeded order.
MULTIPLIER, INCREMENT, MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1


def fit_count(n: Column) -> Column:
    """Four fifths, at least one, leaving at least two for calibration."""
    return F.greatest(F.lit(1), F.least(n - 2, F.floor(n * 4 / 5))).cast("long")


def _sized(images: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    n = images.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("image").alias("_d"))
    valid = F.when((F.col("_n") >= 3) & (F.col("_n") == F.col("_d")), F.col("_n")).otherwise(
        F.raise_error(F.lit("a split needs at least three distinct images per category")).cast("long"))
    return n.select(*keys, valid.alias("n"))


def _marked(placed: DataFrame) -> DataFrame:
    side = F.when(F.col("ord") <= fit_count(F.col("n")), "fit").otherwise("calibration")
    return placed.withColumn("split", side).drop("n")


def hashed_split(images: DataFrame, keys: Sequence[str] = ("category",), seed: str = "seed") -> DataFrame:
    """Split by the order of sha256(seed:name) within the keys; independent of the input order.

    The seed is a column, so several seeds are split in the same job (put it in ``keys``).
    """
    name = F.concat_ws(":", F.col(seed).cast("string"), F.col("image").cast("string"))
    keyed = images.withColumn("_h", F.sha2(name, 256))
    placed = numbered(keyed, keys, [("_h", "asc"), ("image", "asc")], "ord").drop("_h")
    return _marked(placed.join(_sized(images, keys), list(keys)))


def shuffled_places(n: int, seed: int) -> np.ndarray:
    """place[i]: where the i-th of n sorted items lands after the seeded backward exchange shuffle."""
    state = (seed ^ MULTIPLIER) & MASK

    def draw(bound: int) -> int:
        nonlocal state
        while True:
            state = (state * MULTIPLIER + INCREMENT) & MASK
            bits = state >> 17
            if bound & (bound - 1) == 0:
                return (bound * bits) >> 31
            value = bits % bound
            if bits - value + bound - 1 < 1 << 31:
                return value

    items = list(range(n))
    for i in range(n, 1, -1):
        j = draw(i)
        items[i - 1], items[j] = items[j], items[i - 1]
    place = np.empty(n, dtype=np.int64)
    place[np.asarray(items, dtype=np.int64)] = np.arange(n)
    return place


def seeded_split(images: DataFrame, seed: int) -> DataFrame:
    """Split by the seeded shuffle of the sorted names.

    The shuffle is a permutation of positions that depends on n and the seed
    only, so tasks derive it themselves and no group of names is collected.
    """

    def place(frames):
        places: dict[int, np.ndarray] = {}
        for frame in frames:
            for n in frame["n"].unique():
                if n not in places:
                    places[n] = shuffled_places(int(n), seed)
            frame["ord"] = [int(places[n][p - 1]) + 1 for n, p in zip(frame["n"], frame["_p"])]
            yield frame[["category", "image", "ord", "n"]]

    ordered = numbered(images.select("category", "image"), ["category"], [("image", "asc")], "_p")
    schema = images.select("category", "image").schema.add("ord", "long").add("n", "long")
    return _marked(ordered.join(_sized(images), "category").mapInPandas(place, schema))


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("category", "image")) -> DataFrame:
    """Rows in both; must be empty for FIT and calibration."""
    return a.select(*keys).intersect(b.select(*keys))


def set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("category", "image")) -> DataFrame:
    """Rows in only one side, with the side; empty when the sets (with multiplicity) agree."""
    left, right = a.select(*keys), b.select(*keys)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right")))


def first_per_category(images: DataFrame, k: int, order: str = "ord") -> DataFrame:
    """The first k of each category in manifest order (the rank limit runs before the shuffle)."""
    from pyspark.sql import Window
    place = F.row_number().over(Window.partitionBy("category").orderBy(order, "image"))
    return images.withColumn("place", place).where(F.col("place") <= k)
