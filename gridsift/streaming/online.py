"""Arriving images: stateless scoring, and moments that grow batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gridsift.functions.vectors import NORM_GUARD, floored, matrix
from gridsift.operators.correspondence import packed
from gridsift.operators.moments import at_least_two, channel_moments, units

SCORE = StructType([StructField("score", DoubleType()), StructField("argmax", IntegerType())])


def image_scorer(cells: int):
    """Arrow UDF over whole images: raw descriptors and packed model state -> largest z and its first cell."""

    @arrow_udf(SCORE)
    def score(x: pa.Array, mean: pa.Array, std: pa.Array, alpha: pa.Array, beta: pa.Array) -> pa.Array:
        grid = matrix(x)
        if not len(grid):
            return pa.StructArray.from_arrays([pa.array([], pa.float64()), pa.array([], pa.int32())], ["score", "argmax"])
        shape = (len(grid), cells, -1)
        grid = grid.reshape(shape)
        length = np.sqrt((grid * grid).sum(axis=2))
        if not np.isfinite(grid).all() or (length < NORM_GUARD).any():
            raise ValueError("descriptor is not finite or its norm is below 1e-6")
        deviation = (grid / length[..., None] - matrix(mean).reshape(shape)) / matrix(std).reshape(shape)
        z = ((deviation * deviation).mean(axis=2) - matrix(alpha)) / matrix(beta)
        best = z.argmax(axis=1)
        return pa.StructArray.from_arrays([pa.array(z[np.arange(len(z)), best]), pa.array(best, pa.int32())], ["score", "argmax"])

    return score


def packed_state(model: DataFrame, calibration: DataFrame) -> DataFrame:
    """One row per category with the whole model, for joins at image level."""
    cal = calibration.select("category", "cell", F.array("alpha").alias("alpha"), F.array("beta").alias("beta"))
    return packed(model.select("category", "cell", "mean", "std").join(cal, ["category", "cell"]), ["mean", "std", "alpha", "beta"])


def scored_stream(images: DataFrame, state: DataFrame, cells: int) -> DataFrame:
    """Score of every arriving image (category, image, x): a stream-static join and one UDF, no state, append mode."""
    joined = images.join(state, "category").withColumn("_s", image_scorer(cells)("x", "mean", "std", "alpha", "beta"))
    return joined.select(*[c for c in images.columns if c != "x"], "_s.score", "_s.argmax")


def run_scores(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


# Moments ---------------------------------------------------------------------------------------------------------------

STATE = "category string, cell int, n bigint, mean array<double>, m2 array<double>"


def partial_moments(units: DataFrame) -> DataFrame:
    """(n, mean, M2) of the units of one batch; a single observation has M2 = 0."""
    m = channel_moments(units, ["category", "cell"])
    m2 = F.transform("std_sample", lambda s: F.when(F.col("n") > 1, s * s * (F.col("n") - 1)).otherwise(F.lit(0.0)))
    return m.select("category", "cell", "n", "mean", m2.alias("m2"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairwise combination of two moment tables by position; associative, so any batching gives the same state."""
    keys = ["category", "cell"]
    side = lambda d, p: d.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("n", "mean", "m2")])
    j = side(a, "a").join(side(b, "b"), keys, "full")
    na, nb = F.coalesce("a_n", F.lit(0)), F.coalesce("b_n", F.lit(0))
    n = (na + nb).cast("long")
    shift = F.zip_with("b_mean", "a_mean", lambda y, x: y - x)
    mean = F.zip_with("a_mean", shift, lambda x, d: x + d * nb / n)
    m2 = F.zip_with(F.zip_with("a_m2", "b_m2", lambda x, y: x + y), shift, lambda s, d: s + d * d * na * nb / n)
    only = lambda both, c: F.when(na == 0, F.col(f"b_{c}")).when(nb == 0, F.col(f"a_{c}")).otherwise(both).alias(c)
    return j.select(*keys, n.alias("n"), only(mean, "mean"), only(m2, "m2"))


def model_of(state: DataFrame) -> DataFrame:
    """The positional model of a moment table; needs two observations, the floor is applied only here."""
    std = F.transform("m2", lambda v: F.sqrt(F.greatest(v, F.lit(0.0)) / (F.col("n") - 1)))
    out = state.select("category", "cell", "n", "mean", at_least_two(F.col("n"), std).alias("std_sample"))
    return out.withColumn("std", floored(F.col("std_sample")))


def latest_moments(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of the moment table (below ``before``), None when there is none yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    versions = spark.read.schema(f"{STATE}, version bigint").parquet(path)
    if before is not None:
        versions = versions.where(F.col("version") < before)
    newest = versions.agg(F.max("version")).head()[0]
    return None if newest is None else versions.where(F.col("version") == newest).drop("version")


#: Microseconds of 10,000 years. Spark's watermark starts at 1970 and takes what is not later for late; times are moved beyond it.
_BEFORE_1970 = 3_652_425 * 86_400 * 1_000_000


def update_moments(images: DataFrame, path: str, checkpoint: str, *, cells: int, channels: int, time: str = "arrived", horizon: str = "1 hour") -> StreamingQuery:
    """Fold arriving images (category, image, ``time``, x: the flat grid) into versioned moment tables, each image once.

    The stream's state is one key per image, kept for ``horizon`` of event time: a replay within it is dropped, and an image
    that comes later than that behind the newest one is refused, so state never outgrows the images of the horizon. A batch
    reads the version before it and writes its own under its number, so a repeated batch rewrites the same table. Times may
    lie on either side of 1970; only their order and distance count.
    """
    moved = F.timestamp_micros(F.unix_micros(F.col(time).cast("timestamp")) + F.lit(_BEFORE_1970))
    once = images.withColumn(time, moved).withWatermark(time, horizon).dropDuplicatesWithinWatermark(["category", "image"])
    grid = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.slice(F.col("x"), i * channels + 1, channels))

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = partial_moments(units(batch.select("category", "image", F.posexplode(grid).alias("cell", "x"))))
        earlier = latest_moments(spark, path, number)
        if earlier is not None:
            state = merged(earlier, state)
        state.write.mode("overwrite").parquet(f"{path}/version={number}")

    return (once.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())
