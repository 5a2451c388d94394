"""Queries: streams over files of the embeddings table, compared with the batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridsift.plans.views import CELLS, CHANNELS, SQL_MODEL, SQL_SCORED, fitted, r, rounded, table
from gridsift.session import kept, shared_folder
from gridsift.streaming import online

QUERIES, ORACLE = {}, {}


def arriving(spark, sf, copies=1):
    """The table as four files (twice the first half when replayed), read as a stream two files at a time."""
    e = table(spark, sf, "embeddings")
    path = f"{shared_folder(spark)}/gridsift/arriving-{uuid.uuid4().hex}"
    for _ in range(copies):
        e.repartition(4, "vec_id").write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(path)
    label = F.col("label")
    return stream.select(
        F.concat(F.lit("c"), (label % 2).cast("string")).alias("category"), F.col("vec_id").alias("image"),
        F.when(label < 2, F.lit("fit")).when(label < 4, F.lit("calibration")).otherwise(F.lit("test")).alias("split"),
        F.timestamp_seconds(F.pmod(F.col("vec_id"), F.lit(3600))).alias("arrived"), F.col("embedding").alias("x")), path


def streamed_scores(spark, sf):
    """Every image scored as it arrives with the stored model."""
    _, model, calibration = fitted(spark, sf)
    state = kept(online.packed_state(model, calibration), "packed")
    stream, path = arriving(spark, sf)
    online.run_scores(online.scored_stream(stream, state, CELLS), f"{path}-out", f"{path}-checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{path}-out").select("category", "image", "split", "score", "argmax"))


QUERIES["streamed_scores"] = streamed_scores
ORACLE["streamed_scores"] = f"""WITH {SQL_SCORED}
SELECT category, image, split, {r('max(z)')} AS score, first(cell ORDER BY z DESC, cell) AS argmax FROM maps GROUP BY ALL"""


def streamed_moments(spark, sf):
    """The positional model folded from a stream in which every image arrives twice."""
    stream, path = arriving(spark, sf, copies=2)
    fit = stream.where("split = 'fit'").select("category", "image", "arrived", "x")
    online.update_moments(fit, f"{path}-moments", f"{path}-checkpoint", cells=CELLS, channels=CHANNELS, horizon="2 hours").awaitTermination()
    model = online.model_of(online.latest_moments(spark, f"{path}-moments"))
    each = F.posexplode(F.arrays_zip("mean", "std_sample", "std")).alias("channel", "m")
    return rounded(model.select("category", "cell", "n", each).select("category", "cell", "n", "channel", "m.*"))


QUERIES["streamed_moments"] = streamed_moments
ORACLE["streamed_moments"] = f"""WITH {SQL_MODEL}
SELECT category, cell, n, CAST(ch - 1 AS INTEGER) AS channel, {r('mean')} AS mean, {r('std_sample')} AS std_sample, {r('std')} AS std FROM model"""
