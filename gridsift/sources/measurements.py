"""Latency samples, latency histograms, process samples and phase files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridsift import schemas


def latency_samples(spark: SparkSession, path: str) -> DataFrame:
    """Per-call rows in microseconds."""
    rows = spark.read.schema(schemas.LATENCY).option("header", True).csv(path)
    return rows.withColumn("elapsed", F.col("elapsed_ns") / F.lit(1000.0))


def latency_histograms(spark: SparkSession, path: str) -> DataFrame:
    """Weighted rows (region, fork, iteration, elapsed, count) of nested benchmark histograms."""
    docs = spark.read.schema(schemas.HISTOGRAM).option("multiLine", True).json(path)
    region = F.element_at(F.split("benchmark", r"\."), -1)
    forks = docs.select(region.alias("region"), F.posexplode("primaryMetric.rawDataHistogram").alias("fork", "_i"))
    iterations = forks.select("region", "fork", F.posexplode("_i").alias("iteration", "_b"))
    bins = iterations.select("region", "fork", "iteration", F.explode("_b").alias("_bin"))
    return bins.select("region", "fork", "iteration", F.col("_bin")[0].alias("elapsed"), F.col("_bin")[1].cast("long").alias("count"))


def process_samples(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Process samples; an empty or unreadable counter stays null."""
    rows = spark.read.schema(schemas.SAMPLES).option("header", True).csv(path)
    return rows.select(F.lit(run).alias("run"), "sample_id", F.to_timestamp("timestamp_utc").alias("ts"),
                       F.concat_ws("/", "pid", "start_time_utc").alias("process"), "working_set_bytes", "private_bytes",
                       F.col("lifetime_peak_working_set_bytes").alias("lifetime_peak_bytes"), "status", "reason")


def phase_changes(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Phase changes; at equal times the later line of the file wins through ``change_id``."""
    rows = spark.read.schema(schemas.PHASES).option("header", True).csv(path)
    order = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    return rows.select(F.lit(run).alias("run"), F.to_timestamp("timestamp_utc").alias("ts"), "phase", order.alias("change_id"))
