"""Summaries of measured runs: process memory by phase, latency, stage timing, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridsift.operators.describe import describe
from gridsift.operators.ordered import latest_before, running

# The counters of a process sample and the phases that count as fitting.
COUNTERS = ("working_set_bytes", "private_bytes", "lifetime_peak_bytes")
FITTING = ("initialization", "fitting", "calibration")


def complete() -> Column:
    """Every counter was measured."""
    out = F.lit(True)
    for c in COUNTERS:
        out = out & F.col(c).isNotNull()
    return out


def sample_status(samples: DataFrame) -> DataFrame:
    """Observed, complete and missing rows per run, and the missing counters; missing stays null, never zero."""
    return samples.groupBy("run").agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(complete()).alias("complete"),
        F.count_if(~complete()).alias("missing"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in COUNTERS])


def missing_reasons(samples: DataFrame) -> DataFrame:
    """Count of every reason among the incomplete rows; a row may give several, separated by semicolons."""
    tokens = F.filter(F.transform(F.split(F.coalesce("reason", F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    named = F.when(F.size(tokens) == 0, F.array(F.lit("unreported_missing"))).otherwise(tokens)
    return samples.where(~complete()).select("run", F.explode(named).alias("reason")).groupBy("run", "reason").agg(
        F.count(F.lit(1)).alias("rows"))


def polls(samples: DataFrame) -> DataFrame:
    """One row per poll: counters summed over its complete process rows, first time of the poll."""
    return samples.where(complete()).groupBy("run", "sample_id").agg(
        F.min("ts").alias("ts"), F.sum("working_set_bytes").alias("working_set_bytes"),
        F.sum("private_bytes").alias("private_bytes"))


def phased_polls(samples: DataFrame, phases: DataFrame) -> DataFrame:
    """Polls with the latest phase at or before them (``baseline`` before the first) and their bucket."""
    p = latest_before(polls(samples), phases.withColumnRenamed("change_id", "sample_id"), ["run"], "ts", "phase", "baseline",
                      "sample_id")
    bucket = F.when(F.col("phase") == "baseline", "baseline").when(F.col("phase") == "steady", "steady").when(
        F.col("phase").isin(*FITTING), "fitting").otherwise("other")
    return p.withColumn("bucket", bucket)


def memory_by_bucket(phased: DataFrame) -> DataFrame:
    """Samples, largest and mean memory of each bucket, and of everything up to readiness."""
    groups = F.when(F.col("bucket").isin("baseline", "fitting"), F.array("bucket", F.lit("to_ready"))).otherwise(F.array("bucket"))
    return phased.withColumn("bucket", F.explode(groups)).groupBy("run", "bucket").agg(
        F.count(F.lit(1)).alias("samples"), F.max("working_set_bytes").alias("max_working_set"),
        F.max("private_bytes").alias("max_private"), F.avg("working_set_bytes").alias("mean_working_set"),
        F.avg("private_bytes").alias("mean_private"))


def poll_gaps(polls: DataFrame, keys: Sequence[str] = ("run",), time: str = "ts", tie: str = "sample_id") -> DataFrame:
    """Shortest and longest gap between consecutive polls in milliseconds."""
    stepped = running(polls.select(*keys, time, tie), keys, [(time, "asc"), (tie, "asc")], lags={"_before": time})
    gap = F.timestamp_diff("MICROSECOND", F.col("_before"), F.col(time)) / F.lit(1000.0)
    return stepped.groupBy(*keys).agg(F.count(F.lit(1)).alias("polls"), F.min(gap).alias("min_gap_ms"), F.max(gap).alias("max_gap_ms"))


def lifetime_peaks(samples: DataFrame) -> DataFrame:
    """Largest lifetime peak of each process; peaks of different processes are never added."""
    return samples.where(complete()).groupBy("run", "process").agg(F.max("lifetime_peak_bytes").alias("lifetime_peak_bytes"))


def _pooled(rows: DataFrame, keys: Sequence[str], pooled: str, value: str, weight: str | None = None) -> DataFrame:
    """Rows (keys, value, _weight) per key and with ``pooled`` = ALL; equal values are counted before they are doubled."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counted = rows.withColumn(pooled, F.col(pooled).cast("string")).groupBy(*keys, value).agg(amount.cast("long").alias("_weight"))
    return counted.withColumn(pooled, F.explode(F.array(F.col(pooled), F.lit("ALL"))))


def latency_summary(rows: DataFrame, region: str, process: str, elapsed: str, weight: str | None = None) -> DataFrame:
    """Mean and linear p50/p95/p99 of every region, per process and pooled (process ``ALL``)."""
    keys = [region, process]
    return describe(_pooled(rows, keys, process, elapsed, weight), keys, [elapsed], [.5, .95, .99], weight="_weight").drop("field")


def stage_timing(rows: DataFrame, stage: str, candidate: str, fork: str, elapsed: str) -> DataFrame:
    """Timing distribution per (stage, candidate, fork) and pooled over forks (fork ``ALL``)."""
    keys = [stage, candidate, fork]
    return describe(_pooled(rows, keys, fork, elapsed), keys, [elapsed], [.5, .95, .99], weight="_weight").drop("field")


def coverage(rows: DataFrame, keys: Sequence[str], group: str, usable: str) -> DataFrame:
    """Attempted, usable and failed counts per group and overall (group null), with the scope of metrics on survivors."""
    counted = rows.rollup(*[F.col(k) for k in keys], F.col(group)).agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col(usable)).alias("usable"),
        F.count_if(~F.col(usable)).alias("failed"), F.grouping_id().alias("_level"))
    kept_levels = counted.where("_level <= 1").drop("_level")
    return kept_levels.withColumn("scope", F.when(F.col("failed") == 0, "FULL_POPULATION").otherwise("SURVIVOR_ONLY"))


