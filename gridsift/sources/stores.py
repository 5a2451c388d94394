"""Model, learning-state and result tables with identity checks on reading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from gridsift import schemas

CONTRACT = StructType([StructField("contract", MapType(StringType(), StringType())), StructField("version", LongType()),
                       StructField("category", StringType()), StructField("payload_sha256", StringType())])
VERSION = 2


def payload_digest(tables: Sequence[DataFrame]) -> DataFrame:
    """SHA-256 of each category's state: hashes of its rows in order, a row being one cell of a bounded grid."""
    rows = None
    for i, table in enumerate(tables):
        body = F.to_json(F.struct(*[F.col(c) for c in sorted(table.columns)]))
        part = table.select("category", F.concat(F.lit(f"{i}:"), F.sha2(body, 256)).alias("_h"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("category").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("payload_sha256"))


def write_model(model: DataFrame, calibration: DataFrame, contract: Mapping[str, str], path: str) -> None:
    """Model tables partitioned by category and one contract row per category; never replaces an existing store."""
    schemas.conform(model, schemas.MODEL).write.mode("errorifexists").partitionBy("category").parquet(f"{path}/model")
    schemas.conform(calibration, schemas.CALIBRATION).write.mode("errorifexists").partitionBy("category").parquet(f"{path}/calibration")
    spark = model.sparkSession
    stored = [spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("model", schemas.MODEL), ("calibration", schemas.CALIBRATION))]
    fields = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in sorted(contract.items())]))
    payload_digest(stored).select(fields.alias("contract"), F.lit(VERSION).cast("long").alias("version"), "category", "payload_sha256").write.mode(
        "errorifexists").parquet(f"{path}/contract")


def contract_problems(spark: SparkSession, path: str, expected: Mapping[str, str]) -> DataFrame:
    """Contract fields that differ, unknown versions and categories whose state no longer has its recorded hash."""
    rows = spark.read.schema(CONTRACT).parquet(f"{path}/contract")
    want = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in sorted(expected.items())]))
    same = F.array_sort(F.map_entries("contract")) == F.array_sort(F.map_entries(want))
    tables = [spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("model", schemas.MODEL), ("calibration", schemas.CALIBRATION))]
    now = payload_digest(tables).select("category", F.col("payload_sha256").alias("_now"))
    j = rows.join(now, "category", "full")
    found = F.array(F.when(~same, F.lit("contract")), F.when(F.col("version") != VERSION, F.lit("version")),
                    F.when(~F.col("payload_sha256").eqNullSafe(F.col("_now")), F.lit("payload")))
    return j.select("category", F.explode(F.array_compact(found)).alias("problem"))


def read_model(spark: SparkSession, path: str, expected: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(model, calibration); refused when identity or content differ from the contract."""
    from gridsift.operators.checks import enforced
    enforced(contract_problems(spark, path, expected), "model store refused")
    return (spark.read.schema(schemas.MODEL).parquet(f"{path}/model"), spark.read.schema(schemas.CALIBRATION).parquet(f"{path}/calibration"))


def write_learning_state(statistics: DataFrame, archetypes: DataFrame, raw_maps: DataFrame, path: str) -> None:
    """Projection statistics, archetypes and the raw held-out maps; filters and calibration are derived on reading."""
    for name, table in (("statistics", statistics), ("archetypes", archetypes), ("raw", raw_maps)):
        table.write.mode("errorifexists").partitionBy("category").parquet(f"{path}/{name}")


def read_learning_state(spark: SparkSession, path: str, signs) -> tuple[DataFrame, DataFrame]:
    """(compiled filters, calibration) rebuilt from the stored state and the sign matrix of its seed."""
    from gridsift.operators.moments import position_calibration
    from gridsift.operators.projection import compiled_filters
    statistics, bank, raw = (spark.read.parquet(f"{path}/{n}") for n in ("statistics", "archetypes", "raw"))
    return compiled_filters(bank, statistics, signs), position_calibration(raw)


def write_features(features: DataFrame, path: str) -> None:
    """Descriptor table partitioned so that a category or split is read alone."""
    schemas.conform(features, schemas.FEATURES).write.mode("errorifexists").partitionBy("category", "split").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FEATURES).parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    schemas.conform(predictions, schemas.PREDICTIONS).write.mode("errorifexists").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PREDICTIONS).option("header", True).option("mode", "FAILFAST").csv(path)


def write_report(table: DataFrame, path: str, kind: str = "json") -> None:
    """Metric or summary table as JSON lines or CSV; refuses to overwrite."""
    writer = table.write.mode("errorifexists")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)
