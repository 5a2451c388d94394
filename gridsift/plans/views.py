"""The test tables seen as descriptor maps, and the same views in SQL.

``embeddings`` holds 64 floats per vector: a grid of 2x4 cells with 8 channels.
Even labels are category c0, odd ones c1. Labels 0-1 are FIT normals, 2-3 the
CALIBRATION normals, 4-5 the test normals, 6-9 four kinds of defect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridsift.operators import moments as M
from gridsift.session import kept

HEIGHT, WIDTH, CHANNELS = 2, 4, 8
CELLS = HEIGHT * WIDTH


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def images(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    label = F.col("label")
    return e.select(
        F.concat(F.lit("c"), (label % 2).cast("string")).alias("category"), F.col("vec_id").alias("image"),
        F.when(label < 6, F.lit("good")).otherwise(F.concat(F.lit("d"), label.cast("string"))).alias("defect"),
        F.when(label < 2, F.lit("fit")).when(label < 4, F.lit("calibration")).otherwise(F.lit("test")).alias("split"),
        (label >= 6).alias("anomaly"), F.col("embedding"))


def features(spark: SparkSession, sf: str, *, clamped: bool = False) -> DataFrame:
    """One row per cell with its raw descriptor."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)),
                        lambda i: F.slice(F.col("embedding"), i * CHANNELS + 1, CHANNELS))
    return images(spark, sf).select("category", "image", "defect", "split", "anomaly",
                                    F.posexplode(cells).alias("cell", "x"))


def units(spark: SparkSession, sf: str) -> DataFrame:
    return M.units(features(spark, sf))


def fitted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, model, calibration); both model tables are written, so later joins know their size."""
    f = features(spark, sf)
    u = M.units(f)
    model = kept(M.position_model(u.where("split = 'fit'")), "model")
    held_out = M.feature_maps(f.where("split = 'calibration'"), model)
    calibration = kept(M.position_calibration(held_out), "calibration")
    return u, model, calibration


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Raw and calibrated maps of every image: one scan, two joins with model tables, no shuffle of features."""
    _, model, calibration = fitted(spark, sf)
    return M.calibrated(M.feature_maps(features(spark, sf), model), calibration)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the doubles for comparison with the SQL twin."""
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def r(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL; adding zero turns -0.0 into 0.0 as Spark does."""
    return f"(round({expression}, {digits}) + 0.0)"


SQL_FEATURES = """
  features AS (
    SELECT 'c' || (label % 2) AS category, vec_id AS image,
      CASE WHEN label < 6 THEN 'good' ELSE 'd' || label END AS defect,
      CASE WHEN label < 2 THEN 'fit' WHEN label < 4 THEN 'calibration' ELSE 'test' END AS split,
      label >= 6 AS anomaly, CAST(c.cell AS INTEGER) AS cell,
      CAST(list_slice(embedding, c.cell * 8 + 1, c.cell * 8 + 8) AS DOUBLE[]) AS x
    FROM embeddings, (SELECT unnest(range(8)) AS cell) c)"""

SQL_UNITS = SQL_FEATURES + """,
  normed AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS nrm FROM features),
  units AS (SELECT category, image, defect, split, anomaly, cell, list_transform(x, lambda v: v / nrm) AS u FROM normed),
  long AS (SELECT category, image, defect, split, anomaly, cell, unnest(u) AS v, generate_subscripts(u, 1) AS ch FROM units)"""

SQL_MODEL = SQL_UNITS + """,
  model AS (SELECT category, cell, ch, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std_sample,
              greatest(stddev_samp(v), 1e-6) AS std
            FROM long WHERE split = 'fit' GROUP BY ALL)"""

SQL_RAW = SQL_MODEL + """,
  raw AS (SELECT category, image, defect, split, anomaly, cell, avg(((v - mean) / std) * ((v - mean) / std)) AS raw
          FROM long JOIN model USING (category, cell, ch) GROUP BY ALL)"""

SQL_SCORED = SQL_RAW + """,
  calibration AS (SELECT category, cell, count(*) AS n, avg(raw) AS alpha, stddev_samp(raw) AS beta_sample,
                    greatest(stddev_samp(raw), 1e-6) AS beta
                  FROM raw WHERE split = 'calibration' GROUP BY ALL),
  maps AS (SELECT category, image, defect, split, anomaly, cell, raw, (raw - alpha) / beta AS z
           FROM raw JOIN calibration USING (category, cell)),
  scores AS (SELECT category, image, defect, split, anomaly, max(z) AS score, max(raw) AS raw_score
             FROM maps GROUP BY ALL)"""


def image_table(maps: DataFrame) -> DataFrame:
    """One row per image with its raw and calibrated score."""
    return maps.groupBy("category", "image", "defect", "split", "anomaly").agg(
        F.max("z").alias("score"), F.max("raw").alias("raw_score"))


def truth(flag: str) -> Column:
    return F.col(flag).cast("long")
