"""Explicit schemas of the tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    """Small DDL reader for flat schemas, so that modules import without a session."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
             "float": T.FloatType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(),
             "doubles": T.ArrayType(T.DoubleType()), "floats": T.ArrayType(T.FloatType()), "ints": T.ArrayType(T.IntegerType()),
             "strings": T.MapType(T.StringType(), T.StringType())}
    out = T.StructType()
    for part in ddl.split(","):
        name, kind = part.split()
        out.add(name, kinds[kind])
    return out


IMAGES = _schema("category string, role string, split string, ord bigint, image string, defect string, width int, height int, sha256 string")
FEATURES = _schema("category string, image string, split string, cell int, x floats")
MODEL = _schema("category string, cell int, n bigint, mean doubles, std_sample doubles, std doubles")
CALIBRATION = _schema("category string, cell int, n bigint, alpha double, beta_sample double, beta double")
MAP_CELLS = _schema("image string, row int, col int, raw double")
PREDICTIONS = _schema("run_id string, method string, category string, filename string, label string, defect string, image_score double, "
                      "score_kind string, native_map_path string, eval_map_path string, dtype string, shape string, geometry_id string, "
                      "image_sha256 string")
SAMPLES = _schema("sample_id string, timestamp_utc string, pid string, start_time_utc string, working_set_bytes bigint, private_bytes bigint, "
                  "lifetime_peak_working_set_bytes bigint, status string, reason string")
PHASES = _schema("timestamp_utc string, pid string, phase string")
LATENCY = _schema("process string, pid string, region string, iteration int, elapsed_ns bigint")

PROJECT = T.StructType([
    T.StructField("classes", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType())]))),
    T.StructField("tags", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])))])

BITMAP = T.StructType([T.StructField("data", T.StringType()), T.StructField("origin", T.ArrayType(T.IntegerType()))])
ANNOTATION = T.StructType([
    T.StructField("size", T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])),
    T.StructField("tags", T.ArrayType(T.StructType([T.StructField("tagId", T.LongType()), T.StructField("name", T.StringType())]))),
    T.StructField("objects", T.ArrayType(T.StructType([
        T.StructField("classId", T.LongType()), T.StructField("classTitle", T.StringType()), T.StructField("geometryType", T.StringType()),
        T.StructField("bitmap", BITMAP)])))])

SIDECAR = T.StructType([
    T.StructField("format", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("geometry_id", T.StringType()),
    T.StructField("score_kind", T.StringType()), T.StructField("dtype", T.StringType()),
    T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("array", T.StringType()), T.StructField("sha256", T.StringType())])

# One benchmark document: forks x iterations x (elapsed, count) bins.
HISTOGRAM = T.StructType([
    T.StructField("benchmark", T.StringType()),
    T.StructField("primaryMetric", T.StructType([
        T.StructField("score", T.DoubleType()),
        T.StructField("rawDataHistogram", T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))))]))])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order and types; a missing column is an analysis error."""
    return df.select(*[df[f.name].cast(f.dataType) for f in schema.fields])
