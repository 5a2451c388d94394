"""Image folders, project metadata, annotations, manifests and content inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridsift import schemas
from gridsift.operators.checks import parsed_name

PNG_SIGNATURE = "89504E470D0A1A0A"


def image_files(spark: SparkSession, root: str, role: str, pattern: str = "*.png") -> DataFrame:
    """Bytes of the images of a role with name, category, defect and the size from the PNG header (not decoded)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root}/{role}/img")
    name = F.element_at(F.split("path", "/"), -1)
    category, defect = parsed_name(name)
    return files.select(F.lit(role).alias("role"), name.alias("image"), category.alias("category"), defect.alias("defect"),
                        *png_size(F.col("content")), F.sha2("content", 256).alias("sha256"), "content")


def _big_endian(content: Column, start: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, 4)), 16, 10).cast("int")


def png_size(content: Column) -> tuple[Column, Column]:
    """(width, height) from the first chunk of a PNG; null when the signature is another."""
    png = F.hex(F.substring(content, 1, 8)) == PNG_SIGNATURE
    return (F.when(png, _big_endian(content, 17)).alias("width"), F.when(png, _big_endian(content, 21)).alias("height"))


def decoded(spark: SparkSession, root: str, role: str) -> DataFrame:
    """Images decoded by the JVM: row-major BGR bytes with height, width and channel count."""
    rows = spark.read.format("image").option("dropInvalid", False).load(f"{root}/{role}/img")
    return rows.select(F.element_at(F.split("image.origin", "/"), -1).alias("image"), "image.height", "image.width",
                       F.col("image.nChannels").alias("channels"), F.col("image.data").alias("bgr"))


def dictionaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(classes(id, title), tags(id, name)) of a project file."""
    project = spark.read.schema(schemas.PROJECT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return (project.select(F.explode("classes").alias("c")).select("c.*"), project.select(F.explode("tags").alias("t")).select("t.*"))


def annotations(spark: SparkSession, root: str, role: str) -> DataFrame:
    """One annotation document per image, named after it."""
    rows = spark.read.schema(schemas.ANNOTATION).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/{role}/ann")
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select(F.lit(role).alias("role"), F.regexp_replace(file, r"\.json$", "").alias("image"), "size", "tags", "objects")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Ordered names of one or more manifest files: blank lines and a leading byte order mark are skipped.

    A manifest file is a short list of one category's names; files are read in parallel, one row per file.
    """
    text = spark.read.text(path, wholetext=True)
    lines = F.transform(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n"), lambda s: F.trim(s))
    named = F.filter(lines, lambda s: s != "")
    parts = F.split(F.col("_metadata.file_path"), "/")
    return text.select(F.element_at(parts, -2).alias("category"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("manifest"),
                       F.posexplode(named).alias("ord", "image"))


def write_manifests(split: DataFrame, path: str) -> None:
    """Names with their split and place; refuses to replace an existing manifest."""
    split.select("category", "split", "ord", "image").write.mode("errorifexists").partitionBy("category", "split").parquet(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql.types import LongType, StringType, StructType
    schema = StructType().add("ord", LongType()).add("image", StringType()).add("category", StringType()).add("split", StringType())
    return spark.read.schema(schema).parquet(path)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path under the root, size and SHA-256 of every file of a tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    relative = F.element_at(F.split(F.col("path"), base + "/", 2), 2)
    return files.select(relative.alias("path"), "length", F.sha2("content", 256).alias("sha256"))
