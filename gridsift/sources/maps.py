"""Dense map files with their sidecars, and long map CSV."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridsift import schemas
from gridsift.operators.checks import map_problems
from gridsift.session import kept, small_files

# Fixed value: dtypes a map file may have.
DTYPES = {"<f4": "float32", "<f8": "float64"}


def parse_npy(content: bytes) -> tuple[np.ndarray, str]:
    """Two-dimensional little-endian float array in C order; anything else is an error."""
    stream = io.BytesIO(content)
    version = np.lib.format.read_magic(stream)
    reader = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    if version not in ((1, 0), (2, 0), (3, 0)):
        raise ValueError(f"unsupported array version {version}")
    shape, fortran, dtype = reader(stream)
    if fortran or len(shape) != 2 or dtype.str not in DTYPES:
        raise ValueError(f"not a C-ordered float map: {shape} {dtype.str}")
    data = content[stream.tell():]
    if len(data) != shape[0] * shape[1] * dtype.itemsize:
        raise ValueError("array payload has the wrong length")
    return np.frombuffer(data, dtype=dtype).reshape(shape).astype(np.float64), DTYPES[dtype.str]


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """One row per array file: stem, rows, cols, dtype, values and the hash of the bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("stem"), F.sha2("content", 256).alias("sha256"), "content")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parsed = [parse_npy(c) for c in frame["content"]]
            yield pd.DataFrame({"stem": frame["stem"], "sha256": frame["sha256"], "rows": [a.shape[0] for a, _ in parsed],
                                "cols": [a.shape[1] for a, _ in parsed], "dtype": [d for _, d in parsed],
                                "values": [a.ravel() for a, _ in parsed]})

    return named.mapInPandas(parse, "stem string, sha256 string, rows int, cols int, dtype string, values array<double>")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.SIDECAR).option("multiLine", True).option("mode", "FAILFAST").option(
        "pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path)
    return rows.withColumn("stem", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))


def read_once(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``read_arrays`` and ``read_sidecars`` of a folder as two tables: each of the many small files is opened once, whatever follows."""
    with small_files(spark):
        return kept(read_arrays(spark, path), "arrays"), kept(read_sidecars(spark, path), "sidecars")


def sidecar_problems(arrays: DataFrame, sidecars: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Arrays and sidecars that miss each other or disagree on shape, dtype, file name or hash.

    With ``expected(stem, image, geometry_id, score_kind, format)`` the sidecar must also name that image, geometry, kind and
    format; files that are expected or there without the other are problems too.
    """
    s = sidecars.select("stem", F.col("shape").alias("_shape"), F.col("dtype").alias("_dtype"), F.col("sha256").alias("_sha"), "array",
                        F.struct("filename", "geometry_id", "score_kind", "format").alias("_identity"))
    j = arrays.join(s, "stem", "full")
    rules = F.array(
        F.when(F.col("rows").isNull(), F.lit("no_array")), F.when(F.col("_sha").isNull(), F.lit("no_sidecar")),
        F.when(F.array("rows", "cols") != F.col("_shape"), F.lit("shape")), F.when(F.col("dtype") != F.col("_dtype"), F.lit("dtype")),
        F.when(F.col("sha256") != F.col("_sha"), F.lit("sha256")), F.when(F.concat("stem", F.lit(".npy")) != F.col("array"), F.lit("array")))
    if expected is not None:
        j = j.join(expected.select("stem", F.struct(F.col("image").cast("string").alias("filename"), "geometry_id", "score_kind", "format").alias("_expected")), "stem", "full")
        rules = F.concat(rules, F.array(
            F.when(F.col("_expected").isNull(), F.lit("unexpected")),
            *[F.when(F.col("_sha").isNotNull() & F.col("_expected").isNotNull() & ~F.col(f"_identity.{c}").eqNullSafe(F.col(f"_expected.{c}")), F.lit(c))
              for c in ("filename", "geometry_id", "score_kind", "format")]))
    return j.select("stem", F.explode(F.array_compact(rules)).alias("problem"))


def write_arrays(maps: DataFrame, folder: str, *, height: int, width: int, geometry_id: str, score_kind: str, format_id: str,
                 dtype: str = "float64") -> DataFrame:
    """Write one array file and sidecar per image from the tasks; returns (image, path, sha256).

    ``maps(image, map)``. The file name follows from the image, so a repeated task writes the same bytes again.
    The folder must be reachable from every executor.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        for frame in frames:
            rows = []
            for image, values in zip(frame["image"], frame["map"]):
                buffer = io.BytesIO()
                np.save(buffer, np.asarray(values, dtype=dtype).reshape(height, width), allow_pickle=False)
                data = buffer.getvalue()
                digest = hashlib.sha256(data).hexdigest()
                note = {"format": format_id, "filename": str(image), "geometry_id": geometry_id, "score_kind": score_kind,
                        "dtype": dtype, "shape": [height, width], "array": f"{image}.npy", "sha256": digest}
                for name, body in ((f"{image}.npy", data), (f"{image}.json", json.dumps(note, indent=2).encode())):
                    with store.open_output_stream(f"{root}/{name}") as out:
                        out.write(body)
                rows.append((image, f"{root}/{image}.npy", digest))
            yield pd.DataFrame(rows, columns=["image", "path", "sha256"])

    return maps.select(F.col("image").cast("string").alias("image"), "map").mapInPandas(write, "image string, path string, sha256 string")


def read_map_csv(spark: SparkSession, path: str) -> DataFrame:
    """Long map CSV (filename, row, column, raw)."""
    return spark.read.schema(schemas.MAP_CELLS).option("header", True).option("mode", "FAILFAST").csv(path)


def map_csv_problems(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Images with duplicate, missing, out-of-grid or non-finite cells."""
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    numbered = cells.withColumn("cell", F.when(inside, F.col("row") * width + F.col("col")))
    return map_problems(numbered, height * width)
