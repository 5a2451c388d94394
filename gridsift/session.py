"""Session helpers: where intermediate tables go."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="gridsift-")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local master may go without ``spark.checkpoint.dir``: there the
    driver and the executors are one process on one disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return _local_folder()


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage, survives the loss of executors, and gives Catalyst
    the true size on disk: whether a join with it is broadcast is decided by
    ``spark.sql.autoBroadcastJoinThreshold`` on a measured size, never by a hint.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridsift/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that Spark reckons for opening a file. Its 4 MB give tables of tiny files a task for every few of them.
_OPEN_COST, SMALL_FILES = "spark.sql.files.openCostInBytes", "64k"


@contextlib.contextmanager
def small_files(spark: SparkSession):
    """Within the block, tasks that run read many small files each. A task's bytes stay bounded by spark.sql.files.maxPartitionBytes."""
    before = spark.conf.get(_OPEN_COST)
    spark.conf.set(_OPEN_COST, SMALL_FILES)
    try:
        yield
    finally:
        spark.conf.set(_OPEN_COST, before)


#: Spark removes the shuffle files of a finished query itself if this is set when the query is made.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables kept while an operator runs; they are removed when the block ends.

    ``result`` writes what leaves the block, so nothing returned reads a removed table. Within the block each DataFrame is
    run once, so the shuffle files of a step go when it is written and disk use is that of the largest step.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(_CLEANUP, self.before)
        for path in self.paths:
            remove(self.spark, path)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/gridsift/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Remove a kept table early. It must be one that ``kept`` returned, unchanged."""
        for path in [p for p in self.paths if any(f.rsplit("/", 1)[0].endswith(p.rsplit("/", 1)[1]) for f in df.inputFiles()[:1])]:
            remove(self.spark, path)
            self.paths.remove(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return kept(df, name)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
