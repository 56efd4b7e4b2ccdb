"""Tables written to the folder that all executors share, to cut lineage and to pass results on."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and the master is local (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.conf.get("lexloom.shared.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="lexloom-")
        atexit.register(shutil.rmtree, own, True)
        spark.conf.set("lexloom.shared.dir", own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession):
    """What is written within leaves no shuffle files behind: nothing reads them again once its Parquet is there."""
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def forget_shuffles(spark: SparkSession) -> None:
    """Have the driver drop what it no longer refers to: shuffle files of actions that are over go with it."""
    spark._jvm.System.gc()


def compact(writer):
    """Options of a DataFrame's writer: sorted strings as what differs from the string before."""
    return writer.option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")


def staged_sorted(df: DataFrame, name: str) -> DataFrame:
    """staged() of rows in the order of their strings, in less room."""
    path = shared_path(df.sparkSession, name)
    with shuffles_deleted(df.sparkSession):
        compact(df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back."""
    path = shared_path(df.sparkSession, name)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
