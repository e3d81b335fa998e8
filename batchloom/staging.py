"""Intermediate results that must outlive the loss of an executor.

``stage`` writes a DataFrame once as Parquet below the folder named by ``spark.checkpoint.dir`` (shared by all
executors on a cluster) and returns the reader of it, so that several consumers neither repeat the work nor depend on
shuffle files of one machine. Only where the setting is absent, as in local tests, a temporary folder is used.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or a temporary one in local mode without it."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="batchloom-")
    return "file://" + _own_dir


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and return a DataFrame that reads the written files."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_staged() -> None:
    """Delete every intermediate table of this process; called at exit."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended already
            pass
    if _own_dir is not None:
        import shutil

        shutil.rmtree(_own_dir, ignore_errors=True)


atexit.register(discard_staged)
