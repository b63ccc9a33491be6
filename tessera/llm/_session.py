"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.steps import shared_dir, ship  # noqa: F401

_lock = threading.Lock()

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_depth: dict[int, int] = {}
_before: dict[int, str] = {}


@contextlib.contextmanager
def _cleaning(spark: SparkSession):
    """The setting holds while any write of the session runs, in whatever thread, and is then what it was."""
    key = hash(spark)
    with _lock:
        if not _depth.get(key):
            _before[key] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _depth[key] = _depth.get(key, 0) + 1
    try:
        yield
    finally:
        with _lock:
            _depth[key] -= 1
            if not _depth[key]:
                spark.conf.set(_CLEANUP, _before.pop(key))


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder, reread: lineage ends there and lost executors lose nothing.

    The write's own shuffle files serve nothing afterwards, so Spark is told to remove them when it is done.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    with _cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in frames:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
