"""Frames whose rows must not be computed again differently, as after a sampled range partitioning."""

from __future__ import annotations

import hashlib
import io
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_lock = threading.Lock()


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this library: from its source folder on one machine, else from a zip in the shared folder."""
    sc = spark.sparkContext
    if _local(spark):
        path = sc.environment.get("PYTHONPATH", "")
        if str(ROOT) not in path.split(":"):
            sc.environment["PYTHONPATH"] = f"{ROOT}:{path}" if path else str(ROOT)
        return
    with _lock:
        if getattr(sc, "_tessera_shipped", False):
            return
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted((ROOT / "tessera").rglob("*.py")):
                z.writestr(zipfile.ZipInfo(str(f.relative_to(ROOT))), f.read_bytes())
        data = out.getvalue()
        at = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessera-{hashlib.sha256(data).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}.zip")
        stream = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
        stream.write(bytearray(data))
        stream.close()
        sc.addPyFile(at.toString())
        sc._tessera_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A temporary one only on a single machine, as in tests."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not _local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def settled(df: DataFrame) -> DataFrame:
    """df, computed once into the checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
