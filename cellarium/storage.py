"""Where tables that outlive a stage go: the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a folder of this machine in local mode only, as in tests: executors on
    other machines would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cellarium-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder for a table that goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/cellarium-{kind}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@atexit.register
def _clean() -> None:
    while _scratch:
        try:
            delete(*_scratch.pop())
        except Exception:  # the session may have ended before the interpreter
            return
