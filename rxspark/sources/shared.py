"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Only a session whose executors are threads of the driver may do without: it gets a
    temporary folder, which goes with the driver's Python."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="rxspark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; what is there goes at the end of the driver's Python."""
    path = f"{shared_dir(spark)}/rx-{name}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, files = _hadoop(spark, path)
    return files.exists(p)


def drop(spark: SparkSession, path: str) -> None:
    """Best effort: a JVM that is already gone needs no clean-up here."""
    try:
        p, files = _hadoop(spark, path)
        files.delete(p, True)
    except Exception:  # noqa: BLE001
        pass
