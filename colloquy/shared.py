"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder in the warehouse, or a temporary one if the session runs on
    one machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app not in _own:
        alone = master.startswith("local") and not master.startswith("local-cluster")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="colloquy-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_colloquy"
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the session ends."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path
