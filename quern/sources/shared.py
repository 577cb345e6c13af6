"""The folder that the driver and all executors share, for tables written between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from quern.errors import QuernError

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder, but only if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise QuernError(f"spark.checkpoint.dir is not set, and {master} needs a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder; release() removes what has been written there."""
    _made.append(f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> int:
    """Deletes all tables written between stages so far, through Spark's own file systems.

    DataFrames that this process made before read from them, so call it when their results are written. Returns how
    many folders were there.
    """
    gone, jvm = 0, spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True))
    return gone
