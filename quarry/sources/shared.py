"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a new local folder, if driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """The address of a folder of our own in the shared one, not made yet. It is removed when the session's JVM ends."""
    at = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    files.delete(place, True)
    return at


def mounted(address: str) -> str:
    """The path of a shared folder that is mounted as a file system; others can't hold trees of plain files."""
    parts = urlparse(address)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{address} is no mounted folder")
    return parts.path
