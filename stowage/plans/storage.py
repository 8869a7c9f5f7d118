"""Reliable checkpoints in the session's shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of our own only where none is set and the session is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or os.path.join(tempfile.gettempdir(), "stowage-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the shared one, as a path of mounted files, for sinks that write through the file system; removed when the driver ends."""
    root = checkpoint_dir(spark).removeprefix("file://").removeprefix("file:")
    if "://" in root:
        raise RuntimeError("sinks to files need a mounted shared folder, not " + root)
    path = os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, True)
    return path
