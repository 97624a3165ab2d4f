"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from webcorpus.plans import files

_SETTING = "spark.checkpoint.dir"
# local mode without the setting: one folder for all sessions of this process
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only in local mode."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder all executors can reach")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="webcorpus-"))
    return _local[0]


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end, when nothing may read them any more."""
    outer, _scopes.folders = getattr(_scopes, "folders", None), []
    try:
        yield
    finally:
        for folder in _scopes.folders:
            files.remove(spark, folder)
        _scopes.folders = outer


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the table once and read it back: later steps prune its columns, and a lost
    executor costs a file read instead of the steps before it."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    if getattr(_scopes, "folders", None) is not None:
        _scopes.folders.append(folder)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
