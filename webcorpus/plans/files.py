"""Small files and folders on whatever file system Spark writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _at(spark, path)
    return system.exists(found)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    found, system = _at(spark, folder)
    if not system.exists(found):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(found))


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file, or a folder with what it holds."""
    found, system = _at(spark, path)
    system.delete(found, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    found, system = _at(spark, path)
    return system.getContentSummary(found).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    found, system = _at(spark, path)
    stream = system.open(found)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes the file beside its place and renames it, so that it is there whole or not."""
    beside, system = _at(spark, f"{path}.part")
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    found, _ = _at(spark, path)
    system.delete(found, False)
    if not system.rename(beside, found):
        raise OSError(f"could not write {path}")
