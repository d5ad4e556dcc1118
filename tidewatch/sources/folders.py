"""Folders of tables in any file system Spark can reach: what is there, what is complete, what can go."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    fs, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder has been committed."""
    fs, where = _at(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    fs, where = _at(spark, path)
    return fs.getContentSummary(where).getLength()


def date_in_order(spark: SparkSession, path: str) -> None:
    """Date the files of a written table a second apart, in the order of its partitions; a stream takes the oldest first."""
    fs, where = _at(spark, path)
    files = sorted((x.getPath() for x in fs.listStatus(where) if x.getPath().getName().startswith("part-")), key=lambda x: x.getName())
    start = int(time.time()) - len(files)
    for i, file in enumerate(files):
        fs.setTimes(file, (start + i) * 1000, -1)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)
