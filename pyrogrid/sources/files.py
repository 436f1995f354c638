"""Folders and files through the file system that Spark uses for a path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def path_of(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = path_of(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    p, fs = path_of(spark, path)
    fs.delete(p, True)


def leaves(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, none if it does not exist."""
    p, fs = path_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def versions(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(version, path) of the complete ``v=`` folders of a folder, oldest first."""
    p, fs = path_of(spark, folder)
    if not fs.exists(p):
        return []
    found = []
    for status in fs.listStatus(p):
        leaf = status.getPath().getName()
        if leaf.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append((int(leaf[2:]), status.getPath().toString()))
    return sorted(found)
