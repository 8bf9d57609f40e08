"""Folders in any store that Spark knows: names below one, removal, and a new one for work tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder, none if it does not exist."""
    store, where = _folder(spark, path)
    return sorted(status.getPath().getName() for status in store.listStatus(where)) if store.exists(where) else []


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers n of the subfolders ``<prefix>=<n>`` whose writing has ended, ascending."""
    marked = [n for n in names(spark, path) if n.startswith(f"{prefix}=")]
    return sorted(int(n.split("=")[1]) for n in marked if "_SUCCESS" in names(spark, f"{path}/{n}"))


def remove(spark: SparkSession, path: str) -> None:
    store, where = _folder(spark, path)
    store.delete(where, True)


def new_folder(spark: SparkSession) -> str:
    """Below the folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="wiretally-work-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
