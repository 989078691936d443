"""A folder that all executors share, for files between two steps of a job, and names in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names. Only on a single machine may that be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallyspark-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def names(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the file system that Spark itself uses that fit a pattern."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [s.getPath().toString() for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []]


def drop(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers n of the whole tables ``v=n`` in a folder, rising."""
    return sorted(int(n.split("/")[-2].removeprefix("v=")) for n in names(spark, f"{folder}/v=*/_SUCCESS"))


def move(spark: SparkSession, source: str, target: str) -> None:
    """Give a file another path, in the place of what was there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = new.getFileSystem(conf)
    fs.mkdirs(new.getParent())
    fs.delete(new, False)
    if not fs.rename(old, new):
        raise OSError(f"could not move {source} to {target}")
