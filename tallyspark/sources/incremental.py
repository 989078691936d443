"""Incremental refresh: only files that are new or changed are parsed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import existing, file_path
from .scratch import shared_folder

MANIFEST = "path string, modified timestamp, length long"


def list_files(spark: SparkSession, roots: list[str], pattern: str) -> DataFrame:
    """(path, modified, length) of the files under the roots; contents are not read."""
    roots = existing(spark, roots)
    if not roots:
        return spark.createDataFrame([], MANIFEST)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(roots)
    return files.select(file_path().alias("path"), F.col("modificationTime").alias("modified"), F.col("length"))


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest lacks or has with another time or length."""
    return files.join(manifest, ["path", "modified", "length"], "left_anti")


def gone_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(files.select("path"), "path", "left_anti")


def refresh(spark: SparkSession, roots: list[str], pattern: str, manifest: DataFrame, ledger: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(ledger, manifest) brought up to date. ``parse`` makes ledger rows of a listing (path, modified, length).

    The listing is written before anything is parsed, and is what the new manifest says: a file that
    grows meanwhile may be read with more rows than listed, and is then parsed again next time. Only the
    oldest time of the changed files reaches the driver. Rows of changed and of deleted files are
    replaced, others stay untouched. What depends on other files, such as which of repeated messages
    counts, is not for ``parse``: the ledger keeps every row, and ``logs.first_messages`` is applied to it
    after each refresh, so that it equals a full read.
    """
    folder = shared_folder(spark, "listing")
    list_files(spark, roots, pattern).write.parquet(folder)
    files = spark.read.schema(MANIFEST).parquet(folder)
    changed_files(files, manifest).write.parquet(f"{folder}-changed")
    changed = spark.read.schema(MANIFEST).parquet(f"{folder}-changed")  # its size is known, so a short list is broadcast to the lines and these are not shuffled
    stale = changed.select("path").union(gone_files(files, manifest).select("path"))
    kept = ledger.join(stale.select(F.col("path").alias("source_file")), "source_file", "left_anti").select(*ledger.columns)
    return kept.unionByName(parse(changed)), files
