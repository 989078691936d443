"""What several of the operators need: reading a table, cutting lineage, hashing."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the operators mean it.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that ``spark.checkpoint.dir`` names. Only on a single machine, as in tests, may that be unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def wide_hash(*key: Column) -> list[Column]:
    """Two independent 64-bit hashes; as a pair they tell apart far more keys than any corpus has."""
    return [F.xxhash64(*key), F.xxhash64(F.lit(1), *key)]


def slices(batches: Iterator[pa.Array | pa.RecordBatch], rows: int = 256) -> Iterator[pa.Array | pa.RecordBatch]:
    """Smaller pieces of the batches, so that a worker holds the results of few long values at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return what a task has freed to the machine: workers live on, and what their allocators keep adds up over the stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)
