"""Structured Streaming: the vendor and model series kept up to date from landed files.

The watermark stands on the bucket column, so late rows within it update their bucket and later
ones are left to a batch backfill. Windows over file order are not for streams: event logs are parsed in
each micro-batch, from where the sessions of earlier ones stood. What streams keep is bounded: a sink
merges updates into one row for each bucket and key of the last days, and idle sessions are forgotten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timebuckets import bucket_start
from ..operators.breakdown import COUNTERS
from ..operators.normalize import whole_key
from ..operators.timeseries import span_ends, sweep
from ..sources import logs
from ..sources.scratch import drop, versions


def read_landed(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def first_seen_stream(rows: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each whole key within the watermark; rows that lack part of the key, or have it empty, all pass."""
    marked, whole = rows.withWatermark(ts, late), whole_key(key)
    return marked.where(whole).dropDuplicatesWithinWatermark(key).unionByName(marked.where(~whole))


def series_stream(ledger: DataFrame, minutes: int, key: str = "vendor", late: str = "3 days") -> DataFrame:
    """(bucket, key, tokens) of a stream; UTC sessions, as a stream's time is an instant."""
    bucket = bucket_start(F.col("event_ts"), minutes).cast("timestamp")
    total = sum((F.coalesce(c, F.lit(0)) for c in COUNTERS), F.lit(0))
    rows = ledger.where(F.col("event_ts").isNotNull()).withColumn("bucket", bucket).withWatermark("bucket", late)
    return rows.groupBy("bucket", key).agg(F.sum(total).alias("tokens"))


def spread_stream(ledger: DataFrame, minutes: int, key: str = "model_key", late: str = "3 days") -> DataFrame:
    """The ends of sessions (``span_ends``) summed by bucket; ``spread_now`` makes the series of them. No row for each bucket of a span."""
    ends = span_ends(ledger, minutes, [key]).withColumn("bucket", F.col("bucket").cast("timestamp")).withWatermark("bucket", late)
    return ends.groupBy("bucket", key, "n", "phase").agg(*[F.sum(c).alias(c) for c in [*COUNTERS, "rows"]])


def spread_now(ends: DataFrame, minutes: int, key: str = "model_key") -> DataFrame:
    """(bucket, key, counters): sessions spread evenly over their buckets, from what ``spread_stream`` has summed."""
    return sweep(ends.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")), minutes, [key])


def keep_current(series: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run the stream: updated rows of each micro-batch go to ``sink``; without ``every``, once over all that has landed."""
    writer = series.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest_of(path: str, spark: SparkSession, key: list[str], value: str) -> DataFrame:
    """The current state of update rows that ``append_updates`` wrote."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*key).agg(F.max_by(value, "batch").alias(value))


def append_updates(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes every batch's rows under its number; a batch that runs again replaces itself."""

    def sink(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/part={batch}")

    return sink


def _state(path: str, spark: SparkSession, schema, before: int | None = None) -> DataFrame:
    """The newest whole version of a table (older than ``before``), or an empty one."""
    done = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{path}/v={done[-1]}") if done else spark.createDataFrame([], schema)


def _keep(df: DataFrame, path: str, version: int) -> None:
    """Write a version; of the older ones only the last stays, from which this one can be made again."""
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
    for old in [v for v in versions(df.sparkSession, path) if v < version][:-1]:
        drop(df.sparkSession, f"{path}/v={old}")


def merge_updates(path: str, key: list[str], keep_days: float | None = None, bucket: str = "bucket") -> Callable[[DataFrame, int], None]:
    """A sink that holds one row for each current key, of the buckets that begin at most ``keep_days`` before the newest.

    Each batch writes the table anew, which is as large as these days and keys, however long the stream has run. A
    batch that runs again starts from the version before it.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        held = _state(path, rows.sparkSession, rows.schema, batch)
        values = [c for c in rows.columns if c not in key]
        both = held.withColumn("_at", F.lit(0)).unionByName(rows.withColumn("_at", F.lit(1)))
        merged = both.groupBy(*key).agg(F.max_by(F.struct(*values), "_at").alias("v")).select(*key, "v.*").select(*rows.columns)
        if keep_days is not None:
            newest = F.greatest(held.agg(F.max(bucket)).scalar(), rows.agg(F.max(bucket)).scalar())
            merged = merged.where(newest.isNull() | (F.col(bucket) >= F.timestamp_micros(F.unix_micros(newest) - int(keep_days * 86_400_000_000))))
        _keep(merged, path, batch)

    return sink


def current(path: str, spark: SparkSession, schema) -> DataFrame:
    """What ``merge_updates`` holds now."""
    return _state(path, spark, schema)


def read_landed_logs(spark: SparkSession, path: str, pattern: str = "*.jsonl", files_per_batch: int = 1000) -> DataFrame:
    """(file, block, value): the lines of log files as they land, by the splits that Spark makes of large files; a file is complete when it lands, a session may go on in a later one."""
    files = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return files.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _placed(files: DataFrame) -> tuple[DataFrame, Column]:
    """Lines (file, block, _id, line) of either form of landed logs, ids rising inside a split without a gap; and a file's path."""
    if "block" in files.columns:
        return files.select("file", "block", F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line")), logs.file_path("file")
    ended = F.split(F.regexp_replace("value", r"(\r\n|\n|\r)$", ""), logs.NEW_LINE)  # the end of the last line begins no other
    return files.where(F.col("value") != "").select(F.col("path").alias("file"), F.lit(0).alias("block"), F.posexplode(ended).alias("_id", "line")), F.col("file")


def event_log_sink(path: str, session: Callable[[Column], Column], idle_days: float = 30) -> Callable[[DataFrame, int], None]:
    """A sink for ``read_landed_logs`` (or whole files: path, value) that parses event logs across batches: ledger rows in ``rows/batch=n``, where sessions stand in ``state``.

    ``session`` names a file's session by its path; files of a session are in the order of their paths, and later batches
    follow earlier ones. Lines are numbered on from batch to batch. Sessions whose newest event lies more than ``idle_days`` before
    the newest of all are forgotten: should one go on after that, it starts without a model. A batch that runs again replaces itself.

    No task holds a file: one pass counts the lines of each split, a second parses them, and what it finds stays in
    ``work`` until rows and state are made of it. Only the splits of a session meet in one task.
    """

    def sink(files: DataFrame, batch: int) -> None:
        spark, folder, work = files.sparkSession, f"{path}/state", f"{path}/work"

        def settled(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{work}/{name}")
            return spark.read.schema(df.schema).parquet(f"{work}/{name}")

        state = _state(folder, spark, logs.EVENT_STATE, batch)
        placed, file = _placed(files)
        stated = logs.parse_timestamp(F.get_json_object(F.trim("line"), "$.timestamp"))
        ends = logs.split_ends(placed, ["file", "block"], F.max(stated).alias("_newest")).withColumns({"path": file, "source_file": session(file)})
        before = logs.with_base(ends, ["source_file"], ["path", "block"]).join(state.select("source_file", "lines"), "source_file", "left")
        splits = settled(before.withColumn("_base", F.col("_base") + F.coalesce("lines", F.lit(0))).drop("path", "lines"), "splits")  # small, and known to be so
        lines = logs.placed_lines(placed, splits, ["file", "block"]).select("source_file", F.lit(0).alias("root_rank"), "ord", F.trim("line").alias("line")).where(F.col("line") != "")
        found = settled(logs.events(lines), "events")
        met = state.join(splits.select("source_file").distinct(), "source_file", "left_semi")
        logs.event_rows(found, state=met).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        read = splits.groupBy("source_file").agg(F.max(F.col("_base") + F.col("_high") - F.col("_low") + 1).alias("_lines"))
        newest = F.greatest(state.agg(F.max("newest")).scalar(), splits.agg(F.max("_newest")).scalar())
        recent = F.coalesce(F.col("newest") >= F.timestamp_micros(F.unix_micros(newest) - int(idle_days * 86_400_000_000)), F.lit(True))
        _keep(logs.event_state(found, read, state).where(recent), folder, batch)
        drop(spark, work)

    return sink


def watermark_of(query: StreamingQuery) -> str | None:
    """The watermark that a query has reached: buckets up to it take no more rows."""
    return (query.lastProgress or {}).get("eventTime", {}).get("watermark")


def late_rows(ledger: DataFrame, minutes: int, watermark: str) -> DataFrame:
    """Rows that the stream of this series has left out, for the batch backfill."""
    return ledger.where(F.col("event_ts").isNotNull() & (bucket_start(F.col("event_ts"), minutes).cast("timestamp") <= F.lit(watermark).cast("timestamp")))
