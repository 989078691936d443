"""The ledger as a stored table: reads of the last days that prune, refresh in proportion to change, rollups.

Under one folder lie ``ledger`` (Parquet by vendor and date, all rows, ``kept`` says which count), ``keys`` (an entry for
every row with message and request, in buckets by their hash), ``files`` (what has been read of each log file) and
``rollup`` (sums by minute, hour and day). A refresh reads and writes only what changed files touch: their
new lines, the buckets of their keys, and the dates of their rows and of rows that begin or cease to count.

*Files.* A log that has grown is read from the line at which the last refresh ended, if a digest of the lines
before it is still the same; else, and where a layout cannot be parsed from its middle, it is read anew. Rows of
files that are gone or read anew are replaced.

*Interruption.* Before the table is touched, the dates that will be are noted with the files. A refresh that is
begun again cuts what the interrupted one may have written there, so it ends with the same table.

Partitions are found by the names of their folders, one for each vendor and day; these names, numbers of buckets and
dates touched are what reaches the driver.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timebuckets import before, bucket_start
from ..operators.breakdown import COUNTERS, summed
from ..operators.normalize import whole_key
from . import incremental, logs
from .schemas import LEDGER, LEDGER_COLUMNS
from .scratch import drop, names, shared_folder, versions

#: Parts of the key index.
BUCKETS = 64
STORED = LEDGER.replace("vendor STRING, ", "", 1) + ", kept BOOLEAN, vendor STRING, event_date DATE"
DATES = "array<struct<vendor: string, event_date: date>>"
FILES = f"path string, modified timestamp, length long, lines long, digest decimal(38,0), dates {DATES}, pending {DATES}"
KEYS = "message_id string, request_id string, rank int, source_file string, ord int, vendor string, event_date date, kept boolean, bucket int"
LEVELS = {"minute": 1, "hour": 60, "day": 1440}
ROLLUP = "bucket timestamp_ntz, model_key string, " + ", ".join(f"{c} long" for c in COUNTERS) + ", messages long, vendor string, event_date date"

Day = tuple[str, "datetime.date | None"]


def stored_days(spark: SparkSession, folder: str) -> list[Day]:
    """Vendor and date of every partition of a ledger, by the names of its folders."""
    found = [re.search(r"/vendor=([^/]*)/event_date=([^/]*)$", n).groups() for n in names(spark, f"{folder}/vendor=*/event_date=*")]
    return [(unquote(v), None if d.startswith("__HIVE") else datetime.date.fromisoformat(d)) for v, d in found]


def on_days(days: list[Day]) -> Column:
    """Whether a row lies in one of these partitions."""
    by: dict[str, list] = {}
    for v, d in days:
        by.setdefault(v, []).append(d)
    out = F.lit(False)
    for v, ds in by.items():
        dated = [d for d in ds if d is not None]
        inside = F.col("event_date").isin(dated) if dated else F.lit(False)
        out = out | ((F.col("vendor") == v) & ((inside | F.col("event_date").isNull()) if None in ds else inside))
    return out


def read_stored(spark: SparkSession, folder: str, every: bool = False) -> DataFrame:
    """A ledger that ``logs.write_ledger`` or a refresh has written, with ``event_date``; rows that count, or every row with ``kept``."""
    rows = spark.read.schema(STORED).parquet(folder) if logs.existing(spark, [folder]) else spark.createDataFrame([], STORED)
    return rows if every else rows.where(F.coalesce("kept", F.lit(True))).drop("kept")


def _newest(rows: DataFrame, dates: list[datetime.date]) -> Column | None:
    """The newest time as a scalar read from the newest date that has a row, and the one before it, as dates depend on the writer's zone."""
    for newest in sorted(dates, reverse=True):
        if not rows.where(F.col("event_date") == newest).limit(1).isEmpty():
            return rows.where(F.col("event_date") >= newest - datetime.timedelta(1)).agg(F.max("event_ts")).scalar()
    return None


def stored_last_days(spark: SparkSession, folder: str, days: float, vendor: str | None = None, by_vendor: bool = False) -> DataFrame:
    """``filters.last_days`` of a stored ledger, reading only the folders of those days: of the newest row, or of each vendor's.

    Rows without a time are left out, unless none has one.
    """
    rows = read_stored(spark, folder)
    rows = rows if vendor in (None, "all") else rows.where(F.col("vendor") == vendor)
    found: dict[str | None, list] = {}
    for v, d in stored_days(spark, folder):
        if d is not None and vendor in (None, "all", v):
            found.setdefault(v if by_vendor else None, []).append(d)
    folders, exact, timed = F.lit(False), F.lit(False), []
    for v, dates in found.items():
        mine = F.lit(True) if v is None else F.col("vendor") == v
        newest = _newest(rows.where(mine), dates)
        if newest is not None:
            first = before(newest, days)
            folders = folders | (mine & (F.col("event_date") >= F.date_sub(F.to_date(first), 1)))
            exact = exact | (mine & (F.col("event_ts") >= first))
            timed.append(v)
    if not timed:
        return rows.select(*LEDGER_COLUMNS)
    out = rows.where(folders).where(exact)
    return (out.unionByName(rows.where(~F.col("vendor").isin(timed))) if by_vendor else out).select(*LEDGER_COLUMNS)


def _write_parts(df: DataFrame, path: str, by: list[str], rebalance: bool = True) -> None:
    """Replace the partitions that ``df`` has rows of, and no others."""
    spread = df.hint("rebalance", *by) if rebalance else df
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _scratch(df: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _days_of(df: DataFrame) -> list[Day]:
    return [(r.vendor, r.event_date) for r in df.select("vendor", "event_date").distinct().collect()]  # one per vendor and day


def _part(day: Day) -> str:
    return f"vendor={day[0]}/event_date={day[1] or '__HIVE_DEFAULT_PARTITION__'}"


class Store:
    """A stored ledger under ``path``; each layout of logs, by its name, has a list of files of its own."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.folder = spark, path, f"{path}/ledger"

    def rows(self) -> DataFrame:
        return read_stored(self.spark, self.folder).select(*LEDGER_COLUMNS)

    def last_days(self, days: float, vendor: str | None = None, by_vendor: bool = False) -> DataFrame:
        return stored_last_days(self.spark, self.folder, days, vendor, by_vendor)

    def files(self, name: str) -> DataFrame:
        """What has been read: (path, modified, length, lines, digest, dates, pending)."""
        done = versions(self.spark, f"{self.path}/files/{name}")
        return self.spark.read.schema(FILES).parquet(f"{self.path}/files/{name}/v={done[-1]}") if done else self.spark.createDataFrame([], FILES)

    def _note(self, name: str, files: DataFrame) -> None:
        done = versions(self.spark, f"{self.path}/files/{name}")
        files.write.mode("overwrite").parquet(f"{self.path}/files/{name}/v={done[-1] + 1 if done else 0}")
        for old in done[:-1]:
            drop(self.spark, f"{self.path}/files/{name}/v={old}")

    def refresh(self, name: str, roots: list[str], pattern: str, parse: Callable[[DataFrame], DataFrame], by_line: bool = True) -> tuple[list[Day], int]:
        """Bring the ledger up to date with the logs under the roots; the partitions that were written, and how many rows were parsed.

        ``parse`` makes ledger rows of lines (source_file, root_rank, ord, line). ``by_line``: each line stands for
        itself, so that a log that has grown need only be parsed from where it ended.
        """
        known = _scratch(self.files(name), "known")
        listing = _scratch(incremental.list_files(self.spark, roots, pattern), "listing")
        changed = incremental.changed_files(listing, known.select("path", "modified", "length"))
        gone = incremental.gone_files(listing, known)
        if changed.isEmpty() and gone.isEmpty():
            return [], 0
        lines = logs.read_lines(self.spark, roots, pattern, listing=changed)
        cuts = _scratch(self._cuts(lines, changed, gone, known, by_line), "cuts")  # (path, start, lines, digest): what is read of a file, and from which line
        starts = cuts.where(F.col("lines").isNotNull()).select(F.col("path").alias("source_file"), "start")
        fresh = parse(lines.join(starts, "source_file").where(F.col("ord") >= F.col("start")).drop("start"))
        fresh = _scratch(fresh.select(*LEDGER_COLUMNS, F.to_date("event_ts").alias("event_date")), "fresh")

        mine = fresh.groupBy(F.col("source_file").alias("path")).agg(F.collect_set(F.struct("vendor", "event_date")).alias("_new"))
        both = lambda *c: F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast(DATES)) for x in c]))
        noted = listing.select("path", "modified", "length").join(known.select("path", F.lit(True).alias("_known"), "lines", "digest", "dates", "pending"), "path", "full")
        noted = noted.join(cuts.select("path", "start", F.col("lines").alias("_lines"), F.col("digest").alias("_digest")), "path", "left").join(mine, "path", "left")
        noted = _scratch(noted, "noted")
        cut = F.col("start").isNotNull()
        self._note(name, noted.where(F.col("_known") | cut).select(
            "path", F.when(~cut, F.col("modified")).alias("modified"), F.when(~cut, F.col("length")).alias("length"), "lines", "digest", "dates",
            F.when(cut, both(F.col("pending"), F.col("_new"))).alias("pending")).select(*[F.col(c) for c in ("path", "modified", "length", "lines", "digest", "dates", "pending")]))

        old = noted.where(cut & F.col("_known")).select(F.explode(both(F.col("pending"), F.when(F.col("start") == 0, F.col("dates")))).alias("d")).select("d.*")
        touched, entries, flags = self._judged(fresh, cuts, _days_of(old))
        days = sorted({*_days_of(old), *_days_of(fresh), *touched}, key=str)
        self._replace(fresh, cuts, flags, days)
        if entries is not None:
            buckets, held = entries
            _write_parts(held, f"{self.path}/keys", ["bucket"])
            left = {r.bucket for r in held.select("bucket").distinct().collect()}
            for b in buckets:
                if b not in left:
                    drop(self.spark, f"{self.path}/keys/bucket={b}")

        whole = F.when(F.col("start") == 0, both(F.col("_new"))).otherwise(both(F.col("dates"), F.col("_new")))
        self._note(name, noted.where(F.col("modified").isNotNull()).select(
            "path", "modified", "length", F.when(cut, F.coalesce("_lines", F.lit(0))).otherwise(F.col("lines")).alias("lines"), F.when(cut, F.col("_digest")).otherwise(F.col("digest")).alias("digest"),
            F.when(cut, whole).otherwise(F.col("dates")).alias("dates"), F.lit(None).cast(DATES).alias("pending")))
        return days, fresh.count()

    def _cuts(self, lines: DataFrame, changed: DataFrame, gone: DataFrame, known: DataFrame, by_line: bool) -> DataFrame:
        """(path, start, lines, digest): rows of these files from line ``start`` on are replaced; no lines for files that are gone or have none."""
        mark = F.xxhash64("ord", "line").cast("decimal(38,0)")
        was = known.select(F.col("path").alias("source_file"), F.col("lines").alias("_lines"), F.col("digest").alias("_digest"))
        summed_ = lines.join(was, "source_file", "left").groupBy("source_file").agg(
            (F.max("ord") + 1).cast("long").alias("lines"), F.sum(mark).alias("digest"), F.sum(F.when(F.col("ord") < F.col("_lines"), mark)).alias("_prefix"), F.first("_lines").alias("_lines"), F.first("_digest").alias("_digest"))
        same = F.coalesce((F.col("_prefix") == F.col("_digest")) & (F.col("_lines") > 0), F.lit(False)) & F.lit(by_line)
        read = summed_.select(F.col("source_file").alias("path"), F.when(same, F.col("_lines")).otherwise(0).alias("start"), "lines", "digest")
        return changed.select("path").union(gone.select("path")).join(read, "path", "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long"))).select("path", "start", "lines", "digest")

    def _judged(self, fresh: DataFrame, cuts: DataFrame, days: list[Day]) -> tuple[set[Day], tuple[list[int], DataFrame] | None, DataFrame | None]:
        """The partitions of rows that begin or cease to count, the new entries of the buckets touched, and which of their rows count."""
        key, place = ["message_id", "request_id"], F.struct("rank", "source_file", "ord")
        bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int").alias("bucket")
        cut = cuts.select(F.col("path").alias("source_file"), "start")
        out = read_stored(self.spark, self.folder, True).where(on_days(days)).select(*key, "source_file", "ord").join(cut, "source_file").where(F.col("ord") >= F.col("start"))
        met = _scratch(fresh.select(*key).union(out.select(*key)).where(whole_key(key)).distinct().select(*key, bucket), "keys")
        buckets = sorted(r.bucket for r in met.select("bucket").distinct().collect())  # at most BUCKETS
        if not buckets:
            return set(), None, None
        have = f"{self.path}/keys"
        entries = self.spark.read.schema(KEYS).parquet(have) if logs.existing(self.spark, [have]) else self.spark.createDataFrame([], KEYS)
        entries = entries.where(F.col("bucket").isin(buckets)).join(cut, "source_file", "left").where(F.col("start").isNull() | (F.col("ord") < F.col("start"))).drop("start")
        new = fresh.where(whole_key(key)).select(*key, F.col("source_root").cast("int").alias("rank"), "source_file", "ord", "vendor", "event_date", F.lit(None).cast("boolean").alias("kept"), bucket)
        every = entries.select(*new.columns).union(new)
        first = every.join(met, [*key, "bucket"], "left_semi").groupBy(*key).agg(F.min(place).alias("_first"))
        judged = every.join(first, key, "left").withColumn("_now", F.when(F.col("_first").isNotNull(), place == F.col("_first")).otherwise(F.col("kept")))
        judged = _scratch(judged.select(*[c for c in new.columns if c != "kept"], F.col("kept").alias("_was"), F.col("_now").alias("kept"), F.col("_first").isNotNull().alias("_met")), "judged")
        flips = _days_of(judged.where(F.col("_was").isNotNull() & (F.col("_was") != F.col("kept"))))
        return set(flips), (buckets, judged.select("message_id", "request_id", "rank", "source_file", "ord", "vendor", "event_date", "kept", "bucket")), judged.where("_met").select("source_file", "ord", F.col("kept").alias("_kept"))

    def _replace(self, fresh: DataFrame, cuts: DataFrame, flags: DataFrame | None, days: list[Day]) -> None:
        """Write these partitions anew: without the rows that are cut, with the fresh ones."""
        columns = [*LEDGER_COLUMNS, "kept", "event_date"]
        cut = cuts.select(F.col("path").alias("source_file"), "start")
        base = read_stored(self.spark, self.folder, True).where(on_days(days)).join(cut, "source_file", "left").where(F.col("start").isNull() | (F.col("ord") < F.col("start")))
        rows = base.select(*columns).union(fresh.withColumn("kept", F.lit(True)).select(*columns))
        if flags is not None:
            rows = rows.join(flags, ["source_file", "ord"], "left").withColumn("kept", F.coalesce("_kept", "kept")).select(*columns)
        rows = _scratch(rows, "rows")
        _write_parts(rows, self.folder, ["vendor", "event_date"])
        left = set(_days_of(rows))
        for day in days:
            if day not in left:
                drop(self.spark, f"{self.folder}/{_part(day)}")

    def fold(self, days: list[Day]) -> None:
        """Bring the rollups of these partitions up to date; each level is summed from the one below."""
        dated = [d for d in days if d[1] is not None]
        if not dated:
            return
        keys = ["vendor", "event_date", "bucket", "model_key"]
        rows = read_stored(self.spark, self.folder).where(on_days(dated)).withColumn("bucket", bucket_start(F.col("event_ts"), 1))
        level = rows.groupBy(*keys).agg(*summed(), F.count("*").alias("messages"))
        for name, minutes in LEVELS.items():
            if minutes > 1:
                level = level.withColumn("bucket", bucket_start(F.col("bucket"), minutes)).groupBy(*keys).agg(*summed(), F.sum("messages").alias("messages"))
            level = _scratch(level, "rollup")
            _write_parts(level, f"{self.path}/rollup/{name}", ["vendor", "event_date"])
            left = set(_days_of(level))
            for day in dated:
                if day not in left:
                    drop(self.spark, f"{self.path}/rollup/{name}/{_part(day)}")

    def rollup(self, minutes: int) -> DataFrame:
        """(bucket, vendor, model_key, counters, messages) at the coarsest stored level from which this step can be summed."""
        name = "day" if minutes >= 1440 else "hour" if minutes % 60 == 0 else "minute"
        place = f"{self.path}/rollup/{name}"
        return self.spark.read.schema(ROLLUP).parquet(place) if logs.existing(self.spark, [place]) else self.spark.createDataFrame([], ROLLUP)

    def series(self, minutes: int, key: str = "vendor", days: float | None = None) -> DataFrame:
        """(bucket, key, counters) from the rollup; of the last ``days`` only, with the rows of the first of their dates read from the ledger."""
        sums = self.rollup(minutes)
        if days is not None:
            dates = [d for _, d in stored_days(self.spark, self.folder) if d is not None]
            rows = read_stored(self.spark, self.folder)
            newest = _newest(rows, dates)
            if newest is None:
                return sums.where(F.lit(False)).groupBy("bucket", key).agg(*summed())
            first = before(newest, days)
            edge = rows.where((F.col("event_date") >= F.date_sub(F.to_date(first), 1)) & (F.col("event_date") <= F.date_add(F.to_date(first), 1)))
            edge = edge.where((F.col("event_ts") >= first) & (F.to_date("event_ts") == F.to_date(first))).select(F.col("event_ts").cast("timestamp_ntz").alias("bucket"), key, *COUNTERS)
            sums = sums.where(F.col("event_date") > F.to_date(first)).select("bucket", key, *COUNTERS).unionByName(edge)
        return sums.withColumn("bucket", bucket_start(F.col("bucket"), minutes)).groupBy("bucket", key).agg(*summed())
