"""Filters on a ledger: last days, shares, vendors, included keys, empty series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timebuckets import before


def last_days(df: DataFrame, days: float, ts: str = "event_ts", by: str | None = None) -> DataFrame:
    """Rows of the last ``days`` times 24 hours before the newest row (of each ``by``); all rows where none has a time."""
    kind = df.schema[ts].dataType.simpleString()
    if by is None:
        newest = df.agg(F.max(ts)).scalar()
        return df.where(newest.isNull() | (F.col(ts) >= before(newest, days).cast(kind)))
    newest = df.groupBy(by).agg(F.max(ts).alias("_newest"))
    return df.join(newest, by).where(F.col("_newest").isNull() | (F.col(ts) >= before(F.col("_newest"), days).cast(kind))).drop("_newest")


def share_threshold(groups: DataFrame, count: str = "messages", least: float = 0.01) -> DataFrame:
    """Groups with at least that share of all rows; ``groups`` is an aggregate, so its few rows may meet."""
    total = F.sum(count).over(Window.partitionBy())
    return groups.withColumn("_total", total).where(~(F.col(count) / F.col("_total") < least)).drop("_total")


def of_vendor(df: DataFrame, vendor: str | None) -> DataFrame:
    return df if vendor in (None, "all") else df.where(F.col("vendor") == vendor)


def included(df: DataFrame, keys: DataFrame, key: str = "model_key") -> DataFrame:
    """Rows whose key is among ``keys``."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def without_empty_series(series: DataFrame, key: list[str], value: str) -> DataFrame:
    """Series that are not zero throughout."""
    return series.join(series.groupBy(*key).agg(F.max(value).alias("_most")).where(F.col("_most") > 0).select(*key), key, "left_semi")
