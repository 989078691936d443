"""Grouped totals of a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ["input_tokens", "output_tokens", "extra_tokens", "cache_read_tokens"]


def summed(counters: list[str] = COUNTERS) -> list[Column]:
    return [F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c) for c in counters]


def overall_totals(ledger: DataFrame) -> DataFrame:
    """Messages, the four counters and input plus output."""
    return ledger.agg(F.count("*").alias("messages"), *summed()).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def _totals(df: DataFrame) -> DataFrame:
    io = F.col("input_tokens") + F.col("output_tokens")
    return df.withColumns({"total_tokens": io, "total_with_cache": io + F.col("extra_tokens") + F.col("cache_read_tokens")})


def model_breakdown(ledger: DataFrame, key: list[str] = ["model_key"]) -> DataFrame:  # noqa: B006
    """Per key: messages, counters, total and total with cache."""
    return _totals(ledger.groupBy(*key).agg(F.count("*").alias("messages"), *summed()))


def with_total_row(groups: DataFrame, key: str = "model_key") -> DataFrame:
    """The groups and one row, marked is_total, that sums them; its key is null."""
    numbers = [c for c in groups.columns if c != key]
    rolled = groups.rollup(key).agg(F.grouping(key).alias("is_total"), *[F.sum(c).alias(c) for c in numbers])
    return rolled.select(key, *numbers, (F.col("is_total") == 1).alias("is_total"))


def percent_of_total(df: DataFrame, value: str, name: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``value`` as percent of its sum (per ``by``), 0 where that is 0; for aggregated frames."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn(name, F.when(total > 0, F.col(value) * 100.0 / total).otherwise(0.0).cast("double"))


def by_total(df: DataFrame, value: str = "total_tokens", key: str = "model_key") -> DataFrame:
    return df.orderBy(F.desc(value), key)


def by_fixed_order(df: DataFrame, names: DataFrame, key: str = "model_key") -> DataFrame:
    """Keys with a place in ``names`` (key, sort_order) first, in that order, then the others by name."""
    return df.join(names.select(key, "sort_order"), key, "left").orderBy(F.asc_nulls_last("sort_order"), key)


def vendor_totals(ledger: DataFrame) -> DataFrame:
    """(vendor, tokens): the four counters together, without vendors that have none."""
    total = sum((F.coalesce(c, F.lit(0)) for c in COUNTERS), F.lit(0))
    return ledger.groupBy("vendor").agg(F.sum(total).alias("tokens")).where(F.col("tokens") > 0)
