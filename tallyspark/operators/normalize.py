"""Order-dependent clean-up: carry forward, drop repeats, first seen, session bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], default: str = "unknown") -> DataFrame:
    """Each named column: the last non-empty value so far within ``by``, else the default; each advances on its own."""
    seen = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({name: F.coalesce(F.last(F.nullif(v, F.lit("")), ignorenulls=True).over(seen), F.lit(default)) for name, v in values.items()})


def drop_repeats(df: DataFrame, by: list[str], order: list[str], key: list[str], start: Column | None = None) -> DataFrame:
    """Without rows whose key equals that of the row before, within ``by``; the first row's is compared with ``start``, where given."""
    place, whole = Window.partitionBy(*by).orderBy(*order), F.struct(*key) if len(key) > 1 else F.col(key[0])
    previous = F.lag(F.struct(whole.alias("k"))).over(place)["k"]
    if start is not None:
        previous = F.when(F.row_number().over(place) == 1, start).otherwise(previous)
    known = F.lag(F.lit(1)).over(place).isNotNull() | (start.isNotNull() if start is not None else F.lit(False))
    return df.withColumns({"_previous": previous, "_known": known}).where(~(F.col("_known") & whole.eqNullSafe(F.col("_previous")))).drop("_previous", "_known")


def carry_in(df: DataFrame, by: list[str], segment: str, order: list[str], values: list[str]) -> DataFrame:
    """(by, segment, _first, _value for each value): what a segment starts from, the last value that is not null before it in ``by``.

    _first is the order of the segment's first row. One small row for each segment: only these meet by ``by``.
    """
    # the last row as a whole is asked for, so that this reads the same columns as its caller and shares the shuffle
    ends = df.groupBy(*by, segment).agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v) for v in values], F.min(order[0]).alias("_first"), F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    return ends.where(F.col("_last").isNotNull()).select(*by, segment, "_first", *[F.last(v, ignorenulls=True).over(earlier).alias(f"_{v}") for v in values])


def whole_key(key: list[str]) -> Column:
    """Whether no part of the key is missing or empty."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    return F.coalesce(whole, F.lit(False))


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows that lack part of the key all stay, each under a key of its own. One pass over the input."""
    own = F.when(~whole_key(key), F.monotonically_increasing_id())
    return df.withColumn("_own", own).withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_own").orderBy(*order))).where("_n = 1").drop("_n", "_own")


def unseen(df: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key an existing ledger does not hold."""
    return df.join(ledger.select(*key).distinct(), key, "left_anti")


def session_bounds(events: DataFrame, by: str = "source_file") -> DataFrame:
    """(file, start, end): start from the last session_meta, else the earliest timestamp."""
    stated = F.coalesce(F.nullif(F.col("payload.timestamp"), F.lit("")), F.nullif(F.col("timestamp"), F.lit("")))
    meta = F.when((F.col("type") == "session_meta") & stated.isNotNull(), stated)
    return events.groupBy(by).agg(
        F.coalesce(F.max_by(meta, F.when(meta.isNotNull(), F.col("ord"))), F.min(F.nullif("timestamp", F.lit("")))).alias("started"), F.max(F.nullif("timestamp", F.lit(""))).alias("ended")
    )


def model_key(model: Column, effort: Column) -> Column:
    return F.when(effort.isNull(), model).otherwise(F.concat(model, F.lit(" ("), effort, F.lit(")")))


def base_model(key: Column) -> Column:
    """Without a last bracketed part."""
    return F.regexp_replace(key, r" \([^(]*\)$", "")
