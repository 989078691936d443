"""Regular series: buckets, even spreading, grids, gap filling, daily totals, axes and ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timebuckets import TICK_STEPS, axis_limit, before, bucket_start, level, minutes_between, step, wall_clock
from .breakdown import COUNTERS, summed


def _total(counters: list[str] = COUNTERS) -> Column:
    return sum((F.coalesce(c, F.lit(0)) for c in counters), F.lit(0).cast("long"))


def bucketed(df: DataFrame, minutes: int, ts: str = "event_ts", name: str = "bucket") -> DataFrame:
    """Rows with a time, and the bucket it falls into."""
    return df.where(F.col(ts).isNotNull()).withColumn(name, bucket_start(F.col(ts), minutes))


def tokens_by_model(ledger: DataFrame, hours: int = 1) -> DataFrame:
    """(bucket, model, tokens): input and output."""
    return bucketed(ledger, 60 * hours).groupBy("bucket", "model").agg(F.sum(_total(["input_tokens", "output_tokens"])).alias("tokens"))


def all_tokens(ledger: DataFrame, hours: int = 1) -> DataFrame:
    """(bucket, tokens): the four counters together."""
    return bucketed(ledger, 60 * hours).groupBy("bucket").agg(F.sum(_total()).alias("tokens"))


def token_parts(ledger: DataFrame, hours: int = 1) -> DataFrame:
    """(bucket, the four counters)."""
    return bucketed(ledger, 60 * hours).groupBy("bucket").agg(*summed())


def _spanned(df: DataFrame, minutes: int, start: str, end: str, own: str) -> DataFrame:
    """Rows with their first and last bucket, _a and _b, and the number of buckets from one to the other, _n."""
    a, b, o = (bucket_start(F.col(c), minutes) for c in (start, end, own))
    good = F.coalesce(wall_clock(F.col(end)) >= wall_clock(F.col(start)), F.lit(False))
    rows = df.withColumns({"_a": F.when(good, a).otherwise(o), "_b": F.when(good, b).otherwise(o)}).where(F.col("_a").isNotNull())
    return rows.withColumn("_n", F.floor(minutes_between(F.col("_a"), F.col("_b")) / minutes) + 1)


def spread(df: DataFrame, minutes: int, start: str = "session_start", end: str = "session_end", own: str = "event_ts", counters: list[str] = COUNTERS) -> DataFrame:
    """Each row once per bucket from its start to its end, with an even part of each counter.

    A row whose span is missing or runs backwards goes to the bucket of its own time; rows
    without any time are left out. For rows one by one; a series comes cheaper from ``spread_series``.
    """
    parts = {c: F.coalesce(c, F.lit(0)).cast("double") / F.col("_n") for c in counters}
    exploded = _spanned(df, minutes, start, end, own).withColumn("bucket", F.explode(F.sequence("_a", "_b", step(minutes))))
    return exploded.withColumns(parts).drop("_a", "_b", "_n")


def span_ends(df: DataFrame, minutes: int, key: list[str], start: str = "session_start", end: str = "session_end", own: str = "event_ts", counters: list[str] = COUNTERS) -> DataFrame:
    """(key, n, phase, bucket, counters, rows): two rows for each row of ``df``, whatever its span: what comes in at its first bucket and goes out after its last.

    n is how many buckets share the row; phase is where they lie on the step, as steps that do not divide a day shift.
    """
    rows = _spanned(df, minutes, start, end, own)
    after = F.col("_a") + F.make_dt_interval(mins=F.col("_n").cast("int") * minutes)
    phase = F.pmod(F.floor(F.unix_micros(F.col("_a").cast("timestamp")) / 60_000_000), F.lit(minutes))
    ends = F.explode(F.array(F.struct(F.col("_a").alias("b"), F.lit(1).alias("s")), F.struct(after.alias("b"), F.lit(-1).alias("s"))))
    each = rows.select(*key, F.col("_n").cast("long").alias("n"), phase.cast("long").alias("phase"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counters], ends.alias("_e"))
    return each.select(*key, "n", "phase", F.col("_e.b").alias("bucket"), *[(F.col(c) * F.col("_e.s")).alias(c) for c in counters], F.col("_e.s").cast("long").alias("rows"))


def sweep(ends: DataFrame, minutes: int, key: list[str], counters: list[str] = COUNTERS) -> DataFrame:
    """(bucket, key, counters): the series whose ``span_ends``, summed by bucket, these are.

    Whole numbers run along the buckets for each n, so that nothing is left over where all spans have ended; each n then divides once.
    """
    run = Window.partitionBy(*key, "n", "phase").orderBy("bucket")
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    level = ends.select(*key, "n", "phase", "bucket", F.lead("bucket").over(run).alias("_next"), *[F.sum(c).over(so_far).alias(c) for c in [*counters, "rows"]]).where("rows > 0")
    held = level.withColumn("bucket", F.explode(F.sequence("bucket", F.col("_next") - step(minutes), step(minutes))))
    return held.groupBy("bucket", *key).agg(*[F.sum(F.col(c) / F.col("n")).alias(c) for c in counters])


def spread_series(df: DataFrame, minutes: int, key: list[str], counters: list[str] = COUNTERS, **names: str) -> DataFrame:
    """(bucket, key, counters): rows spread evenly over their spans, summed; no row is made for each bucket of a row's span."""
    ends = span_ends(df, minutes, key, counters=counters, **names)
    return sweep(ends.groupBy(*key, "n", "phase", "bucket").agg(*[F.sum(c).alias(c) for c in [*counters, "rows"]]), minutes, key, counters)


def vendor_series(ledger: DataFrame, minutes: int = 60) -> DataFrame:
    """(bucket, vendor, tokens) and, as vendor 'All', each bucket's sum."""
    rows = bucketed(ledger, minutes)
    sets = rows.groupingSets([["bucket", "vendor"], ["bucket"]], "bucket", "vendor")
    out = sets.agg(F.grouping("vendor").alias("_all"), F.sum(_total()).alias("tokens"))
    return out.select("bucket", F.when(F.col("_all") == 1, "All").otherwise(F.col("vendor")).alias("vendor"), "tokens")


def time_grid(as_of: DataFrame, days: float, minutes: int) -> DataFrame:
    """(bucket): the regular grid of the last ``days``, up to the one time that ``as_of`` holds."""
    newest = F.col(as_of.columns[0])
    first = bucket_start(before(wall_clock(newest).cast("timestamp"), days), minutes)
    return as_of.where(newest.isNotNull()).select(F.explode(F.sequence(first, wall_clock(newest), step(minutes))).alias("bucket"))


def gap_filled(series: DataFrame, as_of: DataFrame, days: float, minutes: int, key: str = "vendor", value: str = "tokens") -> DataFrame:
    """A row for every grid bucket and every key that occurs; 0 where the series has none."""
    newest = F.col(as_of.columns[0])
    first = bucket_start(before(wall_clock(newest).cast("timestamp"), days), minutes)
    buckets = as_of.where(newest.isNotNull()).select(F.sequence(first, wall_clock(newest), step(minutes)).alias("b")).scalar()
    grid = series.select(key).distinct().select(key, F.explode(buckets).alias("bucket"))
    return grid.join(series.select(key, "bucket", value), [key, "bucket"], "left").select("bucket", key, F.coalesce(value, F.lit(0)).alias(value))


def every_nth(series: DataFrame, most: int = 500, key: str | None = None, bucket: str = "bucket") -> DataFrame:
    """At most about ``most`` buckets: every n-th from the oldest, where n is their number over ``most``. Drops what lies between."""
    place = F.dense_rank().over(Window.partitionBy(*([key] if key else [])).orderBy(bucket)) - 1
    count = F.max(F.col("_i")).over(Window.partitionBy(*([key] if key else []))) + 1
    stride = F.greatest(F.floor(F.col("_n") / most), F.lit(1))
    thinned = series.withColumn("_i", place).withColumn("_n", count)
    return thinned.where((F.col("_n") <= most) | (F.col("_i") % stride == 0)).drop("_i", "_n")


def rebucketed(series: DataFrame, minutes: int, key: str, value: str) -> DataFrame:
    """The same sums on a coarser step."""
    return series.withColumn("bucket", bucket_start(F.col("bucket"), minutes)).groupBy("bucket", key).agg(F.sum(value).alias(value))


def daily_totals(series: DataFrame, value: str = "tokens", by: list[str] = []) -> DataFrame:  # noqa: B006
    """(day, weekday, sum) of a series."""
    days = series.groupBy(F.to_date("bucket").alias("day"), *by).agg(F.sum(value).alias(value))
    return days.withColumn("weekday", F.date_format("day", "E"))


def extent(series: DataFrame, value: str = "tokens") -> DataFrame:
    """One row: smallest and largest value, and the axis limits around them."""
    out = series.agg(F.coalesce(F.min(value), F.lit(0)).alias("low"), F.coalesce(F.max(value), F.lit(1)).alias("high"))
    high = axis_limit(F.col("high"))
    low = axis_limit(F.col("low"), False)
    return out.withColumns({"axis_low": low, "axis_high": F.when(high == low, low + 5000).otherwise(high), "axis_high_from_zero": F.when(high == 0, 5000).otherwise(high)})


def chart_frame(series: DataFrame, key: str = "vendor", value: str = "tokens", levels: int = 20) -> DataFrame:
    """What a line chart of an aggregated series draws: level, direction from the bucket before, and day boundaries."""
    top = series.agg(axis_limit(F.max(value)).alias("limit"))
    high = top.select(F.when(F.col("limit") == 0, 5000).otherwise(F.col("limit"))).scalar()
    lined = Window.partitionBy(key).orderBy("bucket")
    out = series.withColumn("level", level(F.col(value), F.lit(0), high, levels)).withColumn("_before", F.coalesce(F.lag("level").over(lined), F.col("level")))
    direction = F.when(F.col("level") > F.col("_before"), "up").when(F.col("level") < F.col("_before"), "down").otherwise("flat")
    return out.select("bucket", key, value, "level", direction.alias("direction"), ((F.hour("bucket") == 0) & (F.minute("bucket") == 0)).alias("day_boundary"))


def stacked(parts: DataFrame, counters: list[str] = COUNTERS) -> DataFrame:
    """Running sums of the counters, in their order, as stack_1, stack_2 and so on."""
    order = ["input_tokens", "output_tokens", "extra_tokens", "cache_read_tokens"] if counters == COUNTERS else counters
    return parts.withColumns({f"stack_{i + 1}": sum((F.col(c) for c in order[1 : i + 1]), F.col(order[0])) for i in range(len(order))})


def axis_ticks(points: DataFrame, bucket: str = "bucket") -> DataFrame:
    """(tick, bucket): ticks at steps from midnight, each with the nearest point, the later of two; one tick per point.

    The step is the one nearest to 5 % of the span, the smaller of two. Ticks and points are merged in order,
    day by day, each point in its own day and the neighbouring ones; the last point before a tick and the first after it are compared.
    """
    ends = points.agg(F.min(bucket).alias("first"), F.max(bucket).alias("last")).where(F.col("first").isNotNull())
    span = minutes_between(F.col("first"), F.col("last"))
    steps = F.array([F.struct(F.abs(F.lit(float(s)) - span * 0.05).alias("d"), F.lit(s).alias("s")) for s in TICK_STEPS])
    ends = ends.withColumn("_step", F.array_min(steps)["s"])
    day = F.date_trunc("DAY", F.col("first")).cast("timestamp_ntz")
    skipped = F.ceil((F.hour("first") * 60 + F.minute("first")) / F.col("_step")).cast("int") * F.col("_step")
    ticks = ends.withColumn("_tick0", day + F.make_dt_interval(mins=skipped)).where(F.col("_tick0") <= F.col("last"))
    ticks = ticks.select(F.explode(F.sequence("_tick0", "last", F.make_dt_interval(mins=F.col("_step")))).alias("tick"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slot = F.floor(F.col("at") / 86_400_000_000)
    marks = ticks.select(micros("tick").alias("at"), "tick", F.lit(None).cast("timestamp_ntz").alias("point")).withColumn("slot", slot)
    known = points.where(F.col(bucket).isNotNull()).select(wall_clock(F.col(bucket)).alias("point")).distinct().select(micros("point").alias("at"), F.lit(None).cast("timestamp_ntz").alias("tick"), "point")
    merged = marks.unionByName(known.select("*", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot")))
    after_points, so_far = F.col("tick").isNotNull(), (Window.unboundedPreceding, 0)
    earlier = F.last("point", ignorenulls=True).over(Window.partitionBy("slot").orderBy("at", after_points).rowsBetween(*so_far))
    later = F.last("point", ignorenulls=True).over(Window.partitionBy("slot").orderBy(F.desc("at"), after_points).rowsBetween(*so_far))
    met = merged.select("tick", "at", earlier.alias("_e"), later.alias("_l")).where(F.col("tick").isNotNull())
    nearer = F.coalesce(micros("_l") - F.col("at") <= F.col("at") - micros("_e"), F.col("_e").isNull())
    best = met.select("tick", F.when(nearer, F.col("_l")).otherwise(F.col("_e")).alias("bucket")).where(F.col("bucket").isNotNull())
    return best.groupBy("bucket").agg(F.min("tick").alias("tick")).select("tick", "bucket")
