"""Generic operators: hand-computed cases, properties, and the same result in any partitioning."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import labels
from tallyspark.functions.timebuckets import auto_interval, axis_limit, bucket_start, level, tick_step
from tallyspark.operators import breakdown, cost, filters, normalize, timeseries
from tallyspark.plans.ledger_view import ledger
from tallyspark.streaming import refresh

C = breakdown.COUNTERS


def at(text):
    return datetime.fromisoformat(text)


@pytest.mark.parametrize("ts,k,want", [
    ("2025-01-02T23:59:08", 7, "2025-01-02T23:55:00"), ("2025-01-02T10:05:00", 60, "2025-01-02T10:00:00"), ("2025-01-02T23:59:59", 2000, "2025-01-02T00:00:00"), ("2025-01-02T00:00:00", 1, "2025-01-02T00:00:00"),
])
def test_buckets(spark, ts, k, want):
    df = spark.createDataFrame([(at(ts),)], "t timestamp_ntz")
    assert df.select(bucket_start(F.col("t"), k).alias("b")).first().b == at(want)
    assert df.select(bucket_start(bucket_start(F.col("t"), k), k).alias("b")).first().b == at(want)


def test_buckets_follow_the_wall_clock(spark):
    df = spark.sql("SELECT timestamp '2025-11-02 15:05:00 UTC' AS t")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(bucket_start(F.col("t"), 60).cast("string").alias("b")).first().b == "2025-11-02 10:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def span(spark, start, end, own="2025-01-01T09:15:00", tokens=90):
    kind = "session_start timestamp_ntz, session_end timestamp_ntz, event_ts timestamp_ntz, " + ", ".join(f"{c} long" for c in C)
    return spark.createDataFrame([(start and at(start), end and at(end), own and at(own), tokens, 2, 0, None)], kind)


def test_spread(spark):
    rows = timeseries.spread(span(spark, "2025-01-01T10:05:00", "2025-01-01T12:10:00"), 60).orderBy("bucket").collect()
    assert [(r.bucket.hour, r.input_tokens, r.cache_read_tokens) for r in rows] == [(10, 30.0, 0.0), (11, 30.0, 0.0), (12, 30.0, 0.0)]
    assert [r.bucket.hour for r in timeseries.spread(span(spark, "2025-01-01T12:00:00", "2025-01-01T10:00:00"), 60).collect()] == [9]
    assert [r.bucket.hour for r in timeseries.spread(span(spark, None, None), 60).collect()] == [9]
    assert timeseries.spread(span(spark, None, None, None), 60).count() == 0


def test_spread_keeps_the_sum(spark, data):
    rows = ledger(spark, data).groupBy("user_id").agg(F.min("event_ts").alias("session_start"), F.max("event_ts").alias("session_end"), *breakdown.summed())
    for k in (7, 60, 1440):
        out = timeseries.spread_series(rows, k, [], own="session_start").agg(*[F.sum(c).alias(c) for c in C]).first()
        want = rows.agg(*[F.sum(c).alias(c) for c in C]).first()
        assert all(abs(out[c] - want[c]) < 1e-6 * max(1, want[c]) for c in C)


def test_gap_fill_keeps_the_sum_and_every_bucket(spark, data):
    rows = ledger(spark, data)
    series = timeseries.vendor_series(rows).where("vendor <> 'All'")
    as_of = rows.agg(F.max("event_ts").alias("t"))
    filled = timeseries.gap_filled(series, as_of, 40, 60)
    assert filled.agg(F.sum("tokens")).first()[0] == series.agg(F.sum("tokens")).first()[0]
    per = filled.groupBy("vendor").agg(F.count("*").alias("n"), F.countDistinct("bucket").alias("d")).collect()
    assert len({(r.n, r.d) for r in per}) == 1 and per[0].n == per[0].d == timeseries.time_grid(as_of, 40, 60).count()
    assert timeseries.gap_filled(series.limit(0), as_of, 2, 60).count() == 0


def test_last_days(spark):
    kind = "i int, event_ts timestamp, vendor string"
    t = at("2025-01-10T12:00:00")
    df = spark.createDataFrame([(0, t, "a"), (1, t - timedelta(days=3), "a"), (2, t - timedelta(days=3, seconds=1), "b"), (3, None, "a")], kind)
    ids = lambda d: sorted(r.i for r in d.collect())
    assert ids(filters.last_days(df, 3)) == [0, 1]
    assert ids(filters.last_days(df, 3, by="vendor")) == [0, 1, 2]
    assert ids(filters.last_days(df.where("i = 3"), 3)) == [3]
    assert ids(filters.last_days(df.limit(0), 3)) == []


def test_share_threshold(spark):
    groups = lambda a, b: filters.share_threshold(spark.createDataFrame([("A", a), ("B", b)], "k string, messages long")).count()
    assert groups(99, 1) == 2 and groups(199, 1) == 1


def test_carry_forward_and_repeats(spark):
    df = spark.createDataFrame([(1, i, v, k) for i, (v, k) in enumerate([(None, "a"), ("x", "a"), ("", "b"), (None, "b"), ("y", "a"), (None, None), (None, None)])], "f int, ord int, v string, k string")
    out = normalize.carry_forward(df, ["f"], ["ord"], {"m": F.col("v")}).orderBy("ord").collect()
    assert [r.m for r in out] == ["unknown", "x", "x", "x", "y", "y", "y"]
    once = normalize.drop_repeats(df, ["f"], ["ord"], ["k"])
    assert [r.ord for r in once.orderBy("ord").collect()] == [0, 2, 4, 5]
    assert normalize.drop_repeats(once, ["f"], ["ord"], ["k"]).count() == 4


@pytest.mark.parametrize("parts", [1, 8])
def test_first_seen(spark, parts):
    df = spark.createDataFrame([("a", "r", 3), ("a", "r", 1), (None, "r", 2), (None, "r", 4), ("", "r", 5), ("a", "q", 6)], "m string, r string, ord int").repartition(parts)
    assert sorted(x.ord for x in normalize.first_seen(df, ["m", "r"], ["ord"]).collect()) == [1, 2, 4, 5, 6]


def test_axis(spark):
    df = spark.createDataFrame([(5001,), (4999,), (0,), (7_000_001,), (3,), (5_000_000_001,)], "v long").select(axis_limit(F.col("v")).alias("u"), axis_limit(F.col("v"), False).alias("d"))
    assert [tuple(r) for r in df.collect()] == [(10_000, 5000), (5000, 4995), (0, 0), (10_000_000, 5_000_000), (5, 0), (10_000_000_000, 5_000_000_000)]
    assert spark.range(1).select(level(F.lit(50), F.lit(0), F.lit(100), 11).alias("l"), level(F.lit(1), F.lit(1), F.lit(1), 11).alias("z")).first() == (5, 0)
    assert auto_interval(3, 100) == 60 and auto_interval(3, 1000) == 60 and auto_interval(0.05, 100) == 1 and auto_interval(4000, 100) == 1440
    assert tick_step(3 * 1440) == 240 and tick_step(10) == 15


def test_stride(spark):
    series = spark.range(1100).select((F.lit(at("2025-01-01T00:00:00")) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("bucket"), F.col("id"))
    assert [r.id for r in timeseries.every_nth(series).orderBy("id").collect()] == list(range(0, 1100, 2))
    assert timeseries.every_nth(series.limit(400)).count() == 400


def prices(spark):
    p = spark.createDataFrame([("Claude", "a", *[Decimal(x) for x in ("1", "2", "3", "4")])], "vendor string, model string, input decimal(12,6), output decimal(12,6), cache_input decimal(12,6), cache_output decimal(12,6)")
    d = spark.createDataFrame([("Claude", *[Decimal(x) for x in ("10", "20", "30", "40", "20")]), ("Codex", *[Decimal(x) for x in ("1", "1", "1", "1", "20")])], "vendor string, input decimal(12,6), output decimal(12,6), cache_input decimal(12,6), cache_output decimal(12,6), subscription_price decimal(12,2)")
    return p, d


def test_costs(spark):
    rows = spark.createDataFrame([("Claude", "a", "cache_creation", 10**6, 10**6, 10**6, 10**6), ("Claude", "z", "cache_creation", 10**6, 0, 0, 0), ("Codex", "q", "reasoning", 0, 0, 5 * 10**6, 0)], f"vendor string, model string, extra_kind string, {', '.join(f'{c} long' for c in C)}")
    by = {(r.vendor, r.model): r for r in cost.cost_by_type(rows, *prices(spark)).collect()}
    assert (by["Claude", "a"].input_cost, by["Claude", "a"].output_cost, by["Claude", "a"].extra_cost, by["Claude", "a"].cache_read_cost) == (1.0, 2.0, 4.0, 3.0)
    assert by["Claude", "z"].total_cost == 10.0 and by["Codex", "q"].total_cost == 5.0
    assert {r.vendor: r.api_cost for r in cost.api_cost(rows, *prices(spark)).collect()} == {"Claude": 20.0, "Codex": 5.0}
    projected = {r.vendor: r for r in cost.projection(rows, *prices(spark), 3).collect()}
    assert round(projected["Claude"].daily_cost, 2) == 6.67 and round(projected["Claude"].saving, 6) == 180.0
    assert cost.projection(rows, *prices(spark), 0).where("daily_cost = 0 AND cost_per_mtok = 0").count() == 2
    empty = cost.weighted_cost(rows.limit(0), *prices(spark), 3).first()
    assert tuple(empty) == (0.0, 0.0, 0)
    shares = cost.cost_share(cost.cost_by_type(rows, *prices(spark))).agg(F.sum("percent")).first()[0]
    assert abs(shares - 100) < 1e-9


def test_labels(spark):
    cases = [(999, "999"), (1234, "1.23K"), (12_345, "12.3K"), (123_456, "123K"), (1_234_567, "1.23M"), (2_500_000_000, "2.50B")]
    df = spark.createDataFrame(cases, "n long, w string").select("w", labels.compact(F.col("n")).alias("g"))
    assert [r.g for r in df.collect()] == [w for _, w in cases]
    axis = [(5, "    5"), (1500, "1.5 K"), (25_000, " 25 K"), (250_000, "250 K"), (2_000_000, "2.0 M"), (35_000_000, " 35 M")]
    assert [r.g for r in spark.createDataFrame(axis, "n long, w string").select(labels.axis_label(F.col("n")).alias("g")).collect()] == [w for _, w in axis]
    money = [(0.15, "$0.15"), (0.007, "$0.007"), (0.0003, "$0.0003"), (0.0, "$0.00"), (12.0, "$12.00")]
    assert [r.g for r in spark.createDataFrame(money, "n double, w string").select(labels.price_label(F.col("n")).alias("g")).collect()] == [w for _, w in money]
    one = spark.range(1).select(labels.with_percent(F.lit(1234), F.lit(2468)).alias("p"), labels.short_model(F.lit("a-very-long-model"), F.lit("xhigh")).alias("s"), labels.thousands(F.lit(1234567)).alias("t")).first()
    assert tuple(one) == ("1,234(50.0%)", "a-very-lon(XH)", "1,234,567")


def test_results_do_not_depend_on_partitions(spark, data):
    rows = ledger(spark, data)
    for f in (breakdown.model_breakdown, timeseries.vendor_series, lambda d: cost.api_cost(d, *prices(spark))):
        seen = {tuple(sorted(map(str, f(rows.repartition(n)).collect()))) for n in (1, 8)}
        assert len(seen) == 1


def test_stream_equals_batch(spark, data, tmp_path):
    rows = ledger(spark, data).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    for i in range(3):
        rows.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = refresh.read_landed(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " "), files_per_batch=1)
    q = refresh.keep_current(refresh.series_stream(stream, 60, late="60 days"), refresh.append_updates(str(tmp_path / "out")), str(tmp_path / "state"))
    q.awaitTermination()
    got = refresh.latest_of(str(tmp_path / "out"), spark, ["bucket", "vendor"], "tokens").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "vendor", "tokens")
    want = timeseries.vendor_series(rows).where("vendor <> 'All'").select("bucket", "vendor", "tokens")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_first_seen_stream(spark, tmp_path):
    kind = "m string, r string, ts timestamp"
    t = at("2025-01-01T00:00:00")
    for batch in ([("a", "r", t), ("a", "r", t), (None, "r", t)], [("a", "r", t + timedelta(minutes=1)), (None, "r", t), ("b", "r", t), ("", "r", t), ("", "r", t)]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = refresh.first_seen_stream(refresh.read_landed(spark, str(tmp_path / "in"), kind, files_per_batch=1), ["m", "r"], "ts", "1 hour")
    q = rows.writeStream.outputMode("append").format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(str(x.m) for x in spark.table("first_seen").collect()) == ["", "", "None", "None", "a", "b"]


def test_spread_stream_equals_batch(spark, data, tmp_path):
    rows = ledger(spark, data).groupBy("model_key", "user_id", F.to_date("event_ts").alias("d")).agg(F.min("event_ts").alias("event_ts"), F.max("event_ts").alias("session_end"), *breakdown.summed())
    rows = rows.select("model_key", F.col("event_ts").cast("timestamp").alias("event_ts"), F.col("event_ts").cast("timestamp").alias("session_start"), F.col("session_end").cast("timestamp").alias("session_end"), *C)
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = refresh.read_landed(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " "), files_per_batch=1)
    ends = refresh.spread_stream(stream, 90, late="60 days")
    refresh.keep_current(ends, refresh.merge_updates(str(tmp_path / "out"), ["bucket", "model_key", "n", "phase"]), str(tmp_path / "state")).awaitTermination()
    now = refresh.spread_now(refresh.current(str(tmp_path / "out"), spark, ends.schema), 90)
    got = now.select("bucket", "model_key", F.round("input_tokens", 6).alias("n"))
    want = timeseries.spread_series(rows, 90, ["model_key"]).select("bucket", "model_key", F.round("input_tokens", 6).alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
