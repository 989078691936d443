"""The stored ledger: pruned reads, refresh in proportion to change, rollups; lines and event logs of large files."""

import json
import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import filters, timeseries
from tallyspark.operators.breakdown import COUNTERS
from tallyspark.sources import logs, store
from tallyspark.sources.schemas import LEDGER_COLUMNS


def message(day, request, ident, n=1, hour=10):
    usage = {"input_tokens": n, "output_tokens": 2, "cache_creation_input_tokens": 3, "cache_read_input_tokens": 4}
    return json.dumps({"timestamp": f"2025-01-{day:02d}T{hour:02d}:00:00Z" if day else None, "requestId": request, "message": {"id": ident, "model": "m", "usage": usage}})


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    os.utime(path, (time.time(), time.time() + write.n))
    write.n += 2  # times in whole seconds must differ


write.n = 0


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*LEDGER_COLUMNS).collect()), key=repr)


def full(spark, root):
    return rows_of(logs.usage_log(logs.read_lines(spark, [str(root)])))


def part_names(path):
    found = {}
    for f in Path(path, "ledger").rglob("part-*.parquet"):
        found.setdefault(f.parent.name, set()).add(f.name)
    return found


def test_refresh_touches_what_changed(spark, tmp_path):
    root = tmp_path / "projects"
    held = store.Store(spark, str(tmp_path / "store"))

    def refresh(want_parsed):
        days, parsed = held.refresh("usage", [str(root)], "*.jsonl", logs.usage_rows)
        assert rows_of(held.rows()) == full(spark, root) and parsed == want_parsed
        return {str(d) for _, d in days}

    write(root / "a.jsonl", [message(1, "r", "x"), message(2, "r", "y", 5), message(3, "r", "z"), message(None, "r", "undated"), message(4, None, "keyless")])
    write(root / "b.jsonl", [message(2, "r", "y", 9), message(5, "r", "w"), message(5, "r", "w")])
    assert len(refresh(8)) == 6
    before = part_names(tmp_path / "store")
    assert refresh(0) == set() and part_names(tmp_path / "store") == before

    # growth: the new lines alone are parsed, and their dates and no others are written
    write(root / "b.jsonl", [message(2, "r", "y", 9), message(5, "r", "w"), message(5, "r", "w"), message(6, "r", "x"), message(6, "r", "new")])
    assert refresh(2) == {"2025-01-06"}
    after = part_names(tmp_path / "store")
    assert all(after[d] == before[d] for d in before)

    # a new file that comes first takes over a message: the date of the row that ceases to count is written too
    write(root / "0.jsonl", [message(7, "r", "z", 7)])
    assert refresh(1) == {"2025-01-03", "2025-01-07"}
    now = part_names(tmp_path / "store")
    assert all(now[d] == after[d] for d in after if d != "event_date=2025-01-03")

    # a changed line before the end: the whole file is parsed anew
    write(root / "b.jsonl", [message(2, "r", "y", 8), message(5, "r", "w"), message(5, "r", "w"), message(6, "r", "x"), message(6, "r", "new"), message(8, "r", "last")])
    assert "2025-01-08" in refresh(6)

    # deletion: what it hid comes back, an emptied date has no folder
    (root / "a.jsonl").unlink()
    refresh(0)
    assert "event_date=2025-01-04" not in part_names(tmp_path / "store")
    (root / "b.jsonl").unlink()
    (root / "0.jsonl").unlink()
    root.mkdir(exist_ok=True)
    refresh(0)
    assert held.rows().isEmpty() and part_names(tmp_path / "store") == {}


@pytest.mark.parametrize("at", ["_replace", "_write_parts", "second note"])
def test_an_interrupted_refresh_is_made_good(spark, tmp_path, monkeypatch, at):
    root = tmp_path / "projects"
    held = store.Store(spark, str(tmp_path / "store"))
    write(root / "a.jsonl", [message(1, "r", "x"), message(2, "r", "y")])
    write(root / "b.jsonl", [message(2, "r", "y", 9), message(3, "r", "q")])
    held.refresh("usage", [str(root)], "*.jsonl", logs.usage_rows)
    write(root / "a.jsonl", [message(1, "r", "x"), message(2, "r", "y"), message(9, "r", "q")])
    (root / "b.jsonl").unlink()

    class Stop(Exception):
        pass

    with monkeypatch.context() as m:
        calls = []

        def failing(real, allowed):
            def f(*a, **k):
                calls.append(1)
                if len(calls) > allowed:
                    raise Stop
                return real(*a, **k)

            return f

        if at == "_replace":
            m.setattr(store.Store, "_replace", failing(store.Store._replace, 0))
        elif at == "_write_parts":
            m.setattr(store, "_write_parts", failing(store._write_parts, 1))
        else:
            m.setattr(store.Store, "_note", failing(store.Store._note, 1))
        with pytest.raises(Stop):
            held.refresh("usage", [str(root)], "*.jsonl", logs.usage_rows)
    # meanwhile the file loses the line that the interrupted refresh may have written
    write(root / "a.jsonl", [message(1, "r", "x"), message(2, "r", "y"), message(10, "r", "other")])
    held.refresh("usage", [str(root)], "*.jsonl", logs.usage_rows)
    assert rows_of(held.rows()) == full(spark, root)


def test_random_refreshes_equal_full_reads(spark, tmp_path):
    rng, root = random.Random(2), tmp_path / "projects"
    held = store.Store(spark, str(tmp_path / "store"))
    files = {}
    for _ in range(4):
        for name in "abc":
            old = files.get(name, [])
            files[name] = rng.choice([old, old + [message(rng.randint(1, 4), "r", f"k{rng.randint(0, 9)}", rng.randint(1, 99), rng.randint(0, 23)) for _ in range(4)], old[1:], []])
            if not files[name]:
                (root / f"{name}.jsonl").unlink(missing_ok=True)
            elif files[name] is not old:
                write(root / f"{name}.jsonl", files[name])
        root.mkdir(exist_ok=True)
        days, _ = held.refresh("usage", [str(root)], "*.jsonl", logs.usage_rows)
        held.fold(days)
        assert rows_of(held.rows()) == full(spark, root)
        want = timeseries.bucketed(held.rows(), 60).groupBy("bucket", "vendor").agg(*[F.sum(c).alias(c) for c in COUNTERS])
        assert sorted(map(tuple, held.series(60).collect())) == sorted(map(tuple, want.collect()))


def test_reads_of_the_last_days_prune(spark, tmp_path):
    shape = "vendor string, event_ts string, ord int"
    rows = [("A", f"2025-01-{d:02d} 0{d % 10}:30:00", d) for d in range(1, 28)] + [("B", "2025-01-03 05:00:00", 50), ("B", "2025-01-01 05:00:00", 51), ("B", None, 52), ("C", None, 53)]
    df = spark.createDataFrame(rows, shape).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], store.LEDGER).schema}
    df = df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast(kinds[c])).alias(c) for c in LEDGER_COLUMNS])
    folder = str(tmp_path / "ledger")
    logs.write_ledger(df, folder)
    for args in ({}, {"by_vendor": True}, {"vendor": "A"}, {"vendor": "B"}, {"vendor": "C"}):
        got = store.stored_last_days(spark, folder, 2.5, **args)
        source = df if args.get("vendor") is None else df.where(F.col("vendor") == args["vendor"])
        want = filters.last_days(source, 2.5, by="vendor" if args.get("by_vendor") else None)
        assert sorted(r.ord for r in got.collect()) == sorted(r.ord for r in want.collect())
    got = store.stored_last_days(spark, folder, 2)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(event_date") >= 2 and "PartitionFilters: []" not in plan
    assert store.stored_last_days(spark, str(tmp_path / "nowhere"), 2).isEmpty()


def test_split_files_are_numbered_without_a_task_per_file(spark, tmp_path):
    """Both readers give the same rows, for files of many splits beside small ones; only counts of splits are put in order by file."""
    for name, n in (("big", 30_000), ("mid", 700), ("one", 1)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name} line {i}\r\n" if i % 7 else "  \n" for i in range(n)) + "end")
    (tmp_path / "empty.jsonl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        split = logs.read_lines(spark, [str(tmp_path)], whole=False)
        plan = split._jdf.queryExecution().optimizedPlan().toString()
        whole = logs.read_lines(spark, [str(tmp_path)], whole=True)
        assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    window = plan[plan.index("Window ") :].split("\n")
    assert "row_number" not in plan and "Aggregate" in window[1] + window[2]


def event(i, rng):
    stamp = f"2025-01-01T{i // 3600 % 24:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z"
    if rng.random() < 0.01:
        return {"type": "turn_context", "timestamp": stamp, "payload": {"model": rng.choice(["x", "y", ""]), "effort": rng.choice(["high", None])}}
    n = rng.randint(0, 2)
    return {"type": "event_msg", "timestamp": stamp, "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n, "cached_input_tokens": 0, "output_tokens": 1, "reasoning_output_tokens": 0}}}}


@pytest.mark.parametrize("segment", [1, 7, 1000])
def test_segments_equal_one_window(spark, segment):
    rng = random.Random(segment)
    lines = [(f"f{k}", 0, i, json.dumps(event(i, rng))) for k, n in enumerate((1, 40, 900)) for i in range(n)]
    df = spark.createDataFrame(lines, "source_file string, root_rank int, ord int, line string")
    assert rows_of(logs.event_log(df, segment)) == rows_of(logs.event_log(df, 10**6))


def test_a_session_of_a_million_lines_is_many_tasks(spark):
    line = F.when(F.col("id") % 1000 == 0, F.format_string('{"type": "turn_context", "payload": {"model": "m%d"}}', F.floor(F.col("id") / 300_000)))
    line = line.otherwise(F.format_string('{"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": %d}}}}', F.floor(F.col("id") / 3)))
    df = spark.range(1_000_000).select(F.lit("f").alias("source_file"), F.lit(0).alias("root_rank"), F.col("id").cast("int").alias("ord"), line.alias("line"))
    rows = logs.event_log(df, 50_000)
    spread = rows.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(spread) >= 4 and max(r["count"] for r in spread) < 200_000
    counts = rows.groupBy("model").count().collect()
    assert {r.model for r in counts} == {"m0", "m1", "m2", "m3"}
    steps = 0  # by hand: a count stays where it differs from the one before it
    last = None
    for i in range(1_000_000):
        if i % 1000 and i // 3 != last:
            steps, last = steps + 1, i // 3
    assert sum(r["count"] for r in counts) == steps


def test_the_events_are_parsed_and_dealt_once(spark):
    df = spark.createDataFrame([("f", 0, i, json.dumps(event(i, random.Random(i)))) for i in range(50)], "source_file string, root_rank int, ord int, line string")
    rows = logs.event_log(df, 10)
    rows.collect()
    final = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 1 and final.count("explode(array(from_json") == 1


def test_sweep_makes_no_row_for_each_bucket(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), *(f"2025-01-{rng.randint(1, 9):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00" for _ in range(3)), *[rng.randint(0, 99) for _ in COUNTERS]) for _ in range(300)]
    rows += [("a", None, None, "2025-01-01 01:00:00", 1, 1, 1, 1), ("a", None, None, None, 1, 1, 1, 1), ("b", "2025-01-01 00:00:00", "2025-01-01 00:00:00", None, 1, None, 1, 1)]
    df = spark.createDataFrame(rows, "key string, session_start string, session_end string, event_ts string, " + ", ".join(f"{c} long" for c in COUNTERS))
    df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end", "event_ts")})
    for minutes in (7, 60, 1440):
        rounded = [F.round(c, 6).alias(c) for c in COUNTERS]
        want = timeseries.spread(df, minutes).groupBy("bucket", "key").agg(*[F.sum(c).alias(c) for c in COUNTERS]).select("bucket", "key", *rounded)
        got = timeseries.spread_series(df, minutes, ["key"]).select("bucket", "key", *rounded)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert timeseries.span_ends(df, 1, ["key"]).count() == 2 * (len(rows) - 1)
    assert timeseries.spread_series(df.limit(0), 7, ["key"]).isEmpty()


def test_ticks_are_merged_without_a_join(spark):
    rng = random.Random(9)
    points = sorted({f"2025-01-{rng.randint(1, 5):02d} {rng.randint(0, 23):02d}:{rng.choice([0, 15, 30, 45]):02d}:00" for _ in range(90)})
    df = spark.createDataFrame([(p,) for p in points], "bucket string").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    ticks = timeseries.axis_ticks(df)
    assert "Join" not in ticks._jdf.queryExecution().executedPlan().toString()
    got = ticks.collect()
    at = [r.bucket for r in df.collect()]
    assert len(got) > 5 and len({r.bucket for r in got}) == len(got)
    for r in got:
        assert r.bucket == min(at, key=lambda p: (abs((p - r.tick).total_seconds()), -p.timestamp()))
