"""Registered queries over logs on disk, stored ledgers and streams, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timebuckets import auto_interval
from ..operators import breakdown, timeseries
from ..sources import logs, scratch
from ..sources.schemas import LEDGER_COLUMNS
from ..sources.store import Store, read_stored, stored_last_days
from ..streaming import refresh
from .catalog import _ALL, _COUNTER_NAMES, _SPREAD, STREAM_SCHEMA, _bucket, _last, _streamable, _sums, query
from .ledger_view import event_lines, ledger, log_lines, session_docs, stamp, usage_lines

#: Sessions, and so log files, that the lines of these queries are dealt into; each grows with the table.
LOGS = 16


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def _as_ledger(rows: DataFrame) -> DataFrame:
    """The ledger view in the columns of a stored ledger; the place in the file is the event."""
    now = F.col("event_ts").cast("timestamp")
    given = {"source_root": F.lit("0"), "source_file": F.concat(F.lit("/logs/"), F.col("user_id").cast("string")), "ord": F.col("event_id").cast("int"), "event_ts": now, "session_start": now, "session_end": now}
    return rows.withColumns(given | {c: F.lit(None).cast("string") for c in ("ts_raw", "message_id", "request_id")}).select(*LEDGER_COLUMNS)


@query(f"SELECT CAST(event_id AS INTEGER) AS ord, vendor, model_key, event_ts, {_COUNTER_NAMES} FROM ledger WHERE {_last(3)}")
def stored_days_pruned(spark, sf_dir):
    """The ledger is written by vendor and date; of it only the folders of the last three days are read."""
    folder = scratch.shared_folder(spark, "ledger")
    logs.write_ledger(_as_ledger(ledger(spark, sf_dir)), folder)
    return _ntz(stored_last_days(spark, folder, 3), "event_ts").select("ord", "vendor", "model_key", "event_ts", *breakdown.COUNTERS)


@query("SELECT CAST(event_id AS INTEGER) AS ord, vendor, event_ts FROM ledger JOIN (SELECT vendor, max(event_ts) AS newest FROM ledger GROUP BY vendor) USING (vendor) WHERE event_ts >= newest - to_hours(48)")
def stored_days_by_vendor(spark, sf_dir):
    folder = scratch.shared_folder(spark, "ledger")
    logs.write_ledger(_as_ledger(ledger(spark, sf_dir)), folder)
    return _ntz(stored_last_days(spark, folder, 2, by_vendor=True), "event_ts").select("ord", "vendor", "event_ts")


def _dealt(lines: DataFrame) -> DataFrame:
    """(log, ord, line): lines of all users dealt into a few logs."""
    return lines.select(F.format_string("%02d", F.substring_index("source_file", "/", -1).cast("long") % LOGS).alias("log"), "ord", "line")


def _land(spark: SparkSession, lines: DataFrame, target: str) -> None:
    """Write one file for each log, its lines in order, in the place of what was there."""
    fresh = scratch.shared_folder(spark, "fresh")
    lines.repartition(LOGS, "log").sortWithinPartitions("log", "ord").select("log", "line").write.partitionBy("log").text(fresh, compression="none")
    for part in scratch.names(spark, f"{fresh}/log=*/part-*"):  # at most one for each log
        scratch.move(spark, part, f"{target}/log-{part.split('/log=')[1].split('/')[0]}.jsonl")


def _grown(spark: SparkSession, sf_dir: str, steps: int, fold: bool = False) -> tuple[Store, int]:
    """A store refreshed after each of several steps, in which logs of message lines grow (and its rollups); and how many rows were parsed."""
    lines, root = _dealt(usage_lines(ledger(spark, sf_dir))), scratch.shared_folder(spark, "grown")
    store, parsed, last = Store(spark, scratch.shared_folder(spark, "store")), 0, lines.agg(F.max("ord")).scalar()
    for k in range(1, steps + 1):
        _land(spark, lines.where(F.col("ord") * steps <= last * k), f"{root}/projects")
        days, n = store.refresh("usage", [f"{root}/projects"], "*.jsonl", logs.usage_rows)
        if fold:
            store.fold(days)
        parsed += n
    return store, parsed


_KEPT = f""", kept AS (SELECT *, event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS mid FROM ledger WHERE event_id % 7 <> 6 AND event_id % 11 <> 10),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY user_id % {LOGS}, event_id) AS k FROM kept) WHERE k = 1)"""


@query(f"{_KEPT} SELECT strftime(event_ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS messages, {_sums()}, (SELECT count(*) FROM kept) AS parsed FROM first GROUP BY 1")
def grown_logs(spark, sf_dir):
    """Logs grow twice and each line is parsed once; messages repeat across logs and steps; the stored ledger by day."""
    store, parsed = _grown(spark, sf_dir, 3)
    days = store.rows().groupBy(F.date_format("event_ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("messages"), *breakdown.summed())
    return days.withColumn("parsed", F.lit(parsed).cast("long"))


_ROLLED = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in breakdown.COUNTERS)


@query(f"""{_KEPT}, recent AS (SELECT * FROM first WHERE event_ts >= (SELECT max(event_ts) FROM first) - to_hours(120))
SELECT 'minutes' AS kind, {_bucket(7)} AS bucket, model AS model_key, {_ROLLED} FROM first GROUP BY ALL UNION ALL SELECT 'hours', {_bucket(60)}, model, {_ROLLED} FROM first GROUP BY ALL
UNION ALL SELECT 'days', {_bucket(1440)}, model, {_ROLLED} FROM first GROUP BY ALL UNION ALL SELECT 'auto', {_bucket(120)}, model, {_ROLLED} FROM recent GROUP BY ALL""")
def rollup_series(spark, sf_dir):
    """Series of several steps from the sums by minute, hour and day that two refreshes have kept; the last one of five days at an automatic step."""
    store, _ = _grown(spark, sf_dir, 2, True)
    kinds = {"minutes": store.series(7, "model_key"), "hours": store.series(60, "model_key"), "days": store.series(1440, "model_key"), "auto": store.series(auto_interval(5, 100), "model_key", 5)}
    out = None
    for kind, series in kinds.items():
        named = series.select(F.lit(kind).alias("kind"), "bucket", "model_key", *breakdown.COUNTERS)
        out = named if out is None else out.unionByName(named)
    return out


def _with_meta(rows: DataFrame) -> DataFrame:
    """Event logs in which every twentieth event also states when the session began: an hour before."""
    stated = F.date_format(F.col("event_ts") - F.make_dt_interval(hours=F.lit(1)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), stamp().alias("timestamp"), F.struct(stated.alias("timestamp")).alias("payload")))
    return event_lines(rows).unionByName(log_lines(rows.where(F.col("event_id") % 20 == 0), meta))


_EVENTS = f"""carried AS (
  SELECT *, coalesce(last_value(CASE WHEN event_id % 4 = 0 THEN model END IGNORE NULLS) OVER w, 'unknown') AS m, coalesce(last_value(CASE WHEN event_id % 8 = 0 THEN 'high' END IGNORE NULLS) OVER w, 'unknown') AS e
  FROM ledger WINDOW w AS (PARTITION BY %s ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), counts AS (SELECT *, lag([{_COUNTER_NAMES}]) OVER (PARTITION BY %s ORDER BY event_id) AS p FROM carried WHERE event_id % 4 <> 0),
rows AS (SELECT *, m || ' (' || e || ')' AS named FROM counts WHERE p IS DISTINCT FROM [{_COUNTER_NAMES}])"""


def _events_sql(by: str) -> str:
    return _EVENTS.replace("%s", by)


@query(f""", {_events_sql('user_id')},
bounds AS (SELECT user_id, coalesce(arg_max(event_ts - to_hours(1), event_id) FILTER (event_id % 20 = 0), min(event_ts)) AS s, max(event_ts) AS e FROM ledger GROUP BY 1),
placed AS (SELECT r.named, {', '.join('r.' + c for c in breakdown.COUNTERS)}, CASE WHEN b.e >= b.s THEN {_bucket(240, 'b.s')} ELSE {_bucket(240, 'r.event_ts')} END AS a, CASE WHEN b.e >= b.s THEN {_bucket(240, 'b.e')} ELSE {_bucket(240, 'r.event_ts')} END AS z FROM rows r JOIN bounds b USING (user_id)),
grouped AS (SELECT named, a, z, date_diff('minute', a, z) // 240 + 1 AS n, {_sums()} FROM placed GROUP BY ALL)
SELECT bucket, named AS model_key, {', '.join(f"round(sum({c} * 1.0 / n), 6) AS {c}" for c in breakdown.COUNTERS)} FROM (SELECT *, unnest(generate_series(a, z, to_minutes(240))) AS bucket FROM grouped) GROUP BY 1, 2""")
def spread_parsed_sessions(spark, sf_dir):
    """Event logs with several stated starts are parsed, and the tokens of each row spread over its session."""
    lines = _with_meta(ledger(spark, sf_dir))
    rows = logs.with_session_spans(logs.event_log(lines), logs.event_log_sessions(lines))
    series = timeseries.spread_series(rows, 240, ["model_key"])
    return series.select("bucket", "model_key", *[F.round(c, 6).alias(c) for c in breakdown.COUNTERS])


@query(_SPREAD)
def stream_spread(spark, sf_dir):
    """Sessions land in parts and are spread over their buckets by a stream that sums their ends."""
    folder = scratch.shared_folder(spark, "spread")
    sessions = ledger(spark, sf_dir).groupBy("vendor", "user_id", F.to_date("event_ts").alias("day")).agg(F.min("event_ts").cast("timestamp").alias("session_start"), F.max("event_ts").cast("timestamp").alias("session_end"), *breakdown.summed())
    sessions = sessions.withColumn("event_ts", F.col("session_start")).drop("user_id", "day")
    sessions.repartition(4).write.parquet(f"{folder}/in")
    first, last = sessions.agg(F.min("event_ts"), F.max("event_ts")).first()
    landed = refresh.read_landed(spark, f"{folder}/in", sessions.schema, files_per_batch=1)
    ends = refresh.spread_stream(landed, 90, "vendor", f"{(last - first).days + 3 if first else 3} days")
    refresh.keep_current(ends, refresh.merge_updates(f"{folder}/out", ["bucket", "vendor", "n", "phase"]), f"{folder}/state").awaitTermination()
    series = refresh.spread_now(refresh.current(f"{folder}/out", spark, ends.schema), 90, "vendor")
    return series.select("bucket", "vendor", *[F.round(c, 6).alias(c) for c in breakdown.COUNTERS])


@query(f""", s AS (SELECT {_bucket(60)} AS bucket, vendor, CAST(sum({_ALL}) AS BIGINT) AS tokens FROM ledger GROUP BY 1, 2)
SELECT *, CAST(1 AS BIGINT) AS held FROM s WHERE bucket >= (SELECT max(bucket) FROM s) - to_hours(120)""")
def stream_last_days(spark, sf_dir):
    """Twenty batches of the vendor series; the sink holds one row for each bucket and vendor of the last five days, as the batch does."""
    folder, rows = scratch.shared_folder(spark, "bounded"), _streamable(spark, sf_dir)
    rows.repartitionByRange(20, "event_ts").write.parquet(f"{folder}/in")
    first, last = rows.agg(F.min("event_ts"), F.max("event_ts")).first()
    series = refresh.series_stream(refresh.read_landed(spark, f"{folder}/in", STREAM_SCHEMA, files_per_batch=1), 60, late=f"{(last - first).days + 3 if first else 3} days")
    refresh.keep_current(series, refresh.merge_updates(f"{folder}/out", ["bucket", "vendor"], 5), f"{folder}/state").awaitTermination()
    held = _ntz(refresh.current(f"{folder}/out", spark, series.schema), "bucket")
    return held.groupBy("bucket", "vendor").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("held"))


@query(f""", dealt AS (SELECT *, user_id % {LOGS} AS log, CAST(row_number() OVER (PARTITION BY user_id % {LOGS} ORDER BY event_id) - 1 AS INTEGER) AS place FROM ledger),
{_events_sql(f'user_id % {LOGS}')}
SELECT lpad(CAST(d.log AS VARCHAR), 2, '0') AS session, d.place AS ord, r.event_ts, r.named AS model_key, {', '.join('r.' + c for c in breakdown.COUNTERS)} FROM rows r JOIN dealt d USING (event_id)""")
def stream_event_logs(spark, sf_dir):
    """Event logs land in three parts and a stream parses each part from where its session stood: model, effort and last counts carry over, lines are numbered on."""
    folder, lines = scratch.shared_folder(spark, "events"), _dealt(event_lines(ledger(spark, sf_dir)))
    last = lines.agg(F.max("ord")).scalar()
    for k in range(3):
        part = lines.where((F.col("ord") * 3 > last * k) & (F.col("ord") * 3 <= last * (k + 1)) | (F.lit(k) == 0) & (F.col("ord") == 0))
        _land(spark, part, f"{folder}/in/part-{k}")
        files = refresh.read_landed_logs(spark, f"{folder}/in")
        sink = refresh.event_log_sink(f"{folder}/out", lambda path: F.regexp_extract(path, r"log-([0-9]+)\.jsonl$", 1))
        refresh.keep_current(files, sink, f"{folder}/state").awaitTermination()
    rows = spark.read.parquet(f"{folder}/out/rows")
    return _ntz(rows, "event_ts").select(F.col("source_file").alias("session"), "ord", "event_ts", "model_key", *breakdown.COUNTERS)


@query(f"""{_KEPT}, {_events_sql('user_id % ' + str(LOGS))},
claude AS (SELECT 'Claude' AS vendor, CAST(count(*) AS BIGINT) AS messages, {_sums()} FROM first), codex AS (SELECT 'Codex' AS vendor, CAST(count(*) AS BIGINT) AS messages, {_sums()} FROM rows),
gemini AS (SELECT 'Gemini' AS vendor, CAST(count(*) AS BIGINT) AS messages, {_sums()} FROM ledger WHERE event_id % 5 <> 4)
SELECT *, (SELECT count(*) FROM ledger WHERE event_id % 11 = 10) + 1 AS quarantined FROM (SELECT * FROM claude UNION ALL SELECT * FROM codex UNION ALL SELECT * FROM gemini) WHERE messages > 0""")
def layouts_on_disk(spark, sf_dir):
    """Logs of three layouts under their vendors' roots, with stated starts and a broken document, are read into one ledger that is written and read back."""
    home, rows = scratch.shared_folder(spark, "home"), ledger(spark, sf_dir)
    roots = {v: logs.vendor_roots(v, f"{home}/{v}") for v in logs.ROOTS}
    few = rows.withColumn("user_id", F.col("user_id") % LOGS)
    docs = session_docs(few).select(F.format_string("%02d", F.pmod(F.xxhash64("source_file"), F.lit(LOGS))).alias("log"), F.xxhash64("source_file").alias("ord"), F.col("document").alias("line"), F.col("source_file").alias("name"))
    for vendor, lines in (("Claude", _dealt(usage_lines(rows))), ("Codex", _dealt(_with_meta(rows)))):
        _land(spark, lines, f"{roots[vendor][0]}/2024/01/01")
    broken = spark.range(1).select(F.lit("00").alias("log"), F.lit("broken").alias("name"), F.lit('{"messages": [').alias("line"))
    documents = docs.select("log", "name", "line").unionByName(broken)  # a file for each, as this layout has it
    documents.withColumn("name", F.xxhash64("name")).repartition(LOGS, "log", "name").write.partitionBy("log", "name").text(f"{roots['Gemini'][0]}", compression="none")
    patterns = ("*.jsonl", "*.jsonl", "part-*.txt")
    found = logs.read_ledger(spark, roots["Claude"], roots["Codex"], roots["Gemini"], patterns)
    logs.write_ledger(found, f"{home}/ledger")
    bad = logs.quarantine(logs.read_lines(spark, roots["Claude"])).select("source_file").unionAll(logs.broken_documents(logs.read_documents(spark, roots["Gemini"], patterns[2])).select("source_file"))
    out = read_stored(spark, f"{home}/ledger").groupBy("vendor").agg(F.count("*").alias("messages"), *breakdown.summed())
    return out.withColumn("quarantined", bad.agg(F.count("*")).scalar())
