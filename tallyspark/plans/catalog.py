"""The registered queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timebuckets import auto_interval
from ..operators import breakdown, cost, filters, normalize, timeseries
from ..sources import incremental, logs
from ..sources.schemas import LEDGER
from ..sources.scratch import shared_folder
from ..streaming import refresh
from .ledger_view import DEFAULTS_SQL, LEDGER_SQL, PRICES_SQL, event_lines, ledger, names_by_document, prices_by_document, pricing, session_docs, table, usage_lines
from .report import usage_report

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {LEDGER_SQL} {sql}"
        return f

    return register


def queries() -> dict[str, Query]:
    from . import stored  # noqa: F401  registers the queries over logs on disk, stored ledgers and streams

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import stored  # noqa: F401

    return dict(_SQL)


def _bucket(minutes: int, ts: str = "event_ts") -> str:
    return f"(date_trunc('day', {ts}) + to_minutes(CAST(floor((hour({ts}) * 60 + minute({ts})) / {minutes}.0) * {minutes} AS BIGINT)))"


def _sums(names: list[str] = breakdown.COUNTERS) -> str:
    return ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)


_ALL = "input_tokens + output_tokens + extra_tokens + cache_read_tokens"
_COUNTS = f"CAST(count(*) AS BIGINT) AS messages, {_sums()}"
_TOTALS = f"CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, CAST(sum({_ALL}) AS BIGINT) AS total_with_cache"


def _last(days: int) -> str:
    return f"event_ts >= (SELECT max(event_ts) FROM ledger) - to_hours({24 * days})"


@query(f"SELECT {_COUNTS}, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens FROM ledger")
def overall_totals(spark, sf_dir):
    return breakdown.overall_totals(ledger(spark, sf_dir))


@query(f"SELECT event_id, event_ts, vendor FROM ledger WHERE {_last(3)}")
def last_n_days(spark, sf_dir):
    return filters.last_days(ledger(spark, sf_dir), 3).select("event_id", "event_ts", "vendor")


@query("SELECT event_id, vendor FROM ledger JOIN (SELECT vendor, max(event_ts) AS newest FROM ledger GROUP BY vendor) USING (vendor) WHERE event_ts >= newest - to_hours(48)")
def last_n_days_by_vendor(spark, sf_dir):
    return filters.last_days(ledger(spark, sf_dir), 2, by="vendor").select("event_id", "vendor")


_RATES = f", prices AS ({PRICES_SQL}), defaults AS ({DEFAULTS_SQL})"
_PRICED = f"""{_RATES}, grouped AS (SELECT vendor, model, extra_kind, {_sums()} FROM ledger %s GROUP BY vendor, model, extra_kind),
priced AS (
  SELECT g.*, coalesce(p.input, d.input) AS p_in, coalesce(p.output, d.output) AS p_out, coalesce(p.cache_input, d.cache_input) AS p_read,
    CASE WHEN extra_kind = 'cache_creation' THEN coalesce(p.cache_output, d.cache_output) ELSE coalesce(p.output, d.output) END AS p_extra
  FROM grouped g LEFT JOIN prices p USING (vendor, model) LEFT JOIN defaults d USING (vendor)
), costs AS (
  SELECT vendor, model, CAST(input_tokens * p_in AS DOUBLE) / 1e6 AS input_cost, CAST(output_tokens * p_out AS DOUBLE) / 1e6 AS output_cost,
    CAST(cache_read_tokens * p_read AS DOUBLE) / 1e6 AS cache_read_cost, CAST(extra_tokens * p_extra AS DOUBLE) / 1e6 AS extra_cost,
    input_tokens * p_in + output_tokens * p_out + cache_read_tokens * p_read + extra_tokens * p_extra AS exact
  FROM priced
)"""
_COST_COLUMNS = (
    "input_cost, output_cost, cache_read_cost, extra_cost, input_cost + output_cost AS io_cost, cache_read_cost + extra_cost AS cache_cost, "
    "input_cost + output_cost + cache_read_cost + extra_cost AS total_cost"
)


@query(f"""{_PRICED % ('WHERE ' + _last(7))}, g AS (SELECT vendor, model, {_COUNTS}, {_TOTALS} FROM ledger WHERE {_last(7)} GROUP BY vendor, model)
SELECT g.*, CAST(total_tokens AS DOUBLE) * 100 / sum(total_tokens) OVER () AS percent, input_cost + output_cost + cache_read_cost + extra_cost AS total_cost
FROM g JOIN costs USING (vendor, model) WHERE messages * 1.0 / (SELECT sum(messages) FROM g) >= 0.01""")
def model_breakdown(spark, sf_dir):
    """Which models used how many tokens in the last 7 days, and at what cost; without those under 1 % of messages."""
    recent = filters.last_days(ledger(spark, sf_dir), 7)
    groups = filters.share_threshold(cost.priced_breakdown(recent, *pricing(spark)))
    return breakdown.by_total(breakdown.percent_of_total(groups, "total_tokens", "percent"), key="model")


@query(f"SELECT model_key, regexp_replace(model_key, ' \\([^(]*\\)$', '') AS base_model, {_COUNTS}, {_TOTALS} FROM ledger WHERE vendor = 'Codex' GROUP BY model_key")
def model_effort_breakdown(spark, sf_dir):
    groups = breakdown.model_breakdown(filters.of_vendor(ledger(spark, sf_dir), "Codex"))
    return groups.withColumn("base_model", normalize.base_model(F.col("model_key")))


@query(f"SELECT model_key, {_COUNTS}, {_TOTALS} FROM ledger WHERE vendor = 'Gemini' GROUP BY model_key")
def gemini_breakdown(spark, sf_dir):
    return breakdown.model_breakdown(filters.of_vendor(ledger(spark, sf_dir), "Gemini"))


@query(f"SELECT model_key, {_COUNTS}, {_TOTALS}, grouping(model_key) = 1 AS is_total FROM ledger GROUP BY GROUPING SETS ((model_key), ())")
def breakdown_with_total(spark, sf_dir):
    return breakdown.with_total_row(breakdown.model_breakdown(ledger(spark, sf_dir)))


@query(f"SELECT {_bucket(60)} AS bucket, model, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM ledger GROUP BY 1, 2")
def hourly_by_model(spark, sf_dir):
    return timeseries.tokens_by_model(ledger(spark, sf_dir))


@query(f"SELECT {_bucket(60)} AS bucket, CAST(sum({_ALL}) AS BIGINT) AS tokens FROM ledger GROUP BY 1")
def hourly_all(spark, sf_dir):
    return timeseries.all_tokens(ledger(spark, sf_dir))


@query(f"SELECT {_bucket(120)} AS bucket, {_sums()} FROM ledger GROUP BY 1")
def hourly_parts(spark, sf_dir):
    return timeseries.token_parts(ledger(spark, sf_dir), 2)


@query(f"SELECT {_bucket(7)} AS bucket, vendor, CAST(count(*) AS BIGINT) AS messages FROM ledger GROUP BY 1, 2")
def bucket_7min(spark, sf_dir):
    return timeseries.bucketed(ledger(spark, sf_dir), 7).groupBy("bucket", "vendor").agg(F.count("*").alias("messages"))


@query("SELECT date_trunc('day', l_shipdate) AS bucket, l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2")
def bucket_day_lineitem(spark, sf_dir):
    rows = timeseries.bucketed(table(spark, sf_dir, "lineitem"), 2000, "l_shipdate")
    return rows.groupBy("bucket", "l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query(f"SELECT {_bucket(240)} AS bucket, model_key, {_sums()} FROM ledger GROUP BY 1, 2")
def bucket_4h(spark, sf_dir):
    return timeseries.bucketed(ledger(spark, sf_dir), 240).groupBy("bucket", "model_key").agg(*breakdown.summed())


_SPREAD = f"""SELECT bucket, vendor, {", ".join(f"round(sum({c} * 1.0 / n), 6) AS {c}" for c in breakdown.COUNTERS)} FROM (
  SELECT s.*, unnest(generate_series(a, b, to_minutes(90))) AS bucket, CAST(date_diff('minute', a, b) AS BIGINT) // 90 + 1 AS n FROM (
    SELECT *, {_bucket(90, 'first_ts')} AS a, {_bucket(90, 'last_ts')} AS b FROM (
      SELECT vendor, user_id, CAST(event_ts AS DATE) AS day, min(event_ts) AS first_ts, max(event_ts) AS last_ts, {_sums()} FROM ledger GROUP BY 1, 2, 3)) s
) GROUP BY 1, 2"""


@query(_SPREAD)
def spread_sessions(spark, sf_dir):
    """A session is a user's day; its tokens are spread evenly from its first to its last bucket."""
    sessions = ledger(spark, sf_dir).groupBy("vendor", "user_id", F.to_date("event_ts").alias("day")).agg(F.min("event_ts").alias("session_start"), F.max("event_ts").alias("session_end"), *breakdown.summed())
    series = timeseries.spread_series(sessions, 90, ["vendor"], own="session_start")
    return series.select("bucket", "vendor", *[F.round(c, 6).alias(c) for c in breakdown.COUNTERS])


_VENDOR = f"SELECT {_bucket(60)} AS bucket, vendor, {_ALL} AS n FROM ledger"


@query(f"SELECT bucket, CASE WHEN grouping(vendor) = 1 THEN 'All' ELSE vendor END AS vendor, CAST(sum(n) AS BIGINT) AS tokens FROM ({_VENDOR}) GROUP BY GROUPING SETS ((bucket, vendor), (bucket))")
def vendor_series(spark, sf_dir):
    return timeseries.vendor_series(ledger(spark, sf_dir))


_FILLED = f""", series AS (SELECT bucket, vendor, sum(n) AS tokens FROM ({_VENDOR}) GROUP BY 1, 2), ends AS (SELECT max(event_ts) AS last, max(event_ts) - to_hours(120) AS first FROM ledger),
grid AS (SELECT unnest(generate_series({_bucket(60, 'first')}, last, to_minutes(60))) AS bucket FROM ends), names AS (SELECT DISTINCT vendor FROM series),
filled AS (SELECT bucket, vendor, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens FROM (SELECT * FROM grid CROSS JOIN names) LEFT JOIN series USING (bucket, vendor))"""


def _filled(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    series = timeseries.vendor_series(rows).where(F.col("vendor") != "All")
    return timeseries.gap_filled(series, rows.agg(F.max("event_ts").alias("as_of")), 5, 60)


@query(f"{_FILLED} SELECT * FROM filled")
def gap_filled_series(spark, sf_dir):
    return _filled(spark, sf_dir)


@query(f", s AS (SELECT {_bucket(60)} AS bucket, CAST(sum({_ALL}) AS BIGINT) AS tokens FROM ledger GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY bucket) - 1 AS k, count(*) OVER () AS n FROM s) SELECT bucket, tokens FROM i WHERE n <= 100 OR k % (n // 100) = 0")
def strided_series(spark, sf_dir):
    return timeseries.every_nth(timeseries.all_tokens(ledger(spark, sf_dir)), 100)


@query(f"SELECT {_bucket(720)} AS bucket, vendor, CAST(sum({_ALL}) AS BIGINT) AS tokens FROM ledger GROUP BY 1, 2")
def rebucketed_series(spark, sf_dir):
    fine = timeseries.vendor_series(ledger(spark, sf_dir), 30).where(F.col("vendor") != "All")
    return timeseries.rebucketed(fine, 720, "vendor", "tokens")


def _named_days(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"{_FILLED} SELECT strftime(bucket, '%Y-%m-%d') AS day, vendor, CAST(sum(tokens) AS BIGINT) AS tokens, strftime(bucket, '%a') AS weekday FROM filled GROUP BY ALL")
def daily_totals(spark, sf_dir):
    return _named_days(timeseries.daily_totals(_filled(spark, sf_dir), by=["vendor"]))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS orders, strftime(o_orderdate, '%a') AS weekday FROM orders GROUP BY ALL")
def daily_orders(spark, sf_dir):
    rows = timeseries.bucketed(table(spark, sf_dir, "orders").withColumn("orders", F.lit(1)), 60, "o_orderdate")
    return _named_days(timeseries.daily_totals(rows, "orders"))


@query(f"{_FILLED} SELECT vendor, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS DOUBLE) * 100 / sum(sum(tokens)) OVER () AS percent FROM filled GROUP BY vendor")
def vendor_share(spark, sf_dir):
    return breakdown.percent_of_total(_filled(spark, sf_dir).groupBy("vendor").agg(F.sum("tokens").alias("tokens")), "tokens", "percent")


def _limit(v: str, upward: bool) -> str:
    unit = f"CASE WHEN {v} >= 5000000000 THEN 5000000000 WHEN {v} >= 5000000 THEN 5000000 WHEN {v} >= 5000 THEN 5000 ELSE 5 END"
    return f"CAST(({v} + {f'({unit}) - 1' if upward else '0'}) // ({unit}) * ({unit}) AS BIGINT)"


@query(f""", s AS (SELECT {_bucket(60)} AS bucket, CAST(sum({_ALL}) AS BIGINT) AS tokens FROM ledger GROUP BY 1), e AS (SELECT min(tokens) AS low, max(tokens) AS high FROM s),
l AS (SELECT low, high, {_limit('low', False)} AS axis_low, {_limit('high', True)} AS h FROM e)
SELECT low, high, axis_low, CASE WHEN h = axis_low THEN axis_low + 5000 ELSE h END AS axis_high, CASE WHEN h = 0 THEN 5000 ELSE h END AS axis_high_from_zero FROM l""")
def axis_scale(spark, sf_dir):
    return timeseries.extent(timeseries.all_tokens(ledger(spark, sf_dir)))


@query(f"""{_FILLED}, top AS (SELECT CASE WHEN max(tokens) = 0 THEN 5000 ELSE {_limit('max(tokens)', True)} END AS high FROM filled),
v AS (SELECT bucket, vendor, tokens, CAST(trunc(CAST(tokens AS DOUBLE) / high * 19) AS INTEGER) AS level FROM filled, top),
w AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY vendor ORDER BY bucket), level) AS b FROM v)
SELECT bucket, vendor, tokens, level, CASE WHEN level > b THEN 'up' WHEN level < b THEN 'down' ELSE 'flat' END AS direction, hour(bucket) = 0 AND minute(bucket) = 0 AS day_boundary FROM w""")
def chart_frame(spark, sf_dir):
    return timeseries.chart_frame(_filled(spark, sf_dir))


@query(f", p AS (SELECT {_bucket(60)} AS bucket, {_sums()} FROM ledger GROUP BY 1) SELECT *, input_tokens AS stack_1, input_tokens + output_tokens AS stack_2, input_tokens + output_tokens + extra_tokens AS stack_3, {_ALL} AS stack_4 FROM p")
def stacked_parts(spark, sf_dir):
    return timeseries.stacked(timeseries.token_parts(ledger(spark, sf_dir)))


_STEPS = "[15, 30, 60, 120, 180, 240, 360, 480, 720, 1440]"


@query(f"""{_FILLED}, pts AS (SELECT DISTINCT bucket FROM filled), e AS (SELECT min(bucket) AS first, max(bucket) AS last, date_diff('minute', min(bucket), max(bucket)) AS span FROM pts),
st AS (SELECT *, (SELECT s FROM (SELECT unnest({_STEPS}) AS s) ORDER BY abs(s - e.span * 0.05), s LIMIT 1) AS step FROM e),
tk AS (SELECT unnest(generate_series(date_trunc('day', first) + to_minutes(CAST(ceil((hour(first) * 60 + minute(first)) / (step * 1.0)) * step AS BIGINT)), last, to_minutes(step))) AS tick FROM st),
near AS (SELECT tick, bucket, row_number() OVER (PARTITION BY tick ORDER BY abs(date_diff('microsecond', tick, bucket)), bucket DESC) AS k FROM tk, pts)
SELECT min(tick) AS tick, bucket FROM near WHERE k = 1 GROUP BY bucket""")
def axis_ticks(spark, sf_dir):
    return timeseries.axis_ticks(_filled(spark, sf_dir))


@query(f"{_PRICED % ''} SELECT vendor, model, {_COST_COLUMNS} FROM costs")
def cost_by_type(spark, sf_dir):
    return cost.cost_by_type(ledger(spark, sf_dir), *pricing(spark))


@query(f"""{_PRICED % ''}, t AS (SELECT unnest(['input_cost', 'output_cost', 'cache_read_cost', 'extra_cost']) AS part, unnest([sum(input_cost), sum(output_cost), sum(cache_read_cost), sum(extra_cost)]) AS c FROM costs)
SELECT part, round(c, 6) AS cost, round(c * 100 / sum(c) OVER (), 6) AS percent FROM t""")
def cost_share(spark, sf_dir):
    out = cost.cost_share(cost.cost_by_type(ledger(spark, sf_dir), *pricing(spark)))
    return out.select("part", F.round("cost", 6).alias("cost"), F.round("percent", 6).alias("percent"))


@query(f"{_PRICED % ''} SELECT vendor, CAST(sum(exact) AS DOUBLE) / 1e6 AS api_cost FROM costs GROUP BY vendor")
def api_cost_by_vendor(spark, sf_dir):
    """Prices come from a document, as a user keeps them."""
    return cost.api_cost(ledger(spark, sf_dir), *prices_by_document(spark))


_PROJECTED = f"""{_PRICED % ''}, each AS (
  SELECT vendor, tokens, api_cost, api_cost / 30 AS daily_cost, api_cost / 30 * 7 AS weekly_cost, api_cost / 30 * 30 AS monthly_cost, api_cost / 30 * 30 - subscription AS saving,
    subscription / (tokens / CAST(30 AS DOUBLE) * 30 / 1e6) AS cost_per_mtok
  FROM (SELECT vendor, CAST(sum(exact) AS DOUBLE) / 1e6 AS api_cost FROM costs GROUP BY vendor) JOIN (SELECT vendor, CAST(sum({_ALL}) AS BIGINT) AS tokens FROM ledger GROUP BY vendor) USING (vendor)
  JOIN (SELECT vendor, CAST(subscription_price AS DOUBLE) AS subscription FROM defaults) USING (vendor)
)"""


@query(f"{_PROJECTED} SELECT * FROM each")
def projection(spark, sf_dir):
    return cost.projection(ledger(spark, sf_dir), *pricing(spark), 30)


@query(f"{_PROJECTED} SELECT round(sum(tokens * cost_per_mtok) / sum(tokens), 9) AS weighted_cost_per_mtok, round(sum(saving), 6) AS total_saving, CAST(sum(tokens) AS BIGINT) AS tokens FROM each")
def weighted_cost(spark, sf_dir):
    out = cost.weighted_cost(ledger(spark, sf_dir), *pricing(spark), 30)
    return out.select(F.round("weighted_cost_per_mtok", 9).alias("weighted_cost_per_mtok"), F.round("total_saving", 6).alias("total_saving"), "tokens")


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'system' THEN nullif(text, '') END IGNORE NULLS) OVER w, 'unknown') AS context,
  coalesce(last_value(CASE WHEN role = 'user' THEN nullif(text, '') END IGNORE NULLS) OVER w, 'unknown') AS question
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def carry_forward(spark, sf_dir):
    said = lambda role: F.when(F.col("role") == role, F.col("text"))
    out = normalize.carry_forward(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], {"context": said("system"), "question": said("user")})
    return out.select("conv_id", "turn", "context", "question")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p")
def drop_repeats(spark, sf_dir):
    out = normalize.drop_repeats(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return out.select("event_id", "user_id", "event_type")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS k FROM documents WHERE coalesce(lang, '') <> '' AND coalesce(text, '') <> '') WHERE k = 1 UNION ALL SELECT doc_id, lang FROM documents WHERE coalesce(lang, '') = '' OR coalesce(text, '') = ''")
def first_seen(spark, sf_dir):
    """Documents by language and text, the smallest id stays; hashes of the text stand in for it in the shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.nullif(F.col("text"), F.lit("")).alias("t"))
    hashed = docs.select("doc_id", "lang", F.when(F.col("t").isNotNull(), F.sha2("t", 256)).alias("h"))
    return normalize.first_seen(hashed, ["lang", "h"], ["doc_id"]).select("doc_id", "lang")


@query("SELECT doc_id FROM documents d WHERE source <> (SELECT min(source) FROM documents) AND text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.source = (SELECT min(source) FROM documents) AND o.text = d.text)")
def unseen_keys(spark, sf_dir):
    """Documents of all other sources whose text the first source, which stands for an existing ledger, does not hold."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = table(spark, sf_dir, "documents").agg(F.min("source")).scalar()
    return normalize.unseen(docs.where(F.col("source") != first), docs.where(F.col("source") == first), ["h"]).select("doc_id")


@query(f", g AS (SELECT model_key, count(*) AS n FROM ledger GROUP BY 1) SELECT {_bucket(720)} AS bucket, model_key, CAST(sum({_ALL}) AS BIGINT) AS tokens FROM ledger WHERE model_key IN (SELECT model_key FROM g WHERE n * 1.0 / (SELECT sum(n) FROM g) >= 0.05) GROUP BY 1, 2")
def included_models(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    kept = filters.included(rows, filters.share_threshold(breakdown.model_breakdown(rows), least=0.05))
    total = F.col("input_tokens") + F.col("output_tokens") + F.col("extra_tokens") + F.col("cache_read_tokens")
    return timeseries.bucketed(kept, 720).groupBy("bucket", "model_key").agg(F.sum(total).alias("tokens"))


@query(f", s AS (SELECT {_bucket(1440)} AS bucket, model_key, CAST(sum(CASE WHEN vendor = 'Codex' THEN extra_tokens ELSE 0 END) AS BIGINT) AS tokens FROM ledger GROUP BY 1, 2) SELECT * FROM s WHERE model_key IN (SELECT model_key FROM s GROUP BY 1 HAVING max(tokens) > 0)")
def nonempty_series(spark, sf_dir):
    rows = timeseries.bucketed(ledger(spark, sf_dir), 1440)
    series = rows.groupBy("bucket", "model_key").agg(F.sum(F.when(F.col("vendor") == "Codex", F.col("extra_tokens")).otherwise(0)).alias("tokens"))
    return filters.without_empty_series(series, ["model_key"], "tokens")


def _names(spark: SparkSession) -> DataFrame:
    return names_by_document(spark)


@query(f"""SELECT model AS model_key, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, any_value(o) AS sort_order,
  CAST(row_number() OVER (ORDER BY any_value(o) NULLS LAST, model) AS INTEGER) AS place
FROM ledger LEFT JOIN (SELECT * FROM (VALUES ('m3', 1), ('m1', 2), ('m2', 3)) AS n(model, o)) USING (model) GROUP BY model""")
def top_models_ordered(spark, sf_dir):
    groups = breakdown.model_breakdown(ledger(spark, sf_dir), ["model"]).withColumnRenamed("model", "model_key")
    ordered = breakdown.by_fixed_order(groups, _names(spark).withColumnRenamed("model", "model_key"))
    return ordered.select("model_key", "total_tokens", "sort_order", F.row_number().over(_by_place()).alias("place"))


def _by_place():
    from pyspark.sql import Window

    return Window.orderBy(F.asc_nulls_last("sort_order"), "model_key")  # over one row per model


def _compact(n: str) -> str:
    """The compact label in SQL: whole numbers, rounded half up to the places that are shown."""
    return f"CASE WHEN {n} >= 1000000000 THEN {_scaled(n, 1_000_000_000, 'B')} WHEN {n} >= 1000000 THEN {_scaled(n, 1_000_000, 'M')} WHEN {n} >= 1000 THEN {_scaled(n, 1000, 'K')} ELSE CAST({n} AS VARCHAR) END"


def _scaled(n: str, unit: int, suffix: str) -> str:
    one, two = f"({n} * 20 + {unit}) // (2 * {unit})", f"({n} * 200 + {unit}) // (2 * {unit})"
    return f"CASE WHEN {n} >= {100 * unit} THEN ({n} // {unit}) || '{suffix}' WHEN {n} >= {10 * unit} THEN ({one} // 10) || '.' || ({one} % 10) || '{suffix}' ELSE ({two} // 100) || '.' || lpad(CAST({two} % 100 AS VARCHAR), 2, '0') || '{suffix}' END"


def _dollars(v: str) -> str:
    cents, places = f"CAST(floor(CAST({v} AS DECIMAL(24,9)) * 100 + 0.5) AS BIGINT)", f"CAST(ceil(-log10({v})) AS INTEGER)"
    return f"CASE WHEN {v} >= 0.01 THEN '$' || ({cents} // 100) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0') WHEN {v} <= 0 THEN '$0.00' ELSE '$0.' || lpad(CAST(CAST(round({v} * pow(10, {places})) AS BIGINT) AS VARCHAR), {places}, '0') END"


_NEWEST = "JOIN (SELECT vendor, max(event_ts) AS newest FROM ledger GROUP BY vendor) USING (vendor) WHERE event_ts >= newest - to_hours(168)"
_NAMED = "(SELECT * FROM (VALUES ('Claude', 'm3', 'Large'), ('Claude', 'm1', 'Small'), ('Gemini', 'm2', 'Swift')) AS n(vendor, model, short_name))"


def _report_sql(key: list[str], name: str, where: str = "") -> str:
    keys, labels = ", ".join(key), f"format('{{:,}}', total_tokens) AS total_label, {_compact('total_with_cache')} AS compact_label, {_dollars('total_cost')} AS cost_label"
    priced = _PRICED % (_NEWEST + where)
    for old, new in ((", grouped AS (SELECT vendor, model, extra_kind", f", grouped AS (SELECT {keys}, extra_kind"), ("GROUP BY vendor, model, extra_kind)", f"GROUP BY {keys}, extra_kind)"), ("SELECT vendor, model, CAST(input_tokens", f"SELECT {keys}, CAST(input_tokens")):
        priced = priced.replace(old, new)
    return f"""{priced}, recent AS (SELECT ledger.* FROM ledger {_NEWEST}{where}), g AS (SELECT {keys}, {_COUNTS}, {_TOTALS} FROM recent GROUP BY {keys}),
r AS (SELECT g.*, input_cost + output_cost + cache_read_cost + extra_cost AS total_cost, CAST(total_tokens AS DOUBLE) * 100 / sum(total_tokens) OVER () AS percent
  FROM g JOIN costs USING ({keys}) WHERE messages * 1.0 / (SELECT sum(messages) FROM g) >= 0.01)
SELECT r.*, {name} AS name, {labels} FROM r LEFT JOIN {_NAMED} USING (vendor, model)"""


@query(_report_sql(["vendor", "model"], "coalesce(short_name, substr(model, 1, 12))"))
def report(spark, sf_dir):
    """The usage report with its labels."""
    return usage_report(ledger(spark, sf_dir), *pricing(spark), _names(spark))


@query(_report_sql(["vendor", "model", "effort"], "coalesce(short_name, substr(model, 1, 10)) || '(' || upper(substr(effort, 1, 1)) || ')'", " AND vendor = 'Codex'"))
def report_by_effort(spark, sf_dir):
    """The usage report of the vendor whose models run at several efforts, which its names show."""
    return usage_report(ledger(spark, sf_dir), *pricing(spark), _names(spark), vendor="Codex", by_effort=True)


@query(f"SELECT {_bucket(120)} AS bucket, CAST(sum({_ALL}) AS BIGINT) AS tokens FROM ledger WHERE {_last(5)} GROUP BY 1")
def auto_interval_series(spark, sf_dir):
    """The last 5 days at the finest step that keeps to 100 points."""
    minutes = auto_interval(5, 100)
    rows = timeseries.bucketed(filters.last_days(ledger(spark, sf_dir), 5), minutes)
    return rows.groupBy("bucket").agg(F.sum(F.col("input_tokens") + F.col("output_tokens") + F.col("extra_tokens") + F.col("cache_read_tokens")).alias("tokens"))


_PARSED = ["source_file", "ord", "event_ts", "model_key", "input_tokens", "output_tokens", "cache_read_tokens", "extra_tokens"]
_SOURCE = "'/logs/' || user_id AS source_file, CAST(event_id AS INTEGER) AS ord, event_ts"
_COUNTER_NAMES = "input_tokens, output_tokens, cache_read_tokens, extra_tokens"


@query(f""", kept AS (SELECT *, event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS mid FROM ledger WHERE event_id % 7 <> 6 AND event_id % 11 <> 10)
SELECT {_SOURCE}, model AS model_key, {_COUNTER_NAMES} FROM (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY '/logs/' || user_id, event_id) AS k FROM kept) WHERE k = 1""")
def parse_usage_logs(spark, sf_dir):
    rows = logs.usage_log(usage_lines(ledger(spark, sf_dir)))
    return rows.select(*_PARSED).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


@query(f""", carried AS (
  SELECT *, coalesce(last_value(CASE WHEN event_id % 4 = 0 THEN model END IGNORE NULLS) OVER w, 'unknown') AS m, coalesce(last_value(CASE WHEN event_id % 8 = 0 THEN 'high' END IGNORE NULLS) OVER w, 'unknown') AS e
  FROM ledger WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), counts AS (SELECT *, lag([{_COUNTER_NAMES}]) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM carried WHERE event_id % 4 <> 0)
SELECT {_SOURCE}, m || ' (' || e || ')' AS model_key, {_COUNTER_NAMES} FROM counts WHERE p IS DISTINCT FROM [{_COUNTER_NAMES}]""")
def parse_event_logs(spark, sf_dir):
    rows = logs.event_log(event_lines(ledger(spark, sf_dir)))
    return rows.select(*_PARSED).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


@query(f"""SELECT '/docs/' || user_id || '/' || strftime(event_ts, '%Y-%m-%d') AS source_file, CAST(row_number() OVER (PARTITION BY user_id, CAST(event_ts AS DATE) ORDER BY event_id) - 1 AS INTEGER) AS ord,
  event_ts, model AS model_key, {_COUNTER_NAMES}, event_id % 5 = 4 AS other FROM ledger""".join([", d AS (", f") SELECT source_file, ord, event_ts, model_key, {_COUNTER_NAMES} FROM d WHERE NOT other"]))
def parse_session_documents(spark, sf_dir):
    from ..sources.schemas import SESSION_DOCUMENT

    docs = session_docs(ledger(spark, sf_dir)).select("source_file", F.lit(0).alias("root_rank"), F.from_json("document", SESSION_DOCUMENT).alias("d"))
    rows = logs.session_documents(docs.select("source_file", "root_rank", "d.messages"))
    return rows.select(*_PARSED).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


@query("SELECT '/logs/' || user_id AS source_file, CAST(event_id AS INTEGER) AS ord FROM events WHERE event_id % 11 = 10")
def quarantined_lines(spark, sf_dir):
    return logs.quarantine(usage_lines(ledger(spark, sf_dir))).select("source_file", "ord")


@query("SELECT '/logs/' || user_id AS source_file, min(event_ts) AS session_start, max(event_ts) AS session_end FROM ledger GROUP BY 1")
def session_bounds(spark, sf_dir):
    out = logs.event_log_sessions(event_lines(ledger(spark, sf_dir)))
    return out.select("source_file", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")])


@query(f""", kept AS (SELECT *, event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS mid FROM ledger WHERE event_id % 7 <> 6 AND event_id % 11 <> 10),
first AS (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY user_id % 2, 'user=' || user_id || '/', event_id) AS k FROM kept)
SELECT strftime(event_ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS messages, {_sums()} FROM first WHERE k = 1 GROUP BY 1""")
def incremental_refresh(spark, sf_dir):
    """Logs land in the order of users' names, are parsed, more files land, and only those are parsed again; messages repeat across the files of both steps; the ledger by day at the end.

    Files hold the lines of many users, as many as their bytes ask for: the driver holds a name and a state for every file that it lists.
    """
    folder, named = shared_folder(spark, "logs"), [F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit("/")), F.col("event_id")]

    def parse(listing: DataFrame) -> DataFrame:
        return logs.usage_rows(logs.read_lines(spark, [f"{folder}/projects"], "*.txt", listing=listing))

    known, manifest = spark.createDataFrame([], LEDGER), spark.createDataFrame([], incremental.MANIFEST)
    for step, half in enumerate("ab"):
        dealt = ledger(spark, sf_dir).where(F.col("user_id") % 2 == step).repartitionByRange(*named).sortWithinPartitions(*named)  # names of files rise with the ranges
        usage_lines(dealt).select("line").write.text(f"{folder}/projects/{half}", compression="none")
        known, manifest = incremental.refresh(spark, [f"{folder}/projects"], "*.txt", manifest, known, parse)
        known.write.parquet(f"{folder}/ledger-{step}")
        known = spark.read.parquet(f"{folder}/ledger-{step}")
    return logs.first_messages(known).groupBy(F.date_format("event_ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("messages"), *breakdown.summed())


@query(f"""SELECT i AS root_rank, CAST(count(*) AS BIGINT) AS messages, {_sums()} FROM (
  SELECT *, CASE WHEN vendor = 'Claude' THEN 0 ELSE 1 END AS i, row_number() OVER (PARTITION BY mid ORDER BY CASE WHEN vendor = 'Claude' THEN 0 ELSE 1 END, event_id) AS k
  FROM (SELECT *, event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS mid FROM ledger WHERE event_id % 7 <> 6 AND event_id % 11 <> 10)) WHERE k = 1 GROUP BY 1""")
def ranked_roots(spark, sf_dir):
    """Messages of two roots, the second inside the first and with a space in its name, of which the inner one comes first."""
    folder, rows = shared_folder(spark, "roots"), ledger(spark, sf_dir)
    outer, inner = f"{folder}/logs", f"{folder}/logs/my logs+%20"
    for root, own in ((inner, F.col("vendor") == "Claude"), (outer + "/x", F.col("vendor") != "Claude")):
        usage_lines(rows.where(own)).repartitionByRange("ord").sortWithinPartitions("ord").select("line").write.text(root, compression="none")
    found = logs.usage_log(logs.read_lines(spark, [inner, outer], "*.txt", whole=False))
    return found.groupBy(F.col("source_root").cast("int").alias("root_rank")).agg(F.count("*").alias("messages"), *breakdown.summed())


STREAM_SCHEMA = "vendor STRING, event_ts TIMESTAMP, " + ", ".join(f"{c} LONG" for c in breakdown.COUNTERS)


def _streamable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("vendor", F.col("event_ts").cast("timestamp").alias("event_ts"), *breakdown.COUNTERS)


def _series_run(spark: SparkSession, folder: str, late: str):
    """Run the hourly vendor series over all that has landed, from where it stopped before."""
    rows = refresh.read_landed(spark, f"{folder}/in", STREAM_SCHEMA, files_per_batch=100)
    stream = refresh.keep_current(refresh.series_stream(rows, 60, late=late), refresh.append_updates(f"{folder}/out"), f"{folder}/state")
    stream.awaitTermination()
    return stream


def _series_now(spark: SparkSession, folder: str) -> DataFrame:
    current = refresh.latest_of(f"{folder}/out", spark, ["bucket", "vendor"], "tokens")
    return current.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "vendor", "tokens")


@query(f"SELECT bucket, vendor, CAST(sum(n) AS BIGINT) AS tokens FROM ({_VENDOR}) GROUP BY 1, 2")
def stream_vendor_series(spark, sf_dir):
    """The hourly vendor series of a stream over ledger files that land in three parts, in time order; the stream is stopped and started again after each.

    The watermark is three days beyond the span of a part, so that the order of files inside it does not matter.
    """
    folder, rows = shared_folder(spark, "stream"), _streamable(spark, sf_dir)
    first, last = rows.agg(F.min("event_ts"), F.max("event_ts")).first()
    days = (last - first).days // 3 + 1 if first else 1
    part = F.floor((F.unix_micros("event_ts") - F.unix_micros(F.lit(first))) / (days * 86_400_000_000))
    for k in range(3):
        rows.where(part == k).write.mode("append").parquet(f"{folder}/in")
        _series_run(spark, folder, f"{days + 3} days")
    return _series_now(spark, folder)


@query(f""", b AS ({_VENDOR}), w AS (SELECT max(bucket) - to_hours(72) AS mark FROM b WHERE vendor <> 'Gemini')
SELECT bucket, vendor, CAST(sum(n) AS BIGINT) AS tokens, CASE WHEN vendor = 'Gemini' AND bucket <= (SELECT mark FROM w) THEN 'backfill' ELSE 'stream' END AS way FROM b GROUP BY ALL""")
def stream_late_rows(spark, sf_dir):
    """A vendor's rows land after all others and a restart: those within three days of the newest update the stream, older ones are left to the batch backfill."""
    folder, rows = shared_folder(spark, "late"), _streamable(spark, sf_dir)
    rows.where(F.col("vendor") != "Gemini").write.parquet(f"{folder}/in")
    mark = refresh.watermark_of(_series_run(spark, folder, "3 days"))
    rows.where(F.col("vendor") == "Gemini").write.mode("append").parquet(f"{folder}/in")
    _series_run(spark, folder, "3 days")
    filled = timeseries.vendor_series(refresh.late_rows(rows.where(F.col("vendor") == "Gemini"), 60, mark)).where(F.col("vendor") != "All")
    return _series_now(spark, folder).withColumn("way", F.lit("stream")).unionByName(filled.withColumn("way", F.lit("backfill")))


@query("""SELECT message_id, request_id, CASE WHEN message_id = '' OR request_id IS NULL THEN CAST(count(*) AS BIGINT) ELSE 1 END AS messages FROM (
  SELECT CASE WHEN event_type = 'error' THEN '' ELSE 'm' || user_id END AS message_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS request_id FROM events) GROUP BY 1, 2""")
def stream_first_seen(spark, sf_dir):
    """The first of each user and kind of event in a stream that is started twice; rows with an empty or no part of the key all pass."""
    folder = shared_folder(spark, "dedupe")
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("m"), F.col("user_id").cast("string"))).alias("message_id"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("request_id"), F.col("ts").cast("timestamp").alias("event_ts"), "user_id",
    )
    first, last = rows.agg(F.min("event_ts"), F.max("event_ts")).first()
    late = f"{(last - first).days + 1 if first else 1} days"  # no key may be forgotten before the end
    middle = rows.agg(F.percentile_approx("user_id", 0.5)).first()[0]
    for low in (True, False):  # keys repeat inside a step and, where they are empty, across both
        rows.where((F.col("user_id") <= middle) == low).drop("user_id").write.mode("append").parquet(f"{folder}/in")
        stream = refresh.read_landed(spark, f"{folder}/in", "message_id STRING, request_id STRING, event_ts TIMESTAMP")
        kept = refresh.first_seen_stream(stream, ["message_id", "request_id"], "event_ts", late)
        refresh.keep_current(kept, refresh.append_updates(f"{folder}/out"), f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("message_id", "request_id").agg(F.count("*").alias("messages"))
