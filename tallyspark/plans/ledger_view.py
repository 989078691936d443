"""A ledger over the driver's ``events`` table, prices for it, and session logs made of it; in Spark and in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import model_key
from ..sources.names import read_names
from ..sources.pricing import read_pricing
from ..sources.scratch import shared_folder

VENDORS = ["Claude", "Codex", "Gemini"]
EXTRA = {"Claude": "cache_creation", "Codex": "reasoning", "Gemini": "thinking"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    vendor = F.when(kind.isin("click", "view"), "Claude").when(kind == "error", "Gemini").otherwise("Codex")
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").alias("event_ts"), vendor.alias("vendor"), F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("event_id") % 3 + 1).cast("int")).alias("effort"),
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"), F.get_json_object("props", "$.k").cast("long").alias("output_tokens"),
        (F.col("user_id") * 10).alias("cache_read_tokens"), (F.col("event_id") % 50).alias("extra_tokens"),
    )
    rows = rows.withColumn("effort", F.when(F.col("vendor") == "Codex", F.col("effort")))
    extra = F.when(F.col("vendor") == "Claude", "cache_creation").when(F.col("vendor") == "Codex", "reasoning").otherwise("thinking")
    return rows.withColumns({"model_key": model_key(F.col("model"), F.col("effort")), "extra_kind": extra})


LEDGER_SQL = """ledger AS (
  SELECT *, CASE WHEN effort IS NULL THEN model ELSE model || ' (' || effort || ')' END AS model_key,
    CASE vendor WHEN 'Claude' THEN 'cache_creation' WHEN 'Codex' THEN 'reasoning' ELSE 'thinking' END AS extra_kind
  FROM (
    SELECT event_id, user_id, ts AS event_ts, 'm' || CAST(user_id % 7 AS VARCHAR) AS model,
      CASE WHEN event_type IN ('click', 'view') THEN 'Claude' WHEN event_type = 'error' THEN 'Gemini' ELSE 'Codex' END AS vendor,
      CASE WHEN event_type IN ('click', 'view', 'error') THEN NULL WHEN event_id % 3 = 0 THEN 'low' WHEN event_id % 3 = 1 THEN 'medium' ELSE 'high' END AS effort,
      CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS output_tokens,
      user_id * 10 AS cache_read_tokens, event_id % 50 AS extra_tokens
    FROM events
  )
)"""


def _priced() -> str:
    """Prices by a rule: they rise with the vendor's place and the model's number; m6 has none and takes the default."""
    rows = [(v, f"m{i}", 0.25 * (j + 1) * (i + 1)) for j, v in enumerate(VENDORS) for i in range(6)]
    return ", ".join(f"('{v}', '{m}', {x:.6f}, {5 * x:.6f}, {x / 10:.6f}, {1.25 * x:.6f})" for v, m, x in rows)


def _typed(names: list[str], kind: str) -> str:
    return ", ".join(f"CAST({n} AS {kind}) AS {n}" for n in names)


_NAMES = ["input", "output", "cache_input", "cache_output"]
PRICES_SQL = f"SELECT vendor, model, {_typed(_NAMES, 'DECIMAL(12,6)')} FROM (VALUES {_priced()}) AS p(vendor, model, {', '.join(_NAMES)})"
DEFAULTS_SQL = (
    f"SELECT vendor, {_typed(_NAMES, 'DECIMAL(12,6)')}, CAST(subscription_price AS DECIMAL(12,2)) AS subscription_price FROM (VALUES "
    f"('Claude', 1.5, 7.5, 0.15, 1.875, 200.00), ('Codex', 1.25, 10.0, 0.125, 1.25, 150.00), ('Gemini', 0.5, 3.0, 0.05, 0.5, 19.99)) AS p(vendor, {', '.join(_NAMES)}, subscription_price)"
)


def pricing(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.sql(PRICES_SQL), spark.sql(DEFAULTS_SQL)


def _document(spark: SparkSession, name: str, content: dict) -> str:
    """The path of a JSON document in the shared folder."""
    folder = shared_folder(spark, name)
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(folder)
    return folder


def prices_by_document(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The same prices, kept as a document and read from it."""
    prices, defaults = ([r.asDict() for r in df.collect()] for df in pricing(spark))  # a row per model and per vendor
    numbers = lambda r: {n: float(r[n]) for n in _NAMES}
    content = {d["vendor"].lower(): {
        "subscription_price": float(d["subscription_price"]), "default": numbers(d), "models": {p["model"]: numbers(p) for p in prices if p["vendor"] == d["vendor"]},
    } for d in defaults}
    return read_pricing(spark, _document(spark, "prices", content | {"_meta": {"unit": "million tokens"}}))


def names_by_document(spark: SparkSession) -> DataFrame:
    """Display names of some models of this ledger, read from a document."""
    return read_names(spark, _document(spark, "names", {"Claude": {"m3": {"short": "Large", "order": 1}, "m1": {"short": "Small", "order": 2}}, "Gemini": {"m2": {"short": "Swift", "order": 3}}}))


def log_lines(rows: DataFrame, line) -> DataFrame:
    """Lines of a session log per user, numbered by event."""
    return rows.select(F.concat(F.lit("/logs/"), F.col("user_id").cast("string")).alias("source_file"), F.lit(0).alias("root_rank"), F.col("event_id").cast("int").alias("ord"), line.alias("line"))


def stamp():
    return F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def usage_lines(rows: DataFrame) -> DataFrame:
    """A message per event; every tenth event repeats the message of the one before."""
    ident = F.concat(F.lit("msg"), (F.col("event_id") - F.when(F.col("event_id") % 10 == 9, 1).otherwise(0)).cast("string"))
    usage = F.struct(F.col("input_tokens"), F.col("output_tokens"), F.col("extra_tokens").alias("cache_creation_input_tokens"), F.col("cache_read_tokens").alias("cache_read_input_tokens"))
    message = F.struct(ident.alias("id"), F.col("model"), F.when(F.col("event_id") % 7 != 6, usage).alias("usage"))
    line = F.to_json(F.struct(stamp().alias("timestamp"), F.lit("r1").alias("requestId"), message.alias("message")))
    return log_lines(rows, F.when(F.col("event_id") % 11 == 10, F.substring(line, 1, 30)).otherwise(line))


def event_lines(rows: DataFrame) -> DataFrame:
    """Per user an event log: every fourth event sets model and effort, the others count tokens."""
    usage = F.struct(
        (F.col("input_tokens") + F.col("cache_read_tokens")).alias("input_tokens"), F.col("cache_read_tokens").alias("cached_input_tokens"),
        (F.col("output_tokens") + F.col("extra_tokens")).alias("output_tokens"), F.col("extra_tokens").alias("reasoning_output_tokens"),
    )
    context = F.to_json(F.struct(F.lit("turn_context").alias("type"), stamp().alias("timestamp"), F.struct(F.col("model"), F.when(F.col("event_id") % 8 == 0, F.lit("high")).alias("effort")).alias("payload")))
    count = F.to_json(F.struct(F.lit("event_msg").alias("type"), stamp().alias("timestamp"), F.struct(F.lit("token_count").alias("type"), F.struct(usage.alias("last_token_usage")).alias("info")).alias("payload")))
    return log_lines(rows, F.when(F.col("event_id") % 4 == 0, context).otherwise(count))


def session_docs(rows: DataFrame) -> DataFrame:
    """Per user and day one document whose messages are that day's events."""
    tokens = F.struct((F.col("input_tokens") + F.col("cache_read_tokens")).alias("input"), F.col("output_tokens").alias("output"), F.col("cache_read_tokens").alias("cached"), F.col("extra_tokens").alias("thoughts"))
    message = F.struct(F.when(F.col("event_id") % 5 == 4, "user").otherwise("gemini").alias("type"), stamp().alias("timestamp"), F.col("model"), tokens.alias("tokens"))
    grouped = rows.groupBy("user_id", F.to_date("event_ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("event_id", message.alias("m")))).alias("m"))
    return grouped.select(F.concat_ws("/", F.lit("/docs"), "user_id", "day").alias("source_file"), F.to_json(F.struct(F.transform("m", lambda x: x["m"]).alias("messages"))).alias("document"))
