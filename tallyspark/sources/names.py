"""Display names and their order, from a JSON document: vendor -> model -> short name, place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short names by vendor and model, and the place of those that charts show first.
SHORT_NAMES = {
    "Claude": {
        "claude-opus-4-5-20251101": "Opus 4.5", "claude-opus-4-1-20250805": "Opus 4.1", "claude-sonnet-4-5-20250929": "Sonnet 4.5",
        "claude-sonnet-4-20250514": "Sonnet 4", "claude-haiku-4-5-20251001": "Haiku 4.5", "<synthetic>": "synthetic",
    },
    "Codex": {
        "gpt-5-codex": "GPT-5 Codex", "gpt-5.1-codex": "GPT-5.1 Codex", "gpt-5.1-codex-max": "GPT-5.1 Max", "gpt-5.1-codex-mini": "GPT-5.1 Mini",
        "codex-mini-latest": "Codex Mini", "gpt-4.1": "GPT-4.1", "gpt-4.1-mini": "GPT-4.1 Mini", "gpt-4.1-nano": "GPT-4.1 Nano",
        "o1": "o1", "o3": "o3", "o3-mini": "o3-mini", "o4-mini": "o4-mini",
    },
    "Gemini": {
        "gemini-3-pro-preview": "Gem 3 Pro", "gemini-3-pro-image-preview": "Gem 3 Img", "gemini-2.5-pro": "Gem 2.5 Pro", "gemini-2.5-flash": "Gem 2.5 Fl",
        "gemini-2.5-flash-preview-09-2025": "Gem 2.5 Fl", "gemini-2.5-flash-lite": "Gem 2.5 Lt", "gemini-2.5-flash-lite-preview-09-2025": "Gem 2.5 Lt",
        "gemini-2.0-flash": "Gem 2.0 Fl", "gemini-2.0-flash-lite": "Gem 2.0 Lt",
    },
}
CHART_ORDER = ["claude-opus-4-5-20251101", "claude-opus-4-1-20250805", "claude-sonnet-4-5-20250929", "claude-sonnet-4-20250514", "claude-haiku-4-5-20251001"]
NAMES = "vendor string, model string, short_name string, sort_order int"


def known_names(spark: SparkSession) -> DataFrame:
    """(vendor, model, short_name, sort_order) of the models that are known here."""
    place = {m: i for i, m in enumerate(CHART_ORDER)}
    return spark.createDataFrame([(v, m, n, place.get(m)) for v, own in SHORT_NAMES.items() for m, n in own.items()], NAMES)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(vendor, model, short_name, sort_order) of a document; keys that start with an underscore are notes."""
    whole = spark.read.text(path, wholetext=True)
    vendors = whole.select(F.explode(F.from_json("value", "MAP<STRING, MAP<STRING, STRUCT<short: STRING, order: INT>>>")).alias("vendor", "m")).where(~F.startswith("vendor", F.lit("_")))
    models = vendors.select("vendor", F.explode("m").alias("model", "n")).where(~F.startswith("model", F.lit("_")))
    return models.select("vendor", "model", F.col("n.short").alias("short_name"), F.col("n.order").alias("sort_order"))
