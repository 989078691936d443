"""Prices per million tokens, from a JSON document: vendor -> subscription price, models, default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import PRICING

NAMES = ["input", "output", "cache_input", "cache_output"]


def read_pricing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(prices by vendor and model, defaults and subscription price by vendor); keys that start with an underscore are notes."""
    whole = spark.read.text(path, wholetext=True)
    vendors = whole.select(F.explode(F.from_json("value", f"MAP<STRING, STRUCT<{_colons(PRICING)}>>")).alias("vendor", "v")).where(~F.startswith("vendor", F.lit("_")))
    vendors = vendors.withColumn("vendor", F.initcap("vendor"))
    prices = vendors.select("vendor", F.explode("v.models").alias("model", "p")).where(~F.startswith("model", F.lit("_"))).select("vendor", "model", *[F.col(f"p.{n}").alias(n) for n in NAMES])
    defaults = vendors.select("vendor", *[F.col(f"v.default.{n}").alias(n) for n in NAMES], F.col("v.subscription_price").alias("subscription_price"))
    return prices, defaults


def _colons(fields: str) -> str:
    """A column list as struct fields."""
    return fields.replace("subscription_price ", "subscription_price: ").replace("models ", "models: ").replace("`default` ", "`default`: ")
