"""Prices, costs and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .breakdown import COUNTERS, model_breakdown, summed, vendor_totals

#: The price that each counter is charged at; the fourth depends on what it counts.
COSTS = {"input_cost": ("input_tokens", "input"), "output_cost": ("output_tokens", "output"), "cache_read_cost": ("cache_read_tokens", "cache_input")}


def with_prices(groups: DataFrame, prices: DataFrame, defaults: DataFrame) -> DataFrame:
    """Price columns by vendor and model, else the vendor's default. Spark broadcasts the small side by its size."""
    names = ["input", "output", "cache_input", "cache_output"]
    one = prices.select("vendor", "model", *[F.col(n).alias(f"_{n}") for n in names])
    other = defaults.select("vendor", *[F.col(n).alias(f"_d_{n}") for n in names])
    joined = groups.join(one, ["vendor", "model"], "left").join(other, "vendor", "left")
    return joined.withColumns({f"price_{n}": F.coalesce(f"_{n}", f"_d_{n}") for n in names}).drop(*[f"_{n}" for n in names], *[f"_d_{n}" for n in names])


def _money(tokens: Column, price: Column) -> Column:
    """Exact product of a long and a decimal, divided once."""
    return (tokens * price).cast("double") / 1e6


def extra_price() -> Column:
    """Cache creation has its own price; reasoning and thinking are charged as output."""
    return F.when(F.col("extra_kind") == "cache_creation", F.col("price_cache_output")).otherwise(F.col("price_output"))


def with_costs(groups: DataFrame, prices: DataFrame, defaults: DataFrame) -> DataFrame:
    """``groups`` (vendor, model, extra_kind, counters) with the cost of each counter, of input and output, of the rest, and in all."""
    priced = with_prices(groups, prices, defaults)
    costs = {name: _money(F.col(c), F.col(f"price_{p}")) for name, (c, p) in COSTS.items()} | {"extra_cost": _money(F.col("extra_tokens"), extra_price())}
    return priced.select(*groups.columns, *[v.alias(k) for k, v in costs.items()]).withColumns({
        "io_cost": F.col("input_cost") + F.col("output_cost"), "cache_cost": F.col("cache_read_cost") + F.col("extra_cost"),
        "total_cost": F.col("input_cost") + F.col("output_cost") + F.col("cache_read_cost") + F.col("extra_cost"),
    })


def cost_by_type(ledger: DataFrame, prices: DataFrame, defaults: DataFrame) -> DataFrame:
    """Per vendor and model: the costs. Grouped before it is priced."""
    return with_costs(ledger.groupBy("vendor", "model", "extra_kind").agg(*summed()), prices, defaults).drop("extra_kind", *COUNTERS)


def priced_breakdown(ledger: DataFrame, prices: DataFrame, defaults: DataFrame, key: list[str] = ["vendor", "model"]) -> DataFrame:  # noqa: B006
    """Per vendor and model (and what else ``key`` names): messages, counters, totals and total cost, from one pass over the ledger."""
    groups = with_costs(model_breakdown(ledger, [*key, "extra_kind"]), prices, defaults)
    numbers = ["messages", *COUNTERS, "total_tokens", "total_with_cache", "total_cost"]
    return groups.groupBy(*key).agg(*[F.sum(c).alias(c) for c in numbers])


def cost_share(costs: DataFrame, parts: list[str] = ["input_cost", "output_cost", "cache_read_cost", "extra_cost"]) -> DataFrame:  # noqa: B006
    """(part, cost, percent): what each part is of all cost."""
    total = costs.agg(*[F.coalesce(F.sum(F.col(p).cast("decimal(38,12)")), F.lit(0)).alias(p) for p in parts])
    flat = total.unpivot([], parts, "part", "cost")
    all_cost = F.sum("cost").over(Window.partitionBy())
    return flat.select("part", F.col("cost").cast("double").alias("cost"), F.when(all_cost > 0, (F.col("cost") * 100).cast("double") / all_cost.cast("double")).otherwise(0.0).alias("percent"))


def api_cost(ledger: DataFrame, prices: DataFrame, defaults: DataFrame) -> DataFrame:
    """(vendor, api_cost): one exact sum per vendor."""
    priced = with_prices(ledger.groupBy("vendor", "model", "extra_kind").agg(*summed()), prices, defaults)
    amount = sum((F.col(c) * F.col(f"price_{p}") for c, p in COSTS.values()), F.col("extra_tokens") * extra_price())
    return priced.groupBy("vendor").agg((F.sum(amount).cast("double") / 1e6).alias("api_cost"))


def _over(value: Column, by: Column) -> Column:
    return F.coalesce(F.try_divide(value, by), F.lit(0.0))


def projection(ledger: DataFrame, prices: DataFrame, defaults: DataFrame, days: float) -> DataFrame:
    """Per vendor: daily, weekly and monthly cost, saving against the subscription, subscription per million tokens."""
    joined = vendor_totals(ledger).join(api_cost(ledger, prices, defaults), "vendor").join(defaults.select("vendor", F.col("subscription_price").cast("double").alias("subscription")), "vendor")
    daily = _over(F.col("api_cost"), F.lit(float(days)))
    monthly_tokens = _over(F.col("tokens").cast("double"), F.lit(float(days))) * 30
    return joined.select(
        "vendor", "tokens", "api_cost", daily.alias("daily_cost"), (daily * 7).alias("weekly_cost"), (daily * 30).alias("monthly_cost"),
        (daily * 30 - F.col("subscription")).alias("saving"), _over(F.col("subscription"), monthly_tokens / 1e6).alias("cost_per_mtok"),
    )


def weighted_cost(ledger: DataFrame, prices: DataFrame, defaults: DataFrame, days: float) -> DataFrame:
    """One row: cost per million tokens weighted by the vendors' share of tokens, and the saving of all; zeros for an empty ledger."""
    each = projection(ledger, prices, defaults, days)
    return each.agg(
        _over(F.sum(F.col("tokens") * F.col("cost_per_mtok")), F.sum("tokens").cast("double")).alias("weighted_cost_per_mtok"),
        F.coalesce(F.sum("saving"), F.lit(0.0)).alias("total_saving"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )


assert len(COSTS) + 1 == len(COUNTERS)
