"""The usage report: an aggregated breakdown with numbers first and label columns for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import compact, price_label, short_model, thousands
from ..operators.breakdown import percent_of_total
from ..operators.cost import priced_breakdown
from ..operators.filters import last_days, of_vendor, share_threshold


def usage_report(ledger: DataFrame, prices: DataFrame, defaults: DataFrame, names: DataFrame, days: float = 7, vendor: str | None = None, least: float = 0.01, by_effort: bool = False) -> DataFrame:
    """Per vendor and model, and effort where asked, of the last days: numbers, percent, cost, and labels."""
    recent = of_vendor(last_days(ledger, days, by="vendor"), vendor)
    groups = share_threshold(priced_breakdown(recent, prices, defaults, ["vendor", "model"] + ["effort"] * by_effort), least=least)
    out = percent_of_total(groups, "total_tokens", "percent").join(names.select("vendor", "model", "short_name"), ["vendor", "model"], "left")
    return out.withColumns({
        "name": short_model(F.col("model"), F.col("effort") if by_effort else F.lit(None).cast("string"), F.col("short_name")), "total_label": thousands(F.col("total_tokens")),
        "compact_label": compact(F.col("total_with_cache")), "cost_label": price_label(F.col("total_cost")),
    }).drop("short_name")
