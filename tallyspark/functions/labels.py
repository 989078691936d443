"""Label columns for people; oracle-checked queries compare numbers, not labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def compact(n: Column) -> Column:
    """1.23K, 12.3M, 123B; whole numbers below a thousand."""
    out = n.cast("long").cast("string")
    for unit, suffix in ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        v = n / unit
        text = F.when(v >= 100, v.cast("long").cast("string")).when(v >= 10, F.format_string("%.1f", v.cast("double"))).otherwise(F.format_string("%.2f", v.cast("double")))
        out = F.when(n >= unit, F.concat(text, F.lit(suffix))).otherwise(out)
    return out


def axis_label(n: Column) -> Column:
    """Five characters: a number with K or M."""
    out = F.format_string("%5d", n.cast("long"))
    for unit, suffix in ((1e3, " K"), (1e6, " M")):
        v = (n / unit).cast("double")
        text = F.when(v >= 100, F.format_string("%3d", v.cast("long"))).when(v >= 10, F.format_string(" %2d", v.cast("long"))).otherwise(F.format_string("%3.1f", v))
        out = F.when(n >= unit, F.concat(text, F.lit(suffix))).otherwise(out)
    return out


def with_percent(n: Column, total: Column) -> Column:
    share = F.when(total > 0, n / total * 100).otherwise(0.0).cast("double")
    return F.concat(thousands(n), F.format_string("(%4.1f%%)", share))


def price_label(v: Column) -> Column:
    """Two decimals from one cent upward, else one significant digit."""
    v = v.cast("double")
    places = F.least(F.ceil(-F.log10(v)).cast("int"), F.lit(12))
    digit = F.round(v * F.pow(F.lit(10.0), places)).cast("long").cast("string")
    small = F.concat(F.lit("$0."), F.lpad(digit, places, "0"))
    return F.when(v >= 0.01, F.concat(F.lit("$"), F.format_string("%.2f", v))).when(v <= 0, "$0.00").otherwise(small)


def effort_letter(effort: Column) -> Column:
    return F.when(effort == "xhigh", "XH").otherwise(F.upper(F.substring(effort, 1, 1)))


def short_model(model: Column, effort: Column, known: Column | None = None) -> Column:
    """The name from the lookup, else the first 12 characters, 10 before an effort; the effort as a letter in brackets."""
    known = F.lit(None).cast("string") if known is None else known
    return F.when(effort.isNull(), F.coalesce(known, F.substring(model, 1, 12))).otherwise(F.concat(F.coalesce(known, F.substring(model, 1, 10)), F.lit("("), effort_letter(effort), F.lit(")")))
