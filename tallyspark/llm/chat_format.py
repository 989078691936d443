r"""Chat formatting, with DataFrame functions only: render, reparse, compare, escape until identical.

Grammar of a rendered conversation::

    conversation := turn*
    turn         := "### " role ":\n" text "\n</turn>\n"

Neither role nor text may hold ``###``, ``</turn>`` or a bare backslash, and a role no ``:`` or
line feed. A turn is first rendered as it is and parsed again; if the parser does not give the
same role and text, its control strings are escaped (backslash ``\b``, ``#`` of ``###`` ``\h``,
``<`` of ``</turn>`` ``\l``, and in roles ``:`` ``\c`` and line feed ``\e``) and it is parsed once
more. Every backslash of an escaped text starts one of these codes, so unescaping is exact. The
whole conversation is then split and parsed again; the result says whether it equals its source.

Turns come in the order of ``turn`` (null first), then role and text. Null roles and texts count
as empty; a null ``conv_id`` is a conversation of its own; repeated rows are repeated turns; an
empty table gives an empty table; extra columns are ignored. One conversation is one output value,
so its turns meet in one task by the nature of the result; its own length is the only bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, MID, TAIL = "### ", ":\n", "\n</turn>\n"
END = "</turn>\n"
#: What is escaped, in this order, and by what; unescaping goes backwards.
ESCAPES = [("\\", "\\b"), ("###", "\\h\\h\\h"), ("</turn>", "\\l/turn>")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c"), ("\n", "\\e")]
CODES = [("\\h", "#"), ("\\l", "<"), ("\\c", ":"), ("\\e", "\n"), ("\\b", "\\")]
FORBIDDEN = r"###|</turn>|\\(?![bhlce])"


def _replace(value: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(MID), text, F.lit(TAIL))


def _parsed(chunk: Column) -> Column:
    """Role and text of a turn without its END; both null where the grammar does not hold."""
    at = F.locate(MID, chunk)
    role = F.substring(chunk, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)
    text = F.substring(chunk, at + len(MID), F.length(chunk) - at - len(MID))
    good = F.startswith(chunk, F.lit(HEAD)) & (at > len(HEAD)) & F.endswith(chunk, F.lit("\n")) & (F.length(chunk) > at + 1)
    fine = good & ~F.rlike(role, F.lit(FORBIDDEN)) & ~F.rlike(text, F.lit(FORBIDDEN))
    return F.struct(F.when(fine, _replace(role, CODES)).alias("role"), F.when(fine, _replace(text, CODES)).alias("text"))


def _same(rendered: Column, role: Column, text: Column) -> Column:
    chunks = F.split(rendered, END, -1)
    turn = _parsed(F.element_at(chunks, 1))
    return (F.size(chunks) == 2) & turn["role"].eqNullSafe(role) & turn["text"].eqNullSafe(text)


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, loss spans (start, length; code points from 0) and whether it parses back."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    role, text = F.col("role"), F.col("text")
    rows = rows.withColumn("_plain", _render(role, text)).withColumn("_ok", _same(F.col("_plain"), role, text))
    r, t = F.when(F.col("_ok"), role).otherwise(_replace(role, ROLE_ESCAPES)), F.when(F.col("_ok"), text).otherwise(_replace(text, ESCAPES))
    rows = rows.select("conv_id", "turn", "role", "text", _render(r, t).alias("_out"), (F.length(r) + len(HEAD) + len(MID)).alias("_at"), F.length(t).alias("_len"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum(F.length("_out")).over(before), F.lit(0)))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_start", "role", "text", "_out", "_at", "_len"))).alias("_t"))
    source = F.transform("_t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    loss = F.transform(
        F.filter("_t", lambda x: x["role"] == loss_role),
        lambda x: F.struct((x["_start"] + x["_at"]).alias("start"), x["_len"].cast("long").alias("length")),
    )
    convs = convs.select("conv_id", F.array_join(F.transform("_t", lambda x: x["_out"]), "").alias("formatted"), loss.alias("loss_spans"), source.alias("_source"))
    return convs.withColumn("_back", parse_chat(F.col("formatted"))).select(
        "conv_id", "formatted", "loss_spans", F.col("_source").eqNullSafe(F.col("_back")).alias("round_trip_ok")
    )


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) that a rendered conversation holds."""
    chunks = F.split(formatted, END, -1)
    return F.transform(F.slice(chunks, F.lit(1), F.size(chunks) - 1), _parsed)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: _replace(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")), CODES)), "")
