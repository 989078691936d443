"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of at
least ``min_chars`` code points that at least ``min_docs`` documents hold loses all its lines,
except in the document with the smallest id. All other lines stay, in their order.

The text moves once, in the last join, and only texts that lose a line go to a Python worker. Before it, only hashes, ids and positions move: the
distinct (hash, document) pairs are dealt by both, so that a line which every document holds is
counted in parts. The keys of all lines, a fraction of the text's size, are made once and kept in the
shared folder, and so are the repeated ones, so that the join of the two has a shuffle of its own on
either side and Spark can split its hot partitions.

Defined cases: a null or empty text is one empty line and stays; a null ``doc_id`` takes no part
(its lines neither count nor drop); rows that repeat a ``doc_id`` are one document for the count;
an empty table gives an empty table; other columns pass through, whatever they are called, unless
they are named like the result's, in which case the result's win.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, LOWER, UPPER, durable, slices, wide_hash


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc, text hash, position, h1, h2) of each line that is long enough to be dropped."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_doc"), F.xxhash64(text).alias("_text"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line")
    )
    key = F.translate(F.btrim("_line", F.lit(ASCII_SPACE)), UPPER, LOWER)
    h1, h2 = wide_hash(F.col("_key"))
    return lines.withColumn("_key", key).where(F.length("_key") >= min_chars).select("_doc", "_text", "_pos", h1.alias("_h1"), h2.alias("_h2"))


def repeated_keys(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """Keys that at least ``min_docs`` documents hold, each with the smallest such document."""
    return (
        lines.select("_h1", "_h2", "_doc").distinct().groupBy("_h1", "_h2")
        .agg(F.count("*").alias("_docs"), F.min("_doc").alias("_keeper"))
        .where(F.col("_docs") >= min_docs).select("_h1", "_h2", "_keeper")
    )


@F.arrow_udf(T.StringType())
def _without(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The texts without the lines at these positions; null where no text is given."""

    def kept(text: str | None, drop: list[int] | None) -> str | None:
        gone = set(drop or ())
        return text and "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    for texts, drops in parts:
        for batch in slices([pa.RecordBatch.from_arrays([texts, drops], ["text", "drop"])]):
            yield pa.array(map(kept, batch["text"].to_pylist(), batch["drop"].to_pylist()), pa.string())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with n_lines (before), n_dropped and kept_text."""
    lines = durable(line_keys(docs, id_col, text_col, min_chars))
    drops = (
        lines.join(durable(repeated_keys(lines, min_docs)), ["_h1", "_h2"]).where(F.col("_doc") > F.col("_keeper"))
        .groupBy("_doc", "_text").agg(F.collect_set("_pos").alias("_drop"))
    )
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"))
    joined = rows.join(drops, (F.col("_id") == F.col("_doc")) & (F.col("_hash") == F.col("_text")), "left")
    text, changed = F.coalesce(F.col("_row")[text_col], F.lit("")), F.col("_drop").isNotNull()
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n")))
    return joined.select(
        *(F.col("_row")[c].alias(c) for c in own), (breaks + 1).cast("long").alias("n_lines"), F.when(changed, F.size("_drop")).otherwise(0).cast("long").alias("n_dropped"),
        F.when(changed, _without(F.when(changed, text), F.col("_drop"))).otherwise(text).alias("kept_text"),
    )
