"""A training-data pipeline over ``documents``: quality, repeated lines, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``; all but the last return the columns of ``documents``. Every
stage is one of the operators of ``tallyspark.llm`` and its decision takes effect: documents that
the quality classifier rejects go, repeated lines go, one document of each near-duplicate group
stays, and the last stage returns what packing makes of the rest. The near-duplicate stage links
texts of 0.8 or more over five words: op1's grid join, at a radius that covers 0.8, and the exact sets (see ``jaccard_dedup``).

Defined cases: a null or empty text is scored, has no lines to lose, is a copy of other texts
without words, and is packed as the end id alone. Rows that repeat a ``doc_id`` are one document
and stay or go together. Rows without an id are documents each: they are scored and packed like
others, keep all their lines, go if they are near-duplicates of a document with an id, and of those
that are near-duplicates of each other alone one stays. An empty table gives an empty table. Extra
columns pass through the first three stages unchanged, whatever they are called; of a document's own
columns only ``text`` and ``n_chars`` change.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import jaccard_dedup, line_dedup, packing, quality
from tallyspark.llm.common import durable, shared_folder, table

#: Least score of a document that stays.
LEAST_SCORE = 0.7


def _fresh(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex}"


def _own(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever their names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier scores at least ``LEAST_SCORE``; texts do not move."""
    score = _fresh("score")
    train = quality.with_statistics(quality.labelled(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))
    model = quality.fit(durable(train.select("stats", "y")))
    scored = quality.score_texts(docs, model, name=score)
    return scored.where(F.col(score) >= LEAST_SCORE).select(*_own(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds."""
    row = _fresh("row")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias(row)))
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col(row)["n_chars"]) if "n_chars" in rest else None
    made = {"doc_id": F.col("doc_id"), "text": text, "n_chars": chars}
    return out.select(*(made.get(c, F.col(row)[c]).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by Jaccard similarity of at least 0.8 over five-word shingles."""
    found = durable(jaccard_dedup.near_duplicates(docs.select("doc_id", "text")))
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(*_own(docs))
    key, place = _fresh("key"), _fresh("place")
    lone = found.where(F.col("component_id").isNull() & (F.col("text_key") == F.col("root_key"))).select(F.col("text_key").alias(key)).distinct()
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have neither order nor hash
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*plain)))
    nameless = docs.where(F.col("doc_id").isNull()).withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(place, first).where(F.col(place) == 1)
    return named.unionByName(nameless.join(lone, key).select(*_own(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 4096 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", keep_good), ("line dedup", drop_repeated_lines), ("near-dedup", drop_near_duplicates), ("best-fit packing", pack)]

#: The classifier's scores, hashes and the genetic algorithm have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table; what lies between them is in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
