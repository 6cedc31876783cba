"""Cleaning pipeline over documents: toxicity, near-duplicates, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import BATCH, stored, table
from loomgraph.llm.decontamination import contained_items
from loomgraph.llm.near_dedup import near_duplicates
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.toxicity import toxicity_filter, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the ordinal model calls toxic.  A null or empty text is not toxic; rows
    are judged one by one, those without doc_id or with one that others have too like all others."""
    return toxicity_filter(docs, train(docs, table(spark, sf_dir, "labels")))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Stored rows with a key of their own, and its name."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def without(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    return rows.join(stored(dropped.select(key), "dropped"), key, "left_anti").drop(key)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (similarity 0.8 or more of five-word shingles), that
    with the smallest doc_id; rows without doc_id come last, and of equal ones any stays.  Rows are
    linked by their texts alone, so that different texts under one doc_id all stay, and copies
    without doc_id go; rows without words are linked with nothing and stay."""
    rows, key = keyed(docs)
    judged = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), percent=80)
    judged = stored(judged.select(F.col("doc_id").alias(key), "component_id"), "judged")
    named = judged.join(rows.select(key, "doc_id"), key)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first"))
    return without(rows, key, judged.join(first.select(f"first.{key}"), key, "left_anti")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text contains an item of the benchmark, whatever their doc_id; rows without
    words contain none."""
    rows, key = keyed(docs)
    found = contained_items(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, key, found.select(F.col("doc_id").alias(key)).distinct()).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all rows into sequences of 4096 tokens, one row for each piece; a null or empty text has
    only the end id, equal rows are packed as often as they occur."""
    return pack_documents(docs, "word_bpe_49k.json", 1, memo=150_000, batch=BATCH)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Learned scores and packing cannot be written in SQL.
ORACLE_SQL: str | None = None
