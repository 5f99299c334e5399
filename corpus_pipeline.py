"""From raw documents to packed training sequences: four operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import decontaminate, near_copies, packing, quality, scratch

def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs.select("doc_id", "text"), labels)
    return quality.classify(docs, model).where("predicted = 1").select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: the one with the smallest id."""
    return near_copies.deduplicate(docs, rounds=2)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    leaks = decontaminate.decontaminate(keyed, items, "key").where("n_hit > 0").select(F.col("key.doc_id").alias("leak_id"), F.col("key.h").alias("leak_h")).distinct()
    # Identical rows share their verdict, so id and text stand for the row.
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("leak_id")) & (F.xxhash64("text") == F.col("leak_h")), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of 1024 tokens with the sources mixed evenly."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "ids")


STAGES = [("quality", keep_good), ("simhash", keep_one_copy), ("decontamination", drop_leaks), ("packing", pack)]

#: Neither fingerprints nor the classifier can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
