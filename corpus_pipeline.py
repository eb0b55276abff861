"""The corpus pipeline: five operators of mediaquarry.llm in a row, each over all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's result as Parquet in the shared folder and reads it for the next.
Rows with a null doc_id can not be matched with others; they pass the near-duplicate and benchmark stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediaquarry.llm import decontam, minhash, mixing, quality, sharding
from mediaquarry.llm.common import Scratch, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go.

    Null and empty texts are scored as texts without words. Each of several equal rows is scored alike, so they stay or go
    together; an empty table stays empty. Other columns, whatever their names, pass through.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one of the least doc_id, stays: five-word shingles, similarity 0.8 or more.

    Documents without words are near nothing and stay, as do rows without a doc_id. Rows of one doc_id stay or go
    together, so a repeated row that stays is still repeated.
    """
    return minhash.keep_one(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go, exact or edited (alignment of half an item's score or more).

    Null and empty texts, and rows without a doc_id, stay; an empty benchmark keeps all. Rows of one doc_id go together.
    """
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once, or up to three times.

    Documents without words count nothing and stay as the operator's rule has it; null sources are a source of
    their own. Equal rows are drawn as one document of their doc_id.
    """
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of near-equal bytes, each row with its place and, as struct `row`, the document; equal texts share a shard.

    Null texts take 8 bytes, as empty ones do. Every row of the input has one place, repeated rows several.
    """
    return sharding.shard_rows(docs, whole=True)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources), ("shard", shard)]

#: The classifier and the near-duplicate groups can not be put in SQL; tests hold run() to a brute-force model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = kept
    return docs
