"""A corpus pipeline over `documents`: each stage works on all that the one before kept.

1. quality: documents that the quality classifier rejects go;
2. near_copies: of each SimHash near-duplicate group the document with the smallest id stays;
3. repeats: byte strings of 100 and more that occur earlier are cut out of the texts;
4. mix: documents are repeated or left out so that sources come near their target weights;
5. pack: documents are dealt into length buckets and token-budget batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docproof.llm import mixing, packing, quality, simhash, suffixes
from docproof.llm.store import settled


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.5)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("repeats", repeats_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: Fingerprints, the classifier and the dynamic program are not expressible in SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
