"""A training corpus from documents: clean, distinct, mixed by source and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard, mixing, packing, toxicity
from tidemark.llm._common import free_name, row_key, saved
from tidemark.llm.queries import BYTE_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels of these documents, does not reject."""
    return toxicity.clean_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.distinct_texts(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8: the one with the least id, null counting as greatest. Rows without words are in no group."""
    key, stays, again = (free_name(docs, x) for x in ("_key", "_stays", "_again"))
    keyed = docs.withColumn(key, row_key(docs, "doc_id", "text"))
    groups = jaccard.near_components(keyed.select(key, "text"), id_col=key, k=5, percent=80).where(F.col(key) == F.col("component_id"))
    groups = saved(groups.select(F.col(key).alias(stays), "n_shingles"), "near-stays")
    stay = groups.groupBy(stays).agg(((F.max("n_shingles") > 0) & (F.count("*") > 1)).alias(again))

    def staying(part: DataFrame) -> DataFrame:
        return keyed.join(part, F.col(key).eqNullSafe(F.col(stays)), "left_semi")

    far, repeated = staying(stay.where(~F.col(again))), stay.where(F.col(again))
    if not repeated.isEmpty():  # rows that repeat id and text
        far = far.unionByName(staying(repeated).dropDuplicates([key]))
    return far.drop(key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of the sources takes them."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL cannot express the toxicity model or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = saved(docs, "stage")
    return docs
