"""A training corpus from raw documents, in stages that are each written and read again.

Columns stay those of documents; the last stage adds the shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semlattice.llm import decontam, mixing, neardup, sharding
from semlattice.llm.common import saved, table
from semlattice.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, predicts toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return neardup.keep_one(docs, neardup.NearDup(k=5, percent=80, symbols=96))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, as it is or asked anew, go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weights 1, 2, 3, repeating: each document as often as the mix draws it, three times at most."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of 40 that doc_id leads to, as column shard."""
    return sharding.with_shards(docs, 40)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing_sources), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs


#: Scores and signatures can't be expressed in SQL; the tests compare the rows with those of five stages in plain Python.
ORACLE_SQL = None
