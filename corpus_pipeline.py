"""The corpus pipeline: harmful documents go, copies and near copies go, sources are mixed and the mix is packed.

Each stage is a name and a function of (spark, docs, sf_dir); run() applies them to the table documents, writing and
rereading Parquet between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithosift.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from lithosift.llm.common import folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut; the model learns from the labelled documents given here."""
    return toxicity.keep_harmless(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy of a document that training consumes, in training order."""
    return mixing.mix(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, numbered as sequences; a document that is mixed in twice is packed twice."""
    return packing.number(packing.digest(packing.pieces(docs)))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_documents)]

#: SQL has neither the trained model nor the signatures, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = folder(spark)
    for name, stage in STAGES[:-1]:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
