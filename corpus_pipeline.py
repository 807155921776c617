"""A training-data pipeline over ``documents``: quality, near-duplicates, personal data, packing.

Each stage works on all rows its predecessor kept.  All stages but the last return the
columns of ``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import durable
from tamarack.llm.near import one_of_each_class
from tamarack.llm.packing import pack_documents
from tamarack.llm.pii import redact
from tamarack.llm.quality import keep_quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules or the perplexity bands reject go."""
    return keep_quality(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return one_of_each_class(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    done = redact(docs)
    return done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in sequences of at most 2048 tokens, a row for each piece."""
    return pack_documents(docs)


STAGES = [("quality rules", quality_stage), ("near duplicates", near_stage), ("personal data", pii_stage), ("packing", packing_stage)]

#: No stage can be said in SQL.  The rows of a small fixture are held against brute force, stage by stage, by the
#: pipeline's test; each stage's operator is held against it by its own tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = durable(docs)
    return docs
