"""A training-data pipeline over the documents table, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on every document that its predecessor kept, and its decisions take
effect: rejected and duplicate documents go, secrets are replaced, the mix repeats or leaves out documents. All but
the last return the columns of documents; packing returns a row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeframe.llm import classifier, mixing, packing, secrets, simhash
from gaugeframe.llm.common import fresh_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("secret scan", secret_scan), ("mixture", mixture), ("packing", packed)]

#: A fitted model, components and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
