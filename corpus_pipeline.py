"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lamina.llm import common, minhash, packing, quality_net, quality_rules, secret_scan


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the rules learn from the labelled rows of docs."""
    return quality_rules.keep_good(docs, quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled rows of documents as they were before any stage: what is left of them is nearly all good."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_net.keep_good(docs, quality_net.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    return minhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with found secrets masked in its text."""
    return secret_scan.mask_secrets(docs, secret_scan.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of fixed length."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("minhash_dedup", near_dedup),
    ("secret_scan", secrets),
    ("packing", packed),
]

#: SQL can express neither the learned stages nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages the rows lie in the cluster's shared checkpoint folder."""
    folder = common.shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/pipeline-{uuid.uuid4().hex}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        common.let_go(spark)  # what the stage left at the driver and on disk
    return docs
