"""Streaming ingestion of files into an index. An extension: the engine's own semantics have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25


def documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string") -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def start(stream: DataFrame, out: str, checkpoint: str):
    """Postings of each micro-batch, written under its number: a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        index = bm25.build(batch.select(F.col("doc_id").alias("chunk_id"), "text"))
        index.postings.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
