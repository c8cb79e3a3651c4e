"""Sources and sinks: files, layout items, Markdown, HTML pages, catalogs, chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B

# Suffixes that ingestion takes, and its size limit.
SUFFIXES = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "html", "htm", "png", "jpg", "jpeg", "webp", "bmp", "gif", "md")
MAX_BYTES = 200 * 1024 * 1024
# End of fixed values.


def files(spark: SparkSession, path: str) -> DataFrame:
    """Known files below a folder without hidden ones: path, length, suffix and content identity."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    f = f.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    f = f.where(F.col("suffix").isin(*SUFFIXES) & ~F.col("path").rlike(r"/\.[^/]") & (F.col("length") <= MAX_BYTES))
    return f.withColumn("doc_id", F.substring(F.sha2("content", 256), 1, 16))


def result_files(listing: DataFrame) -> DataFrame:
    """Of each root and kind the shallowest result file; second-version lists are left out."""
    depth = F.size(F.split("path", "/"))
    return listing.where(~F.col("path").contains("_v2")).groupBy("root", "kind").agg(F.min_by("path", F.struct(depth, "path")).alias("path"))


def layout_items(spark: SparkSession, path: str) -> DataFrame:
    """Layout-parser item lists, one JSON array a file; broken records are null rows, never a failed job."""
    raw = spark.read.schema(B.ITEM_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return raw.withColumn("file", F.col("_metadata.file_path")).withColumn("pos", F.monotonically_increasing_id())


def page_sizes(spark: SparkSession, path: str) -> DataFrame:
    s = "pdf_info array<struct<page_idx:int,page_size:array<double>>>, _backend string, _version_name string"
    raw = spark.read.schema(s).option("multiLine", "true").json(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.explode("pdf_info").alias("p")).select("file", "p.page_idx", F.col("p.page_size").alias("size"))


def html_pages(pages: DataFrame) -> DataFrame:
    """Blocks of web pages (page_id, html)."""
    from ..functions.python import html_blocks

    b = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(html_blocks(F.col("html"))).alias("pos", "b"))
    return b.select("doc_id", F.lit(1).alias("page"), (F.col("pos") + 1).alias("block_no"), "b.*").withColumn("block_id", F.format_string("b%04d", "block_no"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines catalog, its last line of each id."""
    from ..operators.catalog import latest

    return latest(spark.read.json(path).withColumn("seq", F.monotonically_increasing_id())).drop("seq")


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.orderBy("id").coalesce(1).write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("lang").parquet(path)


def translation_items(payloads: DataFrame) -> DataFrame:
    """Per-page translation payloads (doc_id, page, payload as JSON) as items with defaults."""
    s = "array<struct<id:string,bbox:array<double>,source:string,text:string,unit_text:string,unit:string,kind:string,status:string,role:string>>"
    i = payloads.select("doc_id", "page", F.explode(F.from_json("payload", s)).alias("i")).select("doc_id", "page", "i.*")
    return i.withColumn("kind", F.coalesce("kind", F.lit("text"))).withColumn("status", F.coalesce("status", F.lit("ok"))).withColumn("text", F.coalesce("text", F.lit("")))
