"""Blocks as Markdown, and where each block's lines are in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def block_markdown(columns: set[str]) -> Column:
    """Markdown of a block, by type; columns that a table lacks count as null."""
    c = lambda n: F.col(n) if n in columns else F.lit(None).cast("string")
    text = F.coalesce(c("text"), F.lit(""))
    line = lambda n: T.one_line(F.coalesce(c(n), F.lit("")))
    start = lambda n: T.escaped_start(line(n))
    alt = F.when(line("caption") != "", T.escaped_alt(line("caption"))).otherwise(c("type"))
    image = F.when(F.coalesce(c("image"), F.lit("")) != "", F.concat(F.lit("!["), alt, F.lit("]("), c("image"), F.lit(")")))
    lines = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n\n")
    listed = T.bullets(F.col("items")) if "items" in columns else F.lit("")
    code = F.regexp_replace(text, r"\s+\z", "")
    table = c("gfm")
    return (
        F.when(c("type") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(F.col("level"), F.lit(2)).cast("int")), F.lit(" "), T.one_line(text)))
        .when(c("type") == "equation", F.concat(F.lit("$$\n"), T.trimmed(F.coalesce(c("latex"), F.lit(""))), F.lit("\n$$")))
        .when(c("type") == "code", lines(start("caption"), F.concat(T.fence(text), F.coalesce(c("lang"), F.lit("")), F.lit("\n"), code, F.lit("\n"), T.fence(text))))
        .when(c("type") == "list", listed)
        .when(c("type") == "table", lines(start("caption"), F.coalesce(F.when(table != "", table), image), start("footnote")))
        .when(c("type") == "image", lines(image, start("caption"), start("footnote")))
        .when(c("type") == "chart", lines(image, start("caption"), T.trimmed(text), start("footnote")))
        .when(c("type") == "furniture", F.lit(""))
        .otherwise(T.escaped_start(T.one_line(text)))
    )


def anchored(blocks: DataFrame, order: str = "block_no") -> DataFrame:
    """Rendered blocks with their first and last line, from running sums of line counts: bodies are joined by blank lines."""
    b = blocks.withColumn("md", block_markdown(set(blocks.columns)))
    # Empty bodies count no line and go after the sums: a filter before them would be pushed down with the whole expression, which would run twice.
    b = b.withColumn("n_lines", F.when(F.col("md") != "", F.size(F.split("md", "\n"))).otherwise(0))
    w = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum(F.when(F.col("n_lines") > 0, F.col("n_lines") + 1).otherwise(0)).over(w) - 1
    return b.withColumn("last", last).where("n_lines > 0").withColumn("first", F.col("last") - F.col("n_lines") + 1)


def assembled(anchors: DataFrame, order: str = "block_no") -> DataFrame:
    """Whole Markdown of each document; one row a document, so a document must fit a row."""
    parts = F.array_sort(F.collect_list(F.struct(order, "md")))
    return anchors.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["md"]), "\n\n").alias("markdown"))


def marker_ranges(lines: DataFrame) -> DataFrame:
    """Line ranges of blocks from marked Markdown (doc_id, ln, line): a line [[b0001+b0002]] opens a stretch. Markers are
    taken out, runs of blank lines shrink to one, and a stretch's range ends with its last non-blank line."""
    w = Window.partitionBy("doc_id").orderBy("ln")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marker = F.col("line").rlike(r"^\[\[b\d{4,}(\+b\d{4,})*\]\]$")
    x = lines.withColumn("_mark", marker).withColumn("_span", F.sum(F.when(marker, 1).otherwise(0)).over(upto))
    ids = x.where("_mark").select("doc_id", "_span", F.regexp_extract_all("line", F.lit(r"b\d{4,}"), 0).alias("ids"))
    t = x.where("not _mark").withColumn("_blank", F.trim("line") == "")
    t = t.withColumn("_keep", ~F.col("_blank") | ~F.coalesce(F.lag("_blank").over(w), F.lit(True)))
    t = t.where("_keep").withColumn("new_ln", F.row_number().over(w))
    spans = t.where("not _blank").groupBy("doc_id", "_span").agg(F.min("new_ln").alias("first"), F.max("new_ln").alias("last"))
    out = ids.join(spans, ["doc_id", "_span"]).select("doc_id", F.explode("ids").alias("block_id"), "first", "last", "_span")
    return out.groupBy("doc_id", "block_id").agg(F.min_by("first", "_span").alias("first"), F.min_by("last", "_span").alias("last"))
