"""Heading structure: priors, the one-title rule, clamped levels, breadcrumbs, sections. Loops of the usual
implementation in closed form, as windows over a document's headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _before(*order: str):
    return Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def priors(blocks: DataFrame) -> DataFrame:
    """Likely level of each heading, and of paragraphs that look like missed ones: numbering rules, the first
    unnumbered top heading of pages 1 and 2 is the title, all others are of level 2."""
    c = blocks.where((F.col("type") == "heading") | T.missed_heading(F.col("type"), F.col("text")))
    c = c.withColumn("depth", T.numbering_depth(T.one_line(F.col("text"))))
    fits = F.col("depth").isNull() & (F.coalesce("level", F.lit(0)) == 1) & (F.col("page") <= 2)
    nth = F.sum(F.when(fits, 1).otherwise(0)).over(_before("block_no"))
    level = F.when(F.col("depth").isNotNull(), F.least(F.lit(6), F.col("depth") + 1)).when(fits & (nth == 1), 1).otherwise(2)
    return c.withColumn("prior", level).drop("depth")


def one_title(headings: DataFrame, level: str = "level") -> DataFrame:
    """Later headings of level 1 become level 2."""
    seen = F.sum(F.when(F.col(level) == 1, 1).otherwise(0)).over(_before("block_no"))
    return headings.withColumn(level, F.when((F.col(level) == 1) & (seen > 1), 2).otherwise(F.col(level)))


def clamped(headings: DataFrame, level: str = "level") -> DataFrame:
    """No heading more than one level below the heading before it: i plus the running minimum of level minus i."""
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no"))
    h = headings.withColumn("_i", i)
    return h.withColumn("clamped", (F.col("_i") + F.min(F.col(level) - F.col("_i")).over(_before("block_no"))).cast("int")).drop("_i")


def title_first(blocks: DataFrame) -> DataFrame:
    """Blocks with a title in front. The first level-1 heading moves there, unless a heading or more than three
    blocks stand before it; then it becomes level 2 and, as where there is none, a synthetic b0000 leads."""
    w = Window.partitionBy("doc_id")
    at = F.min(F.when((F.col("type") == "heading") & (F.col("level") == 1), F.col("block_no"))).over(w)
    b = one_title(blocks.withColumn("_at", at))
    before = F.sum(F.when((F.col("block_no") < F.col("_at")) & (F.col("type") != "furniture"), 1).otherwise(0)).over(w)
    heads = F.sum(F.when((F.col("block_no") < F.col("_at")) & (F.col("type") == "heading"), 1).otherwise(0)).over(w)
    b = b.withColumn("_moves", F.col("_at").isNotNull() & (heads == 0) & (before <= 3))
    own = F.col("_moves") & (F.col("block_no") == F.col("_at"))
    b = b.withColumn("level", F.when(F.col("level").isNotNull() & (F.col("level") == 1) & ~own, 2).otherwise(F.col("level"))).withColumn("_first", F.when(own, 0).otherwise(1))
    made = blocks.groupBy("doc_id").agg(F.min("page").alias("page"), F.min_by(F.when(F.col("type") == "heading", T.heading_text(F.col("text"))), F.when(F.col("type") == "heading", F.col("block_no"))).alias("text"))
    made = made.join(b.where("_moves").select("doc_id").distinct(), "doc_id", "left_anti")
    made = made.select("doc_id", "page", F.lit("heading").alias("type"), F.lit(1).alias("level"), F.coalesce("text", F.lit("Untitled")).alias("text"), F.lit("b0000").alias("block_id"), F.lit(0).alias("_first"), F.lit(0).alias("block_no"), F.lit(True).alias("synthetic"))
    out = b.drop("_at", "_moves").unionByName(made, allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("_first", "block_no")
    return out.withColumn("shaped_no", F.row_number().over(order)).drop("_first")


def breadcrumbs(blocks: DataFrame) -> DataFrame:
    """Each block's path of headings: of each level the last heading that no shallower one follows."""
    b, path = blocks, []
    w = _before("block_no")
    for n in range(1, 7):
        is_n = (F.col("type") == "heading") & (F.col("level") == n)
        b = b.withColumn(f"_t{n}", F.last(F.when(is_n, F.col("text")), True).over(w)).withColumn(f"_o{n}", F.last(F.when(is_n, F.col("block_no")), True).over(w))
    for n in range(1, 7):
        above = [F.coalesce(F.col(f"_o{k}"), F.lit(-1)) for k in range(1, n)]
        live = F.col(f"_o{n}").isNotNull()
        if above:
            live &= F.col(f"_o{n}") > (F.greatest(*above) if len(above) > 1 else above[0])
        path.append(F.when(live, F.col(f"_t{n}")))
    b = b.withColumn("heading_path", F.filter(F.array(*path), lambda x: x.isNotNull()))
    return b.drop(*[f"_{k}{n}" for k in "to" for n in range(1, 7)])


def section_ends(headings: DataFrame, totals: DataFrame, line: str = "first") -> DataFrame:
    """Where each heading's section ends: the line before the next heading no deeper, else the last."""
    h, nxt = headings, []
    later = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(1, Window.unboundedFollowing)
    for n in range(1, 7):
        h = h.withColumn(f"_n{n}", F.min(F.when(F.col("level") <= n, F.col(line))).over(later))
        nxt.append(F.when(F.col("level") == n, F.col(f"_n{n}")))
    return h.join(totals, "doc_id").withColumn("last", F.coalesce(F.coalesce(*nxt) - 1, "total")).drop(*[f"_n{n}" for n in range(1, 7)])


def filled_pages(lines: DataFrame, direct: Column) -> Column:
    """A line's page: its own, else the last before it, else the document's smallest."""
    w = Window.partitionBy("doc_id")
    return F.coalesce(F.last(direct, True).over(w.orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)), F.min(direct).over(w))


def line_pages(anchors: DataFrame, totals: DataFrame, order: str = "block_no") -> DataFrame:
    """(doc_id, ln, page) of every line up to totals (doc_id, total), from anchors (doc_id, first, last, page): a line has
    the page of its first anchor, others that of the line before, lines before any the document's smallest."""
    own = anchors.where("page > 0").select("doc_id", order, "page", F.explode(F.sequence("first", "last")).alias("ln"))
    own = own.groupBy("doc_id", "ln").agg(F.min_by("page", order).alias("direct"))
    every = totals.where("total > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))).alias("ln"))
    x = every.join(own, ["doc_id", "ln"], "left").withColumn("page", filled_pages(None, F.col("direct")))
    return x.where("page is not null").select("doc_id", "ln", "page")
