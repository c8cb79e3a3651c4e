"""The block model: typed, positioned blocks of documents, numbered in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Names of source kinds, and of kinds that a search may ask for.
FURNITURE = ("header", "footer", "page_number", "aside_text", "phonetic")
ALIASES = {
    "figure": ("image", "chart"),
    "image": ("image", "chart"),
    "chart": ("chart",),
    "table": ("table",),
    "equation": ("equation",),
    "formula": ("equation",),
    "heading": ("heading",),
    "code": ("code",),
    "list": ("list",),
    "paragraph": ("paragraph",),
}
# End of fixed values.
ITEM_SCHEMA = (
    "type string, text string, text_level int, text_format string, bbox array<int>, page_idx int, img_path string, image_caption array<string>, image_footnote array<string>, "
    "seal_caption array<string>, seal_footnote array<string>, chart_caption array<string>, chart_footnote array<string>, table_caption array<string>, table_footnote array<string>, "
    "code_caption array<string>, table_body string, code_body string, sub_type string, list_items array<string>, content string"
)


def numbered(blocks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Block ids b0001, b0002, ... within each document, in reading order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return blocks.withColumn("block_no", n).withColumn("block_id", F.format_string("b%04d", F.col("block_no")))


def normalised(items: DataFrame, page_offset: int = 0) -> DataFrame:
    """Layout items (doc_id, pos, and columns of ITEM_SCHEMA) as blocks; items without content are dropped, tables kept."""
    t = F.col("type")
    none = F.array().cast("array<string>")
    raw = T.trimmed(F.coalesce("text", F.lit("")))
    first = lambda *cs: T.trimmed(F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cs], F.lit("")))
    text = F.when(t.isin("text", "page_footnote", "ref_text"), T.clean_inline(raw)).when(t.isin("image", "chart", "seal"), first("content", "text")).when(t.isin("equation", *FURNITURE), raw).otherwise(first("text", "content"))
    kind = (
        F.when((t == "text") & (F.coalesce("text_level", F.lit(0)) > 0), "heading")
        .when(t.isin("text", "ref_text"), "paragraph")
        .when(t == "equation", "equation")
        .when(t.isin("image", "seal"), "image")
        .when(t.isin("chart", "table", "code", "list"), t)
        .when(t == "page_footnote", "footnote")
        .when(t.isin(*FURNITURE), "furniture")
        .otherwise("paragraph")
    )
    known = t.isin("text", "ref_text", "equation", "image", "seal", "chart", "table", "code", "list", "page_footnote", *FURNITURE)
    listed = F.transform(F.filter(F.transform(F.coalesce("list_items", none), T.trimmed), lambda x: x != ""), T.clean_inline)

    def parts(what: str):
        """Captions or footnotes of the kind itself; pictures of other kinds fall back on those of images."""
        own = {k: F.coalesce(f"{k}_{what}", none) for k in ("image", "chart", "seal", "table", "code") if f"{k}_{what}" in items.columns}
        pick = none
        for k, c in own.items():
            c = F.when(F.size(c) > 0, c).otherwise(own["image"]) if k in ("chart", "seal") else c
            pick = F.when(t == k, c).otherwise(pick)
        return T.clean_inline(T.joined(pick))

    caption, footnote = parts("caption"), parts("footnote")
    body = F.coalesce(F.when(F.col("code_body") != "", F.col("code_body")), "text", F.lit(""))
    lang = F.when(T.code_language(body) != "", T.code_language(body)).when(F.col("sub_type") == "algorithm", "text")
    out = items.select(
        "doc_id",
        "pos",
        (F.coalesce("page_idx", F.lit(0)) + page_offset + 1).alias("page"),
        kind.alias("type"),
        F.when(kind == "heading", F.least(F.lit(6), F.greatest(F.lit(1), F.col("text_level")))).alias("level"),
        F.when(kind == "code", T.code_body(body)).when(kind.isin("heading", "paragraph", "footnote", "furniture", "image", "chart"), F.when(~kind.isin("image", "chart") | (text != ""), text)).alias("text"),
        F.when(kind == "equation", T.without_display_fences(text)).alias("latex"),
        F.when(kind.isin("image", "chart", "table", "code"), caption).alias("caption"),
        F.when(kind.isin("image", "chart", "table"), footnote).alias("footnote"),
        F.when(kind.isin("image", "chart", "table"), F.col("img_path")).alias("image"),
        F.when(kind == "table", F.coalesce("table_body", F.lit(""))).alias("html"),
        F.when(kind == "code", lang).alias("lang"),
        F.when(kind == "list", listed).alias("items"),
        F.when(kind == "furniture", t).when(kind == "list", F.coalesce(F.when(F.col("sub_type") != "", F.col("sub_type")), F.lit("text"))).alias("role"),
        F.when(~F.coalesce(known, F.lit(False)), t).alias("source_type"),
        "bbox",
    )
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kept = (
        F.when(F.col("type").isin("heading", "paragraph", "footnote", "furniture"), some("text"))
        .when(F.col("type") == "equation", some("latex"))
        .when(F.col("type") == "list", F.size("items") > 0)
        .when(F.col("type").isin("image", "chart"), some("image") | some("caption") | some("text"))
        .otherwise(True)
    )
    return numbered(out.where(kept), ["doc_id"], ["pos"])


def pages(blocks: DataFrame, sizes: DataFrame | None = None, page_offset: int = 0) -> DataFrame:
    """Every page from 1 to the last that has a block or a known size."""
    last = blocks.groupBy("doc_id").agg(F.max("page").alias("n"))
    if sizes is not None:
        known = sizes.select("doc_id", (F.col("page_idx") + page_offset + 1).alias("page"), "size")
        last = last.unionByName(known.groupBy("doc_id").agg(F.max("page").alias("n"))).groupBy("doc_id").agg(F.max("n").alias("n"))
    out = last.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("page"))
    return out if sizes is None else out.join(known, ["doc_id", "page"], "left")


def preview(kind, text, latex=None, caption=None, limit: int = 100):
    """The first characters that stand for a block in lists and searches."""
    latex, caption = (F.lit(None).cast("string") if c is None else c for c in (latex, caption))
    shown = F.when(kind == "equation", latex).when(kind.isin("image", "chart", "table"), F.coalesce(caption, text)).otherwise(text)
    return F.substring(T.one_line(F.coalesce(shown, F.lit(""))), 1, limit)


def document_lines(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of Markdown or plain text, numbered from 1."""
    rest = [c for c in documents.columns if c not in (key, "text")]
    return documents.select(F.col(key).alias("doc_id"), *rest, F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("ln", F.col("i") + 1).drop("i")


def conversation_blocks(conversations: DataFrame) -> DataFrame:
    """Conversations as documents: a page for each turn, its role a heading, its lines paragraphs."""
    c = conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "role", "text")
    heads = c.select("doc_id", "page", F.lit(0).alias("sub"), F.lit("heading").alias("type"), F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3).alias("level"), F.col("role").alias("text"))
    lines = c.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.trim("text") != "")
    body = lines.select("doc_id", "page", (F.col("i") + 1).alias("sub"), F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), "text")
    return numbered(heads.unionByName(body), ["doc_id"], ["page", "sub"])
