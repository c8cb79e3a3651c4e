"""Chunks: greedy packing of pieces to a target size, restarted at every section."""

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import text as T
from . import outline
from .ordered import running

_SENTENCE, _WORD = re.compile(r"(?<=[。！？；.!?;])\s*"), re.compile("[A-Za-z0-9]+")
_HAN = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f]")


def packed(pieces: DataFrame, keys: list[str], order: str | list[str], limit: int = T.TARGET_TOKENS, text: str = "text") -> DataFrame:
    """Pieces numbered by chunk (chunk_no) within keys: a chunk closes when the estimate of its texts and the next would pass limit.

    Texts are taken as one without a sign between, so words that meet count once. A null text is empty."""
    t = F.coalesce(text, F.lit(""))
    counted = pieces.withColumns({
        "_han": F.size(F.regexp_extract_all(t, F.lit(f"[{T.HAN}]"), 0)), "_words": F.size(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+"), 0)),
        "_opens": t.rlike("^[A-Za-z0-9]"), "_closes": F.when(t != "", t.rlike(r"[A-Za-z0-9]\z")),
    })

    def step(state, han, words, opens, closes):
        n, h, w, open_end = state or (0, 0, 0, False)
        met = words - (open_end and opens)
        if state is None or h + han + int(1.3 * (w + met)) <= limit:
            state = n, h + han, w + met, open_end if closes is None else closes
        else:
            state = n + 1, han, words, bool(closes)
        return state, state[0]

    inputs = ["_han", "_words", "_opens", "_closes"]
    return running(counted, keys, [order] if isinstance(order, str) else order, inputs, step, "chunk_no", IntegerType()).drop(*inputs)


def batched(blocks: DataFrame, limit: int = 6000) -> DataFrame:
    """Blocks numbered by batch of rewriting: one closes before a block that would pass limit characters, or before a
    heading once it is over half full. Kinds without prose count as 40 characters; no block is cut."""
    items = T.bullets(F.col("items")) if "items" in blocks.columns else F.lit("")
    source = F.when(F.col("type") == "list", items).otherwise(T.one_line(F.coalesce("text", F.lit(""))))
    b = blocks.withColumn("_n", F.when(F.col("type").isin(*T.TEXT_KINDS), F.length(source)).otherwise(40))

    def step(state, n, kind):
        if state is None:
            state = 0, n
        elif state[1] + n > limit or (kind == "heading" and state[1] > limit * 0.5):
            state = state[0] + 1, n
        else:
            state = state[0], state[1] + n
        return state, state[0]

    return running(b, ["doc_id"], ["block_no"], ["_n", "type"], step, "batch", IntegerType()).drop("_n")


def sentences_within(text: str, limit: int) -> list[str]:
    """A text cut after sentences into parts of as many as limit allows; a longer sentence stays whole."""
    sizes, parts = [], []
    for s in _SENTENCE.split(text):
        han, words = len(_HAN.findall(s)), len(_WORD.findall(s))
        if parts and parts[-1] and sizes[0] + han + int(1.3 * (sizes[1] + words)) <= limit:
            parts[-1] += s
            sizes = [sizes[0] + han, sizes[1] + words]
        else:
            parts.append(s)
            sizes = [han, words]
    return [x for x in parts if x.strip()]


def long_split(blocks: DataFrame, limit: int = T.MAX_TOKENS) -> DataFrame:
    """Texts over the limit cut after sentences, parts filled up to it; code, tables and formulas stay whole."""
    from ..functions.python import arrow_udf

    @arrow_udf("array<string>")
    def cut(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else sentences_within(t, limit))

    big = ~F.col("type").isin("code", "table", "math", "equation", "heading") & (T.est_tokens(F.col("text")) > limit)
    parts = F.coalesce(cut(F.when(big, F.col("text"))), F.array("text"))
    return blocks.withColumn("parts", parts).select(*[c for c in blocks.columns if c != "text"], F.posexplode("parts").alias("part", "text"))


def chunk_table(pieces: DataFrame, keys: list[str], order: str, lang: str | None = None) -> DataFrame:
    """Chunk rows from packed pieces: id, sequence, lines, pages, kinds, digest and text."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n\n")
    heads = [k for k in keys if k != "doc_id"]
    g = pieces.groupBy("doc_id", *heads, "chunk_no").agg(
        body.alias("text"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("page").alias("page_min"), F.max("page").alias("page_max"), F.array_sort(F.collect_set("type")).alias("kinds")
    )
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "chunk_no")) - 1
    dotted = F.col("doc_id").cast("string") if lang is None else F.concat(F.col("doc_id").cast("string"), F.lit("." + lang))
    return g.withColumn("seq", seq).withColumn("id", F.concat(dotted, F.lit("#"), F.format_string("%04d", "seq"))).withColumn("sha1", T.chunk_sha(F.col("text")))


#: What may begin at the start of a line, tried in this order; code and formulas reach to the line that closes them, or to the end.
_GRAMMAR = re.compile(
    r"""
    (?P<code>    ^[ ]{0,3}(?P<fence>`{3}|~{3})[^\n]*      (?:\n(?![^\S\n]*(?P=fence))[^\n]*)*  (?:\n[^\n]*)? )
  | (?P<math>    ^[^\S\n]*\$\$[^\S\n]*$                 (?:\n(?![^\S\n]*\$\$)[^\n]*)*      (?:\n[^\n]*)? )
  | (?P<heading> ^[ ]{0,3}(?P<level>\#{1,6})[ \t]+(?P<title>[^\n]+?)[ \t]*\#*[ \t]*$ )
  | (?P<table>   ^[^\S\n]*\|[^\n]*$ )
  | (?P<image>   ^[^\S\n]*!\[[^\]\n]*\]\([^)\n]*\)[^\S\n]*$ )
  | (?P<text>    ^[^\n]*\S[^\n]*$ )
    """,
    re.M | re.X,
)


def blocks_in(text: str) -> list[dict]:
    """Blocks of a Markdown text with their lines; adjacent lines of prose, table and image are one block, of their kind if all have the same."""
    ends = [m.start() for m in re.finditer("\n", text or "")]
    out: list[dict] = []
    for m in _GRAMMAR.finditer(text or ""):
        kind = next(k for k in ("code", "math", "heading", "table", "image", "text") if m[k] is not None)
        first, last = 1 + bisect_left(ends, m.start()), 1 + bisect_left(ends, m.end())
        if kind == "heading":
            out.append({"kind": kind, "level": len(m["level"]), "text": m["title"], "first": first, "last": last})
        elif kind in ("code", "math") or not out or out[-1]["last"] != first - 1 or out[-1]["kind"] not in ("table", "image", "text"):
            out.append({"kind": kind, "level": 0, "text": m[0], "first": first, "last": last})
        else:
            before = out[-1]
            out[-1] = before | {"kind": kind if kind == before["kind"] else "text", "text": f"{before['text']}\n{m[0]}", "last": last}
    return out


def markdown_blocks(documents: DataFrame) -> DataFrame:
    """Headings, paragraphs, tables, images, fenced code and displayed formulas of Markdown texts, with their lines."""
    from ..functions.python import arrow_udf

    @arrow_udf("array<struct<kind:string,level:int,text:string,first:int,last:int>>")
    def blocks_of(x: pd.Series) -> pd.Series:
        return x.map(blocks_in)

    return documents.select("doc_id", F.posexplode(blocks_of(F.col("text"))).alias("block_no", "b")).select("doc_id", "block_no", "b.*")


def chunk_markdown(documents: DataFrame, line_pages: DataFrame | None = None, lang: str | None = None, target: int = T.TARGET_TOKENS, most: int = T.MAX_TOKENS) -> DataFrame:
    """Chunks of Markdown texts (doc_id, text): sections packed to target tokens, with headings, lines, kinds, and pages where line_pages (doc_id, ln, page) knows them.

    Null and blank texts give no chunk; texts before the first heading have an empty path; a doc_id should be one row."""
    b = markdown_blocks(documents.select("doc_id", "text")).withColumnRenamed("kind", "type")
    b = b.withColumn("text", F.when(F.col("type") == "heading", F.regexp_replace("text", r"!\[([^\]]*)\]\([^)]*\)", "$1")).otherwise(F.col("text")))
    b = outline.breadcrumbs(b.withColumn("block_no", F.col("block_no") + 1))
    upto = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("section", F.sum(F.when(F.col("type") == "heading", 1).otherwise(0)).over(upto))
    p = packed(long_split(b.where("type <> 'heading'"), most), ["doc_id", "section"], ["block_no", "part"], target)
    parts = F.array_sort(F.collect_list(F.struct("block_no", "part", "text")))
    g = p.groupBy("doc_id", "section", "chunk_no").agg(
        T.trimmed(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n")).alias("text"), F.first("heading_path").alias("heading_path"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_set("type")).alias("kinds"), F.collect_set(F.struct("first", "last")).alias("_spans"),
    )
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "chunk_no")) - 1
    name = F.col("doc_id").cast("string") if lang is None else F.concat(F.col("doc_id").cast("string"), F.lit("." + lang))
    g = g.withColumn("seq", seq).withColumn("id", F.concat(name, F.lit("#"), F.format_string("%04d", "seq"))).withColumn("sha1", T.chunk_sha(F.col("text")))
    if line_pages is None:
        g = g.withColumn("page_min", F.lit(None).cast("int")).withColumn("page_max", F.lit(None).cast("int"))
    else:
        ends = g.select("id", "doc_id", F.explode(F.flatten(F.transform("_spans", lambda x: F.array(x["first"], x["last"])))).alias("ln"))
        at = ends.join(line_pages.select("doc_id", "ln", "page"), ["doc_id", "ln"]).groupBy("id").agg(F.min("page").alias("page_min"), F.max("page").alias("page_max"))
        g = g.join(at, "id", "left")
    return g.select("id", "doc_id", "seq", "heading_path", "page_min", "page_max", "first", "last", "kinds", "sha1", "text", T.index_text(F.col("heading_path"), F.col("text")).alias("index_text"))
