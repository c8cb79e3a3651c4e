"""Exact reads: locate phrases in blocks, read lines, pages, sections or chunks, resolve ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .blocks import ALIASES


def folded(c: Column, unicode: bool = False) -> Column:
    """Lower case; with unicode also compatibility forms, which takes Python."""
    if not unicode:
        return F.lower(c)
    from ..functions.python import nfkc_lower

    return nfkc_lower(c)


def locate(blocks: DataFrame, query: str, doc_ids: list | None = None, kind: str | None = None, limit: int | None = 20, unicode: bool = False) -> DataFrame:
    """Blocks whose preview holds the phrase (2) or all its words (1); one more for a start with the phrase, and for headings."""
    if kind is not None and kind.lower() not in ALIASES:
        raise ValueError(f"unknown block type {kind!r}; known: {', '.join(sorted(ALIASES))}")
    b = blocks if kind is None else blocks.where(F.col("type").isin(*ALIASES[kind.lower()]))
    if doc_ids is not None:
        b = b.where(F.col("doc_id").isin(doc_ids))
    q, p = F.lit(query.lower().strip()), folded(F.col("preview"), unicode)
    words = query.lower().split()
    phrase, every = p.contains(q), F.lit(bool(words))
    for w in words:
        every &= p.contains(w)
    hit = b.where((F.col("preview") != "") & (phrase | every))
    score = F.when(phrase, 2).otherwise(1) + F.when(p.startswith(q), 1).otherwise(0) + F.when(F.col("type") == "heading", 1).otherwise(0)
    hit = hit.withColumn("score", score)
    return hit if limit is None else hit.orderBy(F.desc("score"), "doc_id", "page", "block_no").limit(limit)


def lines_between(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Lines of each document in a range that is clamped to it."""
    total = lines.groupBy("doc_id").agg(F.max("ln").alias("total"))
    lo, hi = F.least(F.greatest(F.lit(min(first, last)), F.lit(1)), F.col("total")), F.least(F.greatest(F.lit(max(first, last)), F.lit(1)), F.col("total"))
    return lines.join(total, "doc_id").where((F.col("ln") >= lo) & (F.col("ln") <= hi)).drop("total")


def text_of(lines: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("ln", "line")))
    return lines.groupBy("doc_id").agg(F.min("ln").alias("first"), F.max("ln").alias("last"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))


def truncated(c: Column, limit: int) -> Column:
    """Cut to limit characters, then back to the last line break if that is past the middle."""
    cut = F.substring(c, 1, limit)
    at = F.length(cut) - F.instr(F.reverse(cut), "\n")
    back = (F.instr(cut, "\n") > 0) & (at > limit * 0.5)
    return F.when(F.length(c) <= limit, c).when(back, F.substring(cut, F.lit(1), at)).otherwise(cut)


def page_hull(anchors: DataFrame, first: int, last: int) -> DataFrame:
    """The stretch of lines that holds all blocks of the pages, others between them included."""
    return anchors.where(F.col("page").between(first, last)).groupBy("doc_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def section(sections: DataFrame, name: str) -> DataFrame:
    """Each document's first heading of that name, or else the first that contains it; case does not count."""
    t, q = F.lower("text"), name.lower().strip()
    rank = F.when(t == q, 0).when(t.contains(q), 1)
    w = Window.partitionBy("doc_id").orderBy("_r", "block_no")
    return sections.withColumn("_r", rank).where("_r is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_r", "_n")


def get(lines: DataFrame, anchors: DataFrame, sections: DataFrame, doc_id, pages: str | None = None, span: str | None = None, heading: str | None = None, max_chars: int = 20_000) -> DataFrame:
    """One document's text by heading, pages or lines, in that order of precedence, or all of it; clamped and cut."""
    own = lines.where(F.col("doc_id") == doc_id)
    pair = lambda s: tuple(sorted(int(x) for x in s.replace(":", "-").split("-"))) * (1 if "-" in s.replace(":", "-") else 2)
    if heading is not None:
        at = section(sections.where(F.col("doc_id") == doc_id), heading).select("doc_id", "first", "last")
        own = own.join(at, "doc_id").where("ln between first and last").drop("first", "last")
    elif pages is not None:
        at = page_hull(anchors.where(F.col("doc_id") == doc_id), *pair(pages)[:2])
        own = own.join(at, "doc_id").where("ln between first and last").drop("first", "last")
    elif span is not None:
        own = lines_between(own, *pair(span)[:2])
    out = text_of(own)
    cut = truncated(F.regexp_replace("text", r"^\n+|\n+$", ""), max_chars)
    return out.withColumn("truncated", F.length(F.regexp_replace("text", r"^\n+|\n+$", "")) > max_chars).withColumn("text", cut)


def resolved(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """(asked, id, n): the id that each asked string means: an exact id, else an only prefix of 4 characters or more, else a name or title in any case; n > 1 is ambiguous, with a null id."""
    c = catalog.select("id", "name", "title")
    steps = [
        (0, asked.join(c, F.col("asked") == F.col("id"))),
        (1, asked.where(F.length("asked") >= 4).withColumn("_p", F.substring("asked", 1, 4)).join(c.withColumn("_p", F.substring("id", 1, 4)), "_p").where(F.col("id").startswith(F.col("asked")))),
        (2, asked.withColumn("_n", F.lower("asked")).join(c.withColumn("_n", F.explode(F.array(F.lower("name"), F.lower("title")))), "_n")),
    ]
    found = None
    for rank, rows in steps:
        rows = rows.select("asked", "id", F.lit(rank).alias("rank")).distinct()
        found = rows if found is None else found.unionByName(rows)
    best = found.withColumn("_b", F.min("rank").over(Window.partitionBy("asked"))).where("rank = _b")
    out = best.groupBy("asked").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return asked.join(out, "asked", "left").select("asked", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.coalesce("n", F.lit(0)).alias("n"))
