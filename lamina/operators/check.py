"""Validation: structure rules over Markdown blocks, and the gate for rewritten segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import text as T
from .ordered import running


def heading_jumps(headings: DataFrame) -> DataFrame:
    """Headings more than one level below the one before."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    return headings.withColumn("before", F.lag("level").over(w)).where("level > before + 1")


def title_errors(headings: DataFrame) -> DataFrame:
    """Documents that do not begin with a heading of level 1, or have several."""
    g = headings.groupBy("doc_id").agg(F.min_by("level", "block_no").alias("first_level"), F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).alias("n_titles"))
    return g.where("first_level <> 1 or n_titles <> 1")


def table_widths(lines: DataFrame) -> DataFrame:
    """Lines of pipe tables whose cell count is not the header's; a table is a run of consecutive lines that start with a pipe."""
    t = lines.where(F.trim("line").startswith("|"))
    w = Window.partitionBy("doc_id").orderBy("ln")
    t = t.withColumn("island", F.col("ln") - F.row_number().over(w)).withColumn("n_cells", F.size(F.split(F.regexp_replace(F.trim("line"), r"\\\|", ""), r"\|")) - 2)
    head = F.first("n_cells").over(Window.partitionBy("doc_id", "island").orderBy("ln"))
    return t.withColumn("n_head", head).where("n_cells <> n_head")


def repeated_siblings(blocks: DataFrame) -> DataFrame:
    """Headings with the text of an earlier one under the same parent; blocks with breadcrumbs."""
    h = blocks.where("type = 'heading'").withColumn("parent", F.array_join(F.slice("heading_path", F.lit(1), F.greatest(F.size("heading_path") - 1, F.lit(0))), " > "))
    w = Window.partitionBy("doc_id", "parent", "level", "text").orderBy("block_no")
    return h.withColumn("nth", F.row_number().over(w)).where("nth > 1")


def braces_balanced(c: Column) -> Column:
    """A structural test of formulas, not a typesetter's: braces, and the numbers of begins and ends, match."""
    n = lambda sign: F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))
    plain = F.regexp_replace(c, r"\\[{}]", "")
    m = lambda sign: F.length(plain) - F.length(F.replace(plain, F.lit(sign), F.lit("")))
    return (m("{") == m("}")) & (n("\\begin{") / 7 == n("\\end{") / 5)


def normal_form(c: Column) -> Column:
    """What fidelity compares: compatibility forms, no commands, markup or white space, lower case."""
    from ..functions.python import nfkc_lower

    return F.regexp_replace(F.regexp_replace(nfkc_lower(c), r"\\[a-zA-Z]+", ""), r"[\s*_`#>|$\\{}\[\]()~^-]+", "")


#: What a rewritten segment's line may not begin with: headings, fences, HTML, table rows, images.
FORBIDDEN = r"(?m)^\s{0,3}(#{1,6}\s|```|~~~|<[a-zA-Z!/]|\|.*\|\s*$|!\[)"


def parse_segments(replies: DataFrame) -> DataFrame:
    """(doc_id, seq, ids, markdown) of replies (doc_id, text): what follows each line [[b0001]] or [[b0001+b0002]].
    An outer code fence and text before the first such line go; null and other replies without any give no row."""
    line = r"(?m)^\s*\[\[(b\d{4,}(?:\s*\+\s*b\d{4,})*)\]\]\s*$"
    text = F.regexp_replace(T.trimmed(F.col("text")), r"^```[a-z]*\n|\n```\s*\z", "")
    bodies = F.split(text, line)
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(line), 1).alias("ids"), F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))).alias("markdown"))
    out = replies.select("doc_id", F.posexplode(both).alias("i", "x"))
    return out.select("doc_id", (F.col("i") + 1).alias("seq"), F.regexp_extract_all("x.ids", F.lit(r"b\d{4,}"), 0).alias("ids"), T.trimmed(F.col("x.markdown")).alias("markdown"))


def segment_gate(segments: DataFrame, formula_ok: Callable[[Column], Column] = braces_balanced) -> DataFrame:
    """Accepts rewritten segments (doc_id, seq, ids, known_ids, source, markdown): ids known, consecutive and after those of
    any earlier segment in order, text kept to 88 in 100 (70 for sources under 25 characters) and to 0.8 to 1.2 of the
    length, formulas sound by formula_ok. problem names the first rule that a segment breaks, null if none; ordered tells of the ids alone."""
    from ..functions.python import fidelity

    s = segments.withColumn("at", F.transform("ids", lambda i: F.array_position("known_ids", i).cast("int")))
    s = s.withColumn("_known", F.coalesce((F.size("ids") > 0) & ~F.array_contains("at", 0), F.lit(False)))
    lo, hi = F.array_min("at"), F.array_max("at")
    s = s.withColumn("_run", F.coalesce(F.col("_known") & (F.col("at") == F.sequence(lo, hi)), F.lit(False))).withColumn("_lo", lo).withColumn("_hi", hi)

    def step(last, run, lo, hi):
        # A segment in order moves the place on, whatever else is wrong with it.
        last = last or 0
        fine = run and lo > last
        return (hi if fine else last), fine

    # Order first: texts are compared only where a caller asks for more than that.
    s = running(s, ["doc_id"], ["seq"], ["_run", "_lo", "_hi"], step, "ordered", BooleanType())
    s = s.withColumn("a", normal_form(F.coalesce("source", F.lit("")))).withColumn("b", normal_form(F.coalesce("markdown", F.lit(""))))
    s = s.withColumn("ratio", fidelity(F.col("a"), F.col("b"))).withColumn("share", F.when((F.length("a") == 0) & (F.length("b") == 0), 1.0).otherwise(F.length("b") / F.greatest(F.length("a"), F.lit(1))))
    short = F.length("a") < 25
    formulas = F.regexp_extract_all("markdown", F.lit(r"(?<![\\$])\$(?!\$)([^$\n]+?)(?<!\\)\$(?!\$)"), 1)
    problem = (
        F.when(~F.col("_known"), "unknown ids")
        .when(~F.col("ordered"), "ids out of order or not consecutive")
        .when(T.trimmed(F.coalesce("markdown", F.lit(""))) == "", "empty output")
        .when(F.col("markdown").rlike(FORBIDDEN), "forbidden Markdown")
        .when((F.col("ratio") < F.when(short, 70).otherwise(88)) | ~(short | F.col("share").between(0.8, 1.2)), "fidelity")
        .when(F.exists(formulas, lambda x: ~formula_ok(T.fixed_latex(x))), "invalid formula")
    )
    return s.withColumn("problem", problem).withColumn("accepted", F.col("problem").isNull()).drop("a", "b", "at", "_known", "_run", "_lo", "_hi")


def missing_ids(blocks: DataFrame, gated: DataFrame) -> DataFrame:
    """(doc_id, block_id) of prose blocks that no segment in order covers; gated as segment_gate returns it."""
    seen = gated.where("ordered").select("doc_id", F.explode("ids").alias("block_id")).distinct()
    return blocks.where(F.col("type").isin(*T.TEXT_KINDS)).select("doc_id", "block_id").join(seen, ["doc_id", "block_id"], "left_anti")


def segment_stats(blocks: DataFrame, gated: DataFrame) -> DataFrame:
    """Of each document: accepted segments, blocks that they cover, and prose blocks left as they were."""
    prose = blocks.groupBy("doc_id").agg(F.sum(F.col("type").isin(*T.TEXT_KINDS).cast("long")).alias("n_prose"))
    taken = gated.where("accepted").groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.sum(F.size("ids")).alias("n_covered"))
    out = prose.join(taken, "doc_id", "left").na.fill(0, ["n_segments", "n_covered"])
    return out.select("doc_id", "n_segments", "n_covered", (F.col("n_prose") - F.col("n_covered")).alias("n_fallback"))
