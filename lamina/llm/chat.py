"""Chat formatting: collapse of cumulative snapshots, then rendering.

A logged conversation that is the beginning of a longer one is a snapshot of it. Every
turn has a 128-bit hash of its place, role and text; sums of these are rolling hashes of
turn prefixes, as places are part of what is summed. A conversation goes if the hash of
all its turns is that of a shorter stretch of another, or of all turns of one with a
smaller id. All in DataFrame operations; running sums and places are worked out within
segments of SEGMENT turns and then between segments, so no conversation's turns meet in
one task, and no rendered row is longer than a segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = 256
#: Rendered roles; others are rendered under their own lower-case name.
ROLES = ("system", "user", "assistant", "tool")
_MOD = 1 << 31


def _parts(place: str) -> list[Column]:
    """Four sums' terms of a turn, each below 2^31: sums of up to 2^32 turns stay exact."""
    out = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), F.col(place), F.col("role"), F.col("text"))
        out += [F.pmod(h, F.lit(_MOD)), F.pmod(F.shiftright(h, 32), F.lit(_MOD))]
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """Turns in order, each with its place from 0 and the rolling hash up to it.

    Rows without conv_id are left out; null roles and texts are empty; rows that repeat a
    turn word for word count once, and different rows of one turn stand in order of role and
    text; a null turn comes first."""
    t = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.lower(F.trim("role")), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    t = t.where("conv_id is not null").dropDuplicates(["conv_id", "turn", "role", "text"])
    t = t.withColumn("seg", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 40))))
    inner = Window.partitionBy("conv_id", "seg").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("local", F.row_number().over(inner) - 1)
    sizes = t.groupBy("conv_id", "seg").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    t = t.join(sizes.select("conv_id", "seg", "base"), ["conv_id", "seg"]).withColumn("place", F.col("base") + F.col("local"))
    for i, c in enumerate(_parts("place")):
        t = t.withColumn(f"p{i}", c)
    sums = t.groupBy("conv_id", "seg").agg(*[F.sum(f"p{i}").alias(f"s{i}") for i in range(4)])
    sums = sums.select("conv_id", "seg", *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"b{i}") for i in range(4)])
    running = inner.rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(sums, ["conv_id", "seg"])
    return t.select("conv_id", "seg", "place", "role", "text", *[(F.sum(f"p{i}").over(running) + F.col(f"b{i}")).alias(f"h{i}") for i in range(4)])


def maximal(t: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that stay; t as turns() gives it."""
    h = ["h0", "h1", "h2", "h3"]
    last = t.groupBy("conv_id").agg(F.max("place").alias("end"))
    whole = t.join(last, "conv_id").where("place = end").select("conv_id", (F.col("end") + 1).alias("n_turns"), *h)
    # Distinct hashes: a very common first turn or whole conversation is one row, pre-aggregated before the shuffle.
    proper = t.join(last, "conv_id").where("place < end").select(*h, (F.col("place") + 1).alias("n_turns")).distinct()
    one = whole.groupBy(*h, "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return one.join(proper, [*h, "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(role: Column, text: Column) -> Column:
    """One turn between role markers; angle-bar markers inside the text are taken apart, so that none can be forged."""
    return F.concat(F.lit("<|"), F.when(role == "", F.lit("unknown")).otherwise(F.regexp_replace(role, "[^a-z0-9_]", "_")), F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("\n<|end|>\n"))


def chat_format(conversations: DataFrame) -> DataFrame:
    """Rendered segments of the maximal conversations: conv_id, segment, n_turns, n_copies, n_segment_turns, rendered.

    segment numbers a conversation's stretches of SEGMENT turn numbers from 0; joined in that
    order they are its rendered text. n_copies counts the conversations with the very same
    turns, of which the smallest id stays. An empty table gives no rows."""
    t = turns(conversations)
    kept = maximal(t)
    rows = t.join(kept, "conv_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "role", "text"))), lambda x: rendered(x["role"], x["text"])), "")
    out = rows.groupBy("conv_id", "seg", "n_turns", "n_copies").agg(F.count("*").alias("n_segment_turns"), text.alias("rendered"))
    order = Window.partitionBy("conv_id").orderBy("seg")
    return out.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("segment"), "n_turns", "n_copies", "n_segment_turns", "rendered")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(lower(trim(role)), '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM t),
w AS (SELECT *, md5(string_agg(md5(role) || md5(text), '' ) OVER (PARTITION BY conv_id ORDER BY place)) AS h,
        max(place) OVER (PARTITION BY conv_id) AS last_place FROM p),
whole AS (SELECT h, min(conv_id) AS conv_id, count(*) AS n_copies, max(last_place) + 1 AS n_turns FROM w WHERE place = last_place GROUP BY h),
kept AS (SELECT * FROM whole WHERE h NOT IN (SELECT h FROM w WHERE place < last_place)),
s AS (
  SELECT p.conv_id, coalesce(floor(turn / {SEGMENT}.0), -1e9) AS seg, kept.n_turns, kept.n_copies, count(*) AS n_segment_turns,
    string_agg('<|' || CASE WHEN role = '' THEN 'unknown' ELSE regexp_replace(role, '[^a-z0-9_]', '_', 'g') END || '|>' || chr(10)
      || replace(text, '<|', '< |') || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
  FROM p JOIN kept USING (conv_id) GROUP BY ALL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seg) - 1 AS segment, n_turns, n_copies, n_segment_turns, rendered FROM s
"""
