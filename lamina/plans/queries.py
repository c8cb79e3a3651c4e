"""Queries of the document library over the driver's tables.

documents are plain texts, a line a paragraph, 20 lines a page; conversations are documents with headings
(role lines) and pages (turns); benchmark items are batch queries. SQL counterparts are for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, blocks, bm25, catalog, check, chunks, lookup, outline, render
from ..sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PAGE_LINES = 20


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame(values, schema)


def literals(values: list[tuple]) -> str:
    """A SQL VALUES list of numbers, texts and nulls."""
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in values)


# ---------------------------------------------------------------- search

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
TOKENS_SQL = rf"""
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents),
kept AS (SELECT * FROM toks WHERE term NOT IN {STOP_SQL}),
filled AS (SELECT * FROM kept UNION ALL SELECT doc_id, '∅' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept)),
postings AS (SELECT doc_id, term, count(*) AS tf FROM filled GROUP BY ALL),
lens AS (SELECT doc_id, sum(tf) AS dl FROM postings GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY ALL),
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens)"""
QUERY_SQL = rf"""
qt AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+')) AS term FROM q),
q2 AS (SELECT query_id, term, count(*) AS qtf FROM qt WHERE term NOT IN {STOP_SQL} GROUP BY ALL),
scored AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM q2 JOIN terms USING (term) JOIN postings USING (term) JOIN lens USING (doc_id), totals GROUP BY ALL)"""
ONE = "tion ing erer stand the reon ing"


def _index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    return bm25.build(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.query_terms(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


def _one(spark: SparkSession) -> DataFrame:
    return bm25.query_terms(rows(spark, "query_id int, query string", [(1, ONE)]))


def _hits(d: DataFrame) -> DataFrame:
    return d.select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH q AS (SELECT 1 AS query_id, '{ONE}' AS query), {TOKENS_SQL}, {QUERY_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM scored QUALIFY rank <= 8")
def bm25_topk(spark, sf_dir):
    return _hits(bm25.top(bm25.scores(_one(spark), _index(spark, sf_dir), best=8), 8))


@query(f"WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {TOKENS_SQL}, {QUERY_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM scored QUALIFY rank <= 5")
def bm25_batch_topk(spark, sf_dir):
    return _hits(bm25.top(bm25.scores(_batch(spark, sf_dir), _index(spark, sf_dir), best=5), 5))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """The index of all documents, written under the warehouse, which all executors share."""
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/index-{uuid.uuid4().hex}"
    bm25.save(bm25.build(chunks), chunks, path)
    return path


@query(f"WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {TOKENS_SQL}, {QUERY_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM scored QUALIFY rank <= 5")
def index_roundtrip(spark, sf_dir):
    return _hits(bm25.top(bm25.scores(_batch(spark, sf_dir), bm25.load(spark, _stored(spark, sf_dir)), best=5), 5))


@query("SELECT 'same' AS name, false AS stale UNION ALL SELECT 'one text changed', true UNION ALL SELECT 'one document less', true")
def index_stale(spark, sf_dir):
    path, d = _stored(spark, sf_dir), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    first = d.agg(F.min("chunk_id")).first()[0]
    changed = d.withColumn("text", F.when(F.col("chunk_id") == first, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    cases = {"same": d, "one text changed": changed, "one document less": d.where(F.col("chunk_id") != first)}
    out = [bm25.stale(spark, path, x).select(F.lit(name).alias("name"), "stale") for name, x in cases.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query(f"WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {TOKENS_SQL}, {QUERY_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM scored JOIN documents USING (doc_id) WHERE lang = 'fr' QUALIFY rank <= 5")
def bm25_lang_mask(spark, sf_dir):
    index = bm25.build(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "text"), keep=("lang",))
    return _hits(bm25.top(bm25.scores(_batch(spark, sf_dir), index, F.col("lang").eqNullSafe(F.lit("fr")), best=5), 5))


@query(
    f"WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {TOKENS_SQL}, {QUERY_SQL}, "
    "a AS (SELECT query_id, doc_id, source, round(score, 9) AS s, score FROM scored JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 20), "
    "b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY s DESC, doc_id) <= 1) "
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM b QUALIFY rank <= 5"
)
def bm25_max_per_doc(spark, sf_dir):
    index = bm25.build(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text"), keep=("doc_id",))
    return _hits(bm25.top(bm25.scores(_batch(spark, sf_dir), index, best=20), 5, per_doc=1))


@query(rf"WITH q AS (SELECT item_id AS query_id, text || ' zzqx' || item_id AS query FROM benchmark), {TOKENS_SQL}, {QUERY_SQL} SELECT DISTINCT term FROM q2 WHERE term NOT IN (SELECT term FROM terms)")
def unknown_terms(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" zzqx"), "item_id").alias("query"))
    return bm25.unknown_terms(bm25.query_terms(b), _index(spark, sf_dir))


@query(f"WITH {TOKENS_SQL} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM terms, totals")
def term_stats(spark, sf_dir):
    i = _index(spark, sf_dir)
    return i.terms.crossJoin(i.totals).select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, dl, count(*) AS n_terms, max(tf) AS max_tf FROM postings JOIN lens USING (doc_id) GROUP BY ALL")
def chunk_stats(spark, sf_dir):
    i = _index(spark, sf_dir)
    return i.postings.groupBy("chunk_id").agg(F.sum("tf").alias("dl"), F.count("*").alias("n_terms"), F.max("tf").alias("max_tf")).withColumnRenamed("chunk_id", "doc_id")


HAN_LINES = [(1, "钙钛矿"), (2, "锂"), (3, "钛矿 and 的"), (4, "plain words")]


@query(
    f"WITH v(id, s) AS (VALUES {literals(HAN_LINES)}), w AS (SELECT id, unnest(regexp_extract_all(lower(s), '[㐀-䶿一-鿿]+|[a-z0-9]+')) AS x FROM v) "
    "SELECT id, CASE WHEN x < '㐀' THEN x WHEN length(x) = 1 THEN x ELSE substr(x, i, 2) END AS term, count(*) AS n "
    f"FROM w, LATERAL (SELECT unnest(range(1, CASE WHEN x < '㐀' OR length(x) = 1 THEN 2 ELSE length(x) END)) AS i) WHERE x NOT IN {STOP_SQL} GROUP BY ALL"
)
def tokens_query_bigrams(spark, sf_dir):
    t = rows(spark, "id int, s string", HAN_LINES)
    return t.select("id", F.explode(T.tokens(F.col("s"), query=True)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


@query(rf"SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: w NOT IN {STOP_SQL})) AS BIGINT) AS n_kept, CAST(len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS BIGINT) AS n_words FROM documents")
def stopword_filter(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_kept"), F.size(F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN), 0)).cast("long").alias("n_words"))


@query("SELECT doc_id, CAST(trunc(1.3::DOUBLE * len(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS INT) AS est FROM documents")
def est_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.est_tokens(F.col("text")).alias("est"))


@query()
def search_stemmed(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return _hits(bm25.top(bm25.scores(bm25.query_terms(rows(spark, "query_id int, query string", [(1, "standing hereing tions")]), stem=True), bm25.build(d, stem=True), best=8), 8))


@query()
def snippet(spark, sf_dir):
    from ..functions import python as P

    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", P.snippet(F.col("text"), F.array(F.lit("tion"), F.lit("ere"), F.lit("stand"))).alias("s")).select("doc_id", "s.snippet", "s.matched")


# ---------------------------------------------------------------- blocks

LINES_SQL = "lines AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ln FROM documents)"
BLOCKS_SQL = """
heads AS (SELECT conv_id AS doc_id, turn + 1 AS page, 0 AS sub, 'heading' AS type, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, role AS text FROM conversations),
parts AS (SELECT conv_id AS doc_id, turn + 1 AS page, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS sub, 'paragraph' AS type, NULL::INT AS level, unnest(string_split(text, chr(10))) AS text FROM conversations),
blocks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, sub) AS block_no FROM (SELECT * FROM heads UNION ALL SELECT * FROM parts WHERE trim(text) <> ''))"""


def _blocks(spark, sf_dir) -> DataFrame:
    return blocks.conversation_blocks(read(spark, sf_dir, "conversations"))


def _lines(spark, sf_dir) -> DataFrame:
    return blocks.document_lines(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, page, printf('b%04d', block_no) AS block_id, type, level, md5(text) AS digest FROM blocks")
def block_numbering(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "page", "block_id", "type", "level", F.md5("text").alias("digest"))


ITEMS = [
    ("text", "Title", 1, None, 0), ("text", " body ", 0, None, 0), ("text", "   ", 0, None, 0), ("header", "Head", None, None, 0), ("page_number", "1", None, None, 0), ("equation", "$$ x^2 $$", None, None, 1), ("image", None, None, "a.png", 1),
    ("image", None, None, None, 1), ("seal", None, None, "s.png", 1), ("table", None, None, None, 2), ("ref_text", "[1] ref", None, None, 2), ("page_footnote", "note", None, None, 2), ("odd", "kept", None, None, 2), ("text", "Deep", 9, None, 2),
]


@query(
    f"WITH v(kind, text, text_level, img, page_idx) AS (VALUES {literals(ITEMS)}), i AS (SELECT row_number() OVER () AS pos, * FROM v), n AS (SELECT pos, page_idx + 1 AS page, "
    "CASE WHEN kind = 'text' AND coalesce(text_level, 0) > 0 THEN 'heading' WHEN kind IN ('text', 'ref_text') THEN 'paragraph' WHEN kind IN ('image', 'seal') THEN 'image' WHEN kind = 'page_footnote' THEN 'footnote' WHEN kind IN ('header', 'footer', 'page_number') THEN 'furniture' WHEN kind IN ('equation', 'table') THEN kind ELSE 'paragraph' END AS type, "
    "text_level, trim(coalesce(text, '')) AS t, img, CASE WHEN kind = 'odd' THEN kind END AS source_type FROM i) "
    "SELECT row_number() OVER (ORDER BY pos) AS block_no, page, type, CASE WHEN type = 'heading' THEN least(6, greatest(1, text_level)) END AS level, "
    "CASE WHEN type IN ('heading', 'paragraph', 'footnote', 'furniture') THEN t END AS text, CASE WHEN type = 'equation' THEN trim(trim(t, '$')) END AS latex, source_type FROM n WHERE type = 'table' OR t <> '' OR (type = 'image' AND img IS NOT NULL)"
)
def normalize_types(spark, sf_dir):
    raw = rows(spark, "pos int, type string, text string, text_level int, img_path string, page_idx int", [(i, *r) for i, r in enumerate(ITEMS)])
    have = set(raw.columns)
    missing = [c.split() for c in blocks.ITEM_SCHEMA.split(", ") if c.split()[0] not in have]
    items = raw.select(F.lit(1).alias("doc_id"), "*", *[F.lit(None).cast(k).alias(n) for n, k in missing])
    return blocks.normalised(items).select("block_no", "page", "type", "level", "text", "latex", "source_type")


@query("WITH n AS (SELECT conv_id AS doc_id, max(turn) + 1 AS n FROM conversations GROUP BY ALL) SELECT doc_id, unnest(range(1, n + 1)) AS page FROM n")
def page_dense(spark, sf_dir):
    return blocks.pages(_blocks(spark, sf_dir))


@query()
def html_blocks(spark, sf_dir):
    return readers.html_pages(read(spark, sf_dir, "pages"))


@query()
def html_table_grid(spark, sf_dir):
    from ..functions import python as P

    p = read(spark, sf_dir, "part").select("p_partkey", F.format_string("<table><tr><th rowspan=2>%s</th><td>%s</td></tr><tr><td>%s<br>x</td></tr></table>", "p_name", "p_brand", "p_type").alias("h"))
    return p.select("p_partkey", P.html_table_grid(F.col("h")).alias("g")).select("p_partkey", T.grid_to_gfm(F.col("g")).alias("gfm"))


@query("SELECT p_partkey, '| name | brand |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || replace(p_name, '|', '\\|') || ' | ' || p_brand || '\\|x |' AS gfm FROM part")
def gfm_table(spark, sf_dir):
    grid = F.array(F.array(F.lit("name"), F.lit("brand")), F.array(F.col("p_name"), F.concat("p_brand", F.lit("|x"))))
    return read(spark, sf_dir, "part").select("p_partkey", T.grid_to_gfm(grid).alias("gfm"))


# ---------------------------------------------------------------- scalar functions


def scalar(name: str, cases: list[tuple], f: Callable[[Column], Column], kind: str = "string"):
    """A query of one function over fixed texts; its expected values are part of the cases."""
    QUERIES[name] = lambda spark, sf_dir: rows(spark, "id int, s string", [(i, c[0]) for i, c in enumerate(cases)]).select("id", f(F.col("s")).cast(kind).alias("v"))
    ORACLES[name] = f"SELECT id, CAST(v AS {'VARCHAR' if kind == 'string' else 'BIGINT' if kind in ('int', 'long') else kind}) AS v FROM (VALUES {literals([(i, c[1]) for i, c in enumerate(cases)])}) t(id, v)"


scalar("numbering_depth", [("1 Intro", 1), ("2.1 Storage", 2), ("3.2.1. Deep", 3), ("IV. Roman", 1), ("A. Alpha", 2), ("第一章 绪论", 1), ("第二节 方法", 2), ("第三条 款", 3), ("一、背景", 1), ("（二）目标", 2), ("Appendix A Proofs", 1), ("Some prose here", None), ("A.no", None)], T.numbering_depth, "int")
scalar("escape_block_start", [("# x", "\\# x"), ("1. x", "1\\. x"), ("12) y", "12\\) y"), ("- x", "\\- x"), ("> q", "\\> q"), ("plain", "plain"), ("+ p", "\\+ p"), ("a # b", "a # b")], T.escaped_start)
scalar("heading_text", [("Results:", "Results"), ("结论。", "结论"), (" a \n b . ", "a b"), ("...", "Untitled")], T.heading_text)
scalar("tidy_math", [("see $ x^2 $ here", "see $x^2$ here"), ("costs $5 and $10", "costs $5 and $10"), ("none", "none")], T.tidy_math)
scalar("latex_fix", [("\\label{a} x", "x"), ("a \\hdots b", "a \\cdots b"), ("x \\nonumber", "x"), ("\\bm{v}", "\\boldsymbol{v}"), ("\\mathbf v", "\\mathbf v"), ("x\\textsuperscript{2}", "x^{2}")], T.fixed_latex)
scalar("one_line", [(" a \n  b ", "a b"), ("c", "c")], T.one_line)
scalar("display_fences", [("$$ x $$", "x"), ("\\[ y \\]", "y"), ("z", "z")], T.without_display_fences)
scalar("code_fence", [("a", "```"), ("a ``` b", "````"), ("``x``", "```")], T.fence)
scalar("page_offset", [("5-9", 4), ("2,4-6", 0), ("", 0), ("12", 11)], T.page_offset, "int")
scalar("line_range", [("7", "7-7"), ("9-3", "3-9"), ("2:4", "2-4"), ("x", None)], lambda c: F.when(T.range_of(c).isNotNull(), F.format_string("%d-%d", T.range_of(c)["first"], T.range_of(c)["last"])))
scalar("https_urls", [("git@host.org:a/b.git", "https://host.org/a/b"), ("https://tok@host.org/a/b", "https://host.org/a/b"), ("git://host.org/a/b.git", "https://host.org/a/b"), ("ssh://git@host.org/a/b.git", "https://host.org/a/b")], T.https_url)
scalar("escape_alt", [("a[b]\\c", "a\\[b\\]\\\\c")], T.escaped_alt)
scalar("inline_tags", [("<b>x</b> <i>y</i><br/>z <span class='q'>w</span>", "**x** *y* z w")], T.tags_to_markdown)
scalar("autolink", [("see https://a.example/b. Then", "see <https://a.example/b>. Then"), ("(https://a.example)", "(<https://a.example>)"), ("[x](https://a.example) http://a.b", "[x](https://a.example) http://a.b")], T.autolinked)
scalar("image_words", [("x ![alt](p.png) y", "x [image: alt] y")], T.images_as_words)
scalar("drop_thinking", [("<think>a\nb</think> c", "c"), ("d", "d")], T.without_thinking)
scalar("safe_names", [("a b/c.PDF", "a_b_c.PDF"), ("ü.md", "_.md")], T.safe_name)
scalar("mask_secret", [("sk-1234567890", "sk-1***90"), ("short", "***")], T.masked)
scalar("token_expiry", [("e30.eyJleHAiOiAxNzAwMDAwMDAwfQ.x", 1700000000)], T.token_expiry, "long")


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^(git|http|ssh)://', 'https://'), '(\\.git)?/?$', '') AS url, substr(sha256(html), 1, 16) AS content_id, substr(sha256(url), 1, 32) AS data_id FROM pages")
def page_identity(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.https_url(F.col("url")).alias("url"), T.doc_id(F.col("html")).alias("content_id"), T.data_id(F.col("url")).alias("data_id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ---------------------------------------------------------------- outline

@query(rf"WITH {BLOCKS_SQL} SELECT doc_id, block_no FROM blocks WHERE type = 'paragraph' AND trim(text) <> '' AND NOT contains(text, '$') AND NOT regexp_matches(trim(text), '[.。!?！？;；:：,，]$') AND len(list_filter(string_split_regex('2.1 ' || trim(text), '\s+'), lambda w: w <> '')) <= 14 AND length('2.1 ' || trim(text)) <= 90")
def missed_headings(spark, sf_dir):
    b = _blocks(spark, sf_dir).where("type = 'paragraph'").withColumn("t", F.concat(F.lit("2.1 "), F.trim("text")))
    return b.where(T.missed_heading(F.col("type"), F.col("t"))).select("doc_id", "block_no")


@query(
    f"WITH {BLOCKS_SQL}, h AS (SELECT *, level = 1 AND page <= 2 AS fits FROM blocks WHERE type = 'heading'), n AS (SELECT *, sum(fits::INT) OVER (PARTITION BY doc_id ORDER BY block_no) AS nth FROM h) "
    "SELECT doc_id, block_no, CASE WHEN fits AND nth = 1 THEN 1 ELSE 2 END AS prior FROM n"
)
def outline_priors(spark, sf_dir):
    return outline.priors(_blocks(spark, sf_dir).where("type = 'heading'")).select("doc_id", "block_no", "prior")


@query(
    f"WITH RECURSIVE {BLOCKS_SQL}, h AS (SELECT doc_id, block_no, 1 + (block_no * 7 + doc_id) % 6 AS level, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS i FROM blocks WHERE type = 'heading'), "
    "r AS (SELECT doc_id, i, block_no, level, level AS clamped FROM h WHERE i = 1 UNION ALL SELECT h.doc_id, h.i, h.block_no, h.level, least(h.level, r.clamped + 1) FROM r JOIN h ON h.doc_id = r.doc_id AND h.i = r.i + 1) "
    "SELECT doc_id, block_no, level, clamped FROM r"
)
def outline_clamp(spark, sf_dir):
    h = _blocks(spark, sf_dir).where("type = 'heading'").withColumn("level", 1 + (F.col("block_no") * 7 + F.col("doc_id")) % 6)
    return outline.clamped(h).select("doc_id", "block_no", "level", "clamped")


PATHS_SQL = (
    f"{BLOCKS_SQL}, anc AS (SELECT b.doc_id, b.block_no, b.type, b.level AS own, h.level, h.text, h.block_no AS hb FROM blocks b JOIN blocks h ON h.doc_id = b.doc_id AND h.type = 'heading' AND h.block_no <= b.block_no), "
    "live AS (SELECT * FROM anc a WHERE NOT EXISTS (SELECT 1 FROM blocks x WHERE x.doc_id = a.doc_id AND x.type = 'heading' AND x.block_no > a.hb AND x.block_no <= a.block_no AND x.level <= a.level)), "
    "paths AS (SELECT doc_id, block_no, string_agg(text, ' > ' ORDER BY level) AS path FROM live GROUP BY ALL)"
)


@query(f"WITH {PATHS_SQL} SELECT doc_id, block_no, path FROM paths")
def breadcrumbs(spark, sf_dir):
    return outline.breadcrumbs(_blocks(spark, sf_dir)).select("doc_id", "block_no", F.array_join("heading_path", " > ").alias("path"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, string_agg(level || ' ' || text || ' ' || page, '; ' ORDER BY block_no) AS outline, max(page) AS n_pages FROM blocks WHERE type = 'heading' GROUP BY ALL")
def outline_tree(spark, sf_dir):
    h = _blocks(spark, sf_dir).where("type = 'heading'")
    tree = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "level", "text", "page"))), lambda x: F.concat_ws(" ", x["level"], x["text"], x["page"]))
    return h.groupBy("doc_id").agg(F.array_join(tree, "; ").alias("outline"), F.max("page").alias("n_pages"))


@query(f"WITH {BLOCKS_SQL}, h AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY block_no) AS before FROM blocks WHERE type = 'heading') SELECT doc_id, block_no, level, before FROM h WHERE level > before + 1")
def heading_jump_check(spark, sf_dir):
    return check.heading_jumps(_blocks(spark, sf_dir).where("type = 'heading'")).select("doc_id", "block_no", "level", "before")


@query(f"WITH {BLOCKS_SQL}, h AS (SELECT doc_id, arg_min(level, block_no) AS first_level, sum((level = 1)::INT) AS n_titles FROM blocks WHERE type = 'heading' GROUP BY ALL) SELECT * FROM h WHERE first_level <> 1 OR n_titles <> 1")
def title_check(spark, sf_dir):
    return check.title_errors(_blocks(spark, sf_dir).where("type = 'heading'"))


@query(
    f"WITH {PATHS_SQL}, h AS (SELECT b.*, coalesce(substr(path, 1, length(path) - length(text) - 3), '') AS parent FROM blocks b JOIN paths USING (doc_id, block_no) WHERE type = 'heading') "
    "SELECT doc_id, block_no, text, row_number() OVER (PARTITION BY doc_id, parent, level, text ORDER BY block_no) AS nth FROM h QUALIFY nth > 1"
)
def sibling_heading_dup(spark, sf_dir):
    return check.repeated_siblings(outline.breadcrumbs(_blocks(spark, sf_dir))).select("doc_id", "block_no", "text", "nth")


@query()
def shaped_titles(spark, sf_dir):
    b = outline.title_first(_blocks(spark, sf_dir))
    return b.select("doc_id", "shaped_no", "block_id", "type", "level")


# ---------------------------------------------------------------- render, anchors, lines

MD_SQL = r"""
md AS (SELECT *, CASE WHEN type = 'heading' THEN repeat('#', level) || ' ' || text ELSE regexp_replace(trim(text), '^([-+*#>=].*|[0-9]{1,9}[.)].*)$', '\1') END AS md FROM blocks),
anchors AS (SELECT doc_id, block_no, page, type, level, text, md, 2 * row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS ln FROM md)"""


def _anchors(spark, sf_dir) -> DataFrame:
    return render.anchored(_blocks(spark, sf_dir))


@query(f"WITH {BLOCKS_SQL}, {MD_SQL} SELECT doc_id, md5(string_agg(md, chr(10) || chr(10) ORDER BY block_no)) AS digest FROM md GROUP BY ALL")
def render_markdown(spark, sf_dir):
    return render.assembled(_anchors(spark, sf_dir)).select("doc_id", F.md5("markdown").alias("digest"))


@query(f"WITH {BLOCKS_SQL}, {MD_SQL} SELECT doc_id, block_no, ln AS first, ln AS last FROM anchors")
def anchor_ranges(spark, sf_dir):
    return _anchors(spark, sf_dir).select("doc_id", "block_no", "first", "last")


@query()
def marker_ranges(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    marked = b.select("doc_id", F.explode(F.array(F.struct((F.col("block_no") * 3).alias("ln"), F.concat(F.lit("[["), "block_id", F.lit("]]")).alias("line")), F.struct((F.col("block_no") * 3 + 1).alias("ln"), F.col("text").alias("line")), F.struct((F.col("block_no") * 3 + 2).alias("ln"), F.lit("").alias("line")))).alias("x")).select("doc_id", "x.*")
    return render.marker_ranges(marked)


@query(
    f"WITH {LINES_SQL}, d AS (SELECT doc_id, ln, CASE WHEN ln % 5 = 3 THEN (ln - 1) // {PAGE_LINES} + 1 END AS direct FROM lines) "
    "SELECT doc_id, ln, coalesce(last_value(direct IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING), min(direct) OVER (PARTITION BY doc_id)) AS page FROM d"
)
def line_page_ffill(spark, sf_dir):
    direct = F.when(F.col("ln") % 5 == 3, F.floor((F.col("ln") - 1) / PAGE_LINES) + 1)
    return _lines(spark, sf_dir).select("doc_id", "ln", outline.filled_pages(None, direct).alias("page"))


# ---------------------------------------------------------------- chunks

def pack_sql(key: str, at: str, limit: int) -> str:
    """Table r (key, at, chunk_no): pieces of table e (key, at from 1, w words, o begins and z ends in a word) packed to limit as one text."""
    met, fits = "(e.w - (r.z AND e.o)::INT)", f"trunc(1.3::DOUBLE * (r.acc + e.w - (r.z AND e.o)::INT)) <= {limit}"
    return (
        f"r AS (SELECT {key}, {at}, w AS acc, coalesce(z, false) AS z, 0 AS chunk_no FROM e WHERE {at} = 1 UNION ALL SELECT {', '.join('e.' + k.strip() for k in key.split(','))}, e.{at}, "
        f"CASE WHEN {fits} THEN r.acc + {met} ELSE e.w END, CASE WHEN {fits} THEN coalesce(e.z, r.z) ELSE coalesce(e.z, false) END, CASE WHEN {fits} THEN r.chunk_no ELSE r.chunk_no + 1 END "
        f"FROM r JOIN e ON {' AND '.join(f'e.{k.strip()} = r.{k.strip()}' for k in key.split(','))} AND e.{at} = r.{at} + 1)"
    )


def words_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[A-Za-z0-9]+')) AS w, regexp_matches({text}, '^[A-Za-z0-9]') AS o, CASE WHEN {text} <> '' THEN regexp_matches({text}, '[A-Za-z0-9]$') END AS z"


PACK_SQL = f"{LINES_SQL}, e AS (SELECT doc_id, ln, line, CAST(trunc(1.3::DOUBLE * len(regexp_extract_all(line, '[A-Za-z0-9]+'))) AS BIGINT) AS est, {words_sql('line')} FROM lines), {pack_sql('doc_id', 'ln', T.TARGET_TOKENS)}"


def _packed(spark, sf_dir) -> DataFrame:
    p = _lines(spark, sf_dir).withColumn("est", T.est_tokens(F.col("line")))
    return chunks.packed(p, ["doc_id"], "ln", T.TARGET_TOKENS, "line")


@query(f"WITH RECURSIVE {PACK_SQL} SELECT doc_id, chunk_no, min(ln) AS first, max(ln) AS last, sum(est) AS est FROM r JOIN e USING (doc_id, ln) GROUP BY ALL")
def chunk_pack(spark, sf_dir):
    return _packed(spark, sf_dir).groupBy("doc_id", "chunk_no").agg(F.min("ln").alias("first"), F.max("ln").alias("last"), F.sum("est").alias("est"))


@query(
    f"WITH RECURSIVE {PACK_SQL} SELECT doc_id || '#' || printf('%04d', chunk_no) AS id, min((ln - 1) // {PAGE_LINES} + 1) AS page_min, max((ln - 1) // {PAGE_LINES} + 1) AS page_max, substr(sha1(string_agg(line, chr(10) || chr(10) ORDER BY ln)), 1, 12) AS sha1 FROM r JOIN e USING (doc_id, ln) GROUP BY doc_id, chunk_no"
)
def chunk_rows(spark, sf_dir):
    p = _packed(spark, sf_dir).select("doc_id", "chunk_no", "ln", F.col("line").alias("text"), F.col("ln").alias("first"), F.col("ln").alias("last"), (F.floor((F.col("ln") - 1) / PAGE_LINES) + 1).alias("page"), F.lit("text").alias("type"))
    return chunks.chunk_table(p, ["doc_id"], "ln").select("id", "page_min", "page_max", "sha1")


@query(
    rf"WITH RECURSIVE {BLOCKS_SQL}, e AS (SELECT doc_id, block_no, type, CASE WHEN type = 'paragraph' THEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) ELSE 40 END AS n FROM blocks), "
    "r AS (SELECT doc_id, block_no, n AS acc, 0 AS batch FROM e WHERE block_no = 1 UNION ALL SELECT e.doc_id, e.block_no, "
    "CASE WHEN r.acc + e.n > 6000 OR (e.type = 'heading' AND r.acc > 3000) THEN e.n ELSE r.acc + e.n END, CASE WHEN r.acc + e.n > 6000 OR (e.type = 'heading' AND r.acc > 3000) THEN r.batch + 1 ELSE r.batch END "
    "FROM r JOIN e ON e.doc_id = r.doc_id AND e.block_no = r.block_no + 1) SELECT doc_id, batch, count(*) AS n_blocks, min(block_no) AS first FROM r GROUP BY ALL"
)
def prose_batches(spark, sf_dir):
    return chunks.batched(_blocks(spark, sf_dir)).groupBy("doc_id", "batch").agg(F.count("*").alias("n_blocks"), F.min("block_no").alias("first"))


@query()
def markdown_blocks(spark, sf_dir):
    md = render.assembled(_anchors(spark, sf_dir)).select("doc_id", F.col("markdown").alias("text"))
    return chunks.markdown_blocks(md)


@query(
    rf"WITH RECURSIVE d AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?;])\s*', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE trunc(1.3::DOUBLE * len(regexp_extract_all(text, '[A-Za-z0-9]+'))) > {T.MAX_TOKENS}), "
    f"s AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS t FROM d), e AS (SELECT doc_id, i, t, {words_sql('t')} FROM s), {pack_sql('doc_id', 'i', T.MAX_TOKENS)}, "
    r"g AS (SELECT doc_id, chunk_no, string_agg(t, '' ORDER BY i) AS t FROM r JOIN e USING (doc_id, i) GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1 AS part, md5(t) AS digest FROM g WHERE regexp_matches(t, '\S')"
)
def long_split(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where(T.est_tokens(F.col("text")) > T.MAX_TOKENS).select("doc_id", F.lit("text").alias("type"), "text")
    return chunks.long_split(d).select("doc_id", "part", F.md5("text").alias("digest"))


TOTALS_SQL = "totals AS (SELECT doc_id, max(ln) AS total FROM anchors GROUP BY ALL)"


def _line_pages(spark, sf_dir) -> DataFrame:
    a = _anchors(spark, sf_dir)
    return outline.line_pages(a, a.groupBy("doc_id").agg(F.max("last").alias("total")))


@query(f"WITH {BLOCKS_SQL}, {MD_SQL} SELECT doc_id, unnest(CASE WHEN last THEN [ln] ELSE [ln, ln + 1] END) AS ln, page FROM (SELECT doc_id, ln, page, ln = max(ln) OVER (PARTITION BY doc_id) AS last FROM anchors)")
def line_page_map(spark, sf_dir):
    return _line_pages(spark, sf_dir)


@query(
    f"WITH RECURSIVE {BLOCKS_SQL}, {MD_SQL}, s AS (SELECT *, sum((type = 'heading')::INT) OVER w AS section, max(CASE WHEN level = 1 THEN block_no END) OVER w AS o1, max(CASE WHEN level = 2 THEN block_no END) OVER w AS o2, max(CASE WHEN level = 3 THEN block_no END) OVER w AS o3 "
    "FROM anchors WINDOW w AS (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING)), "
    "e AS (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY block_no) AS i, ln, page, md, "
    "concat_ws(' > ', CASE WHEN o1 IS NOT NULL THEN 'system' END, CASE WHEN o2 > coalesce(o1, -1) THEN 'user' END, CASE WHEN o3 > greatest(coalesce(o1, -1), coalesce(o2, -1)) THEN 'assistant' END) AS path, "
    f"{words_sql('md')} FROM s WHERE type <> 'heading'), {pack_sql('doc_id, section', 'i', T.TARGET_TOKENS)}, "
    "g AS (SELECT doc_id, section, chunk_no, any_value(path) AS path, min(ln) AS first, max(ln) AS last, min(page) AS page_min, max(page) AS page_max, string_agg(md, chr(10) || chr(10) ORDER BY i) AS t FROM r JOIN e USING (doc_id, section, i) GROUP BY ALL), "
    r"n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, chunk_no) - 1 AS seq FROM g) SELECT doc_id || '#' || printf('%04d', seq) AS id, path, first, last, page_min, page_max, substr(sha1(regexp_replace(t, '^\s+|\s+$', '', 'g')), 1, 12) AS sha1 FROM n"
)
def chunk_markdown(spark, sf_dir):
    md = render.assembled(_anchors(spark, sf_dir)).select("doc_id", F.col("markdown").alias("text"))
    c = chunks.chunk_markdown(md, _line_pages(spark, sf_dir))
    return c.select("id", F.array_join("heading_path", " > ").alias("path"), "first", "last", "page_min", "page_max", "sha1")


# ---------------------------------------------------------------- lookup

PREVIEW_SQL = f"{BLOCKS_SQL}, p AS (SELECT *, substr(regexp_replace(trim(text), '\\s*\\n\\s*', ' ', 'g'), 1, 100) AS preview FROM blocks)"


def _previews(spark, sf_dir) -> DataFrame:
    return _blocks(spark, sf_dir).withColumn("preview", blocks.preview(F.col("type"), F.col("text")))


def _located(q: str, where: str = "TRUE") -> str:
    every = " AND ".join(f"contains(lower(preview), '{w}')" for w in q.split())
    return f"WITH {PREVIEW_SQL} SELECT doc_id, block_no, type, CASE WHEN contains(lower(preview), '{q}') THEN 2 ELSE 1 END + starts_with(lower(preview), '{q}')::INT + (type = 'heading')::INT AS score FROM p WHERE preview <> '' AND ({every}) AND {where}"


@query(_located("en the"))
def locate_phrase(spark, sf_dir):
    return lookup.locate(_previews(spark, sf_dir), "en the", limit=None).select("doc_id", "block_no", "type", "score")


@query(_located("user", "type = 'heading'"))
def locate_type_alias(spark, sf_dir):
    return lookup.locate(_previews(spark, sf_dir), "user", kind="heading", limit=None).select("doc_id", "block_no", "type", "score")


@query(_located("an the of") + " ORDER BY score DESC, doc_id, page, block_no LIMIT 20")
def locate_terms(spark, sf_dir):
    return lookup.locate(_previews(spark, sf_dir), "an the of").select("doc_id", "block_no", "type", "score")


@query(f"WITH {LINES_SQL}, t AS (SELECT doc_id, max(ln) AS n FROM lines GROUP BY ALL) SELECT doc_id, min(ln) AS first, max(ln) AS last, md5(string_agg(line, chr(10) ORDER BY ln)) AS digest FROM lines JOIN t USING (doc_id) WHERE ln >= least(3, n) AND ln <= least(7, n) GROUP BY ALL")
def get_lines(spark, sf_dir):
    return lookup.text_of(lookup.lines_between(_lines(spark, sf_dir), 7, 3)).select("doc_id", "first", "last", F.md5("text").alias("digest"))


@query(f"WITH {BLOCKS_SQL}, {MD_SQL} SELECT doc_id, min(ln) AS first, max(ln) AS last FROM anchors WHERE page BETWEEN 2 AND 3 GROUP BY ALL")
def get_pages(spark, sf_dir):
    return lookup.page_hull(_anchors(spark, sf_dir), 2, 3)


def _sections(spark, sf_dir) -> DataFrame:
    a = _anchors(spark, sf_dir)
    return outline.section_ends(a.where("type = 'heading'").select("doc_id", "block_no", "level", "text", "first"), a.groupBy("doc_id").agg(F.max("last").alias("total")))


@query(
    f"WITH {BLOCKS_SQL}, {MD_SQL}, t AS (SELECT doc_id, max(ln) AS total FROM anchors GROUP BY ALL), h AS (SELECT * FROM anchors WHERE type = 'heading'), "
    "s AS (SELECT h.doc_id, h.block_no, h.text, h.ln AS first, coalesce((SELECT min(x.ln) FROM h x WHERE x.doc_id = h.doc_id AND x.block_no > h.block_no AND x.level <= h.level) - 1, total) AS last FROM h JOIN t USING (doc_id)) "
    "SELECT doc_id, block_no, first, last FROM s WHERE contains(text, 'assist') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY block_no) = 1"
)
def get_section(spark, sf_dir):
    return lookup.section(_sections(spark, sf_dir), "Assist").select("doc_id", "block_no", "first", "last")


@query(
    "WITH c AS (SELECT doc_id, text, substr(text, 1, 500) AS cut FROM documents), p AS (SELECT *, length(cut) - instr(reverse(cut), chr(10)) AS last_break FROM c) "
    "SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text WHEN contains(cut, chr(10)) AND last_break > 250 THEN substr(cut, 1, last_break) ELSE cut END) AS digest FROM p"
)
def get_truncate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(lookup.truncated(F.col("text"), 500)).alias("digest"))


@query("SELECT doc_id, source FROM documents WHERE list_contains([source, lang], 'src3')")
def list_by_tag(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("tags", F.array("source", "lang"))
    return d.where(F.array_contains("tags", "src3")).select("doc_id", "source")


@query(
    "WITH c AS (SELECT DISTINCT substr(sha256(text), 1, 16) AS id FROM documents), a AS (SELECT DISTINCT substr(sha256(text), 1, 6) AS asked FROM documents), m AS (SELECT asked, count(*) AS n, min(id) AS id FROM a JOIN c ON starts_with(c.id, a.asked) GROUP BY ALL) SELECT asked, CASE WHEN n = 1 THEN id END AS id, n FROM m"
)
def resolve_id(spark, sf_dir):
    c = read(spark, sf_dir, "documents").select(T.doc_id(F.col("text")).alias("id")).distinct()
    c = c.withColumn("name", F.concat(F.lit("n-"), "id")).withColumn("title", F.concat(F.lit("t-"), "id"))
    return lookup.resolved(c.select(F.substring("id", 1, 6).alias("asked")).distinct(), c)


# ---------------------------------------------------------------- catalog


@query("SELECT coalesce(o.doc_id, n.doc_id) AS id, coalesce(n.quality::VARCHAR, o.lang) AS lang, o.source AS source FROM documents o FULL JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY ALL) n ON o.doc_id = n.doc_id")
def catalog_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    new = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("string").alias("lang"))
    return catalog.upserted(old, new)


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders UNION ALL SELECT NULL, NULL WHERE FALSE")
def catalog_latest(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("seq"))
    return catalog.latest(o.withColumn("status", F.lit("old")).withColumn("seq", F.lit(0)).unionByName(o)).drop("seq")


@query("SELECT p_partkey AS asset_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphan_assets(spark, sf_dir):
    return catalog.orphans(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id")), read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("asset_id")))


@query("SELECT substr(sha256(text), 1, 16) AS content_id, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY ALL")
def content_dedupe(spark, sf_dir):
    return catalog.deduplicated(read(spark, sf_dir, "documents"))


@query("SELECT source, sha256('v1|' || string_agg(doc_id || ':' || sha256(text), '|' ORDER BY doc_id || ':' || sha256(text))) AS fingerprint FROM documents GROUP BY ALL")
def doc_fingerprint(spark, sf_dir):
    f = read(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("digest"))
    return catalog.fingerprint(f, "v1", "source")


@query("SELECT event_id AS request_id FROM events WHERE event_type = 'view' AND event_id + 1 NOT IN (SELECT event_id FROM events WHERE event_type <> 'view')")
def journal_ambiguous(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    sent = e.where("event_type = 'view'").select(F.col("event_id").alias("request_id"), F.lit("dispatch").alias("kind"))
    ended = e.where("event_type <> 'view'").select((F.col("event_id") - 1).alias("request_id"), F.lit("terminal").alias("kind"))
    return catalog.ambiguous(sent.unionByName(ended)).select("request_id")


@query("SELECT o.doc_id AS doc_id, o.quality AS old, n.toxic AS new FROM labels o JOIN labels n USING (doc_id) WHERE o.quality IS DISTINCT FROM n.toxic")
def decision_diff(spark, sf_dir):
    l = read(spark, sf_dir, "labels")  # noqa: E741
    return catalog.decision_changes(l.select("doc_id", F.col("quality").alias("c")), l.select("doc_id", F.col("toxic").alias("c")), ["doc_id"], "c")


# ---------------------------------------------------------------- checks and alignment


@query(
    "WITH t AS (SELECT p_partkey AS doc_id, 1 AS ln, '| a | b |' AS line FROM part UNION ALL SELECT p_partkey, 2, '| --- | --- |' FROM part UNION ALL SELECT p_partkey, 3, '| ' || p_brand || CASE WHEN p_size % 3 = 0 THEN ' | x | y |' ELSE ' | x |' END FROM part) "
    "SELECT doc_id, ln, len(string_split(line, '|')) - 2 AS n_cells, 2 AS n_head FROM t WHERE len(string_split(line, '|')) - 2 <> 2"
)
def table_width_check(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    line = F.concat(F.lit("| "), "p_brand", F.when(F.col("p_size") % 3 == 0, F.lit(" | x | y |")).otherwise(F.lit(" | x |")))
    t = p.select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.array(F.lit("| a | b |"), F.lit("| --- | --- |"), line)).alias("i", "line")).withColumn("ln", F.col("i") + 1)
    return check.table_widths(t).select("doc_id", "ln", "n_cells", "n_head")


BOXES = "SELECT p_partkey AS id, p_size AS x0, p_size % 7 AS y0, p_size + 10 + p_partkey % 5 AS x1, p_size % 7 + 12 AS y1 FROM part"


@query(
    f"WITH b AS ({BOXES}), m AS (SELECT a.id, b.id AS other, a.x0 ax0, a.y0 ay0, a.x1 ax1, a.y1 ay1, b.x0 bx0, b.y0 by0, b.x1 bx1, b.y1 by1 FROM b a JOIN b ON b.id = a.id + 1), "
    "w AS (SELECT *, greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0) AS common FROM m) "
    "SELECT id, other, round(common::DOUBLE / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - common), 6) AS iou, ax0 >= bx0 - 15 AND ay0 >= by0 - 15 AND ax1 <= bx1 + 15 AND ay1 <= by1 + 15 AS inside FROM w"
)
def iou_scores(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey")
    b = read(spark, sf_dir, "part").select(k.alias("id"), s.alias("x0"), (s % 7).alias("y0"), (s + 10 + k % 5).alias("x1"), (s % 7 + 12).alias("y1"))
    side = lambda p: b.select(*[F.col(c).alias(p + c) for c in b.columns])
    m = side("a").join(side("b"), F.col("bid") == F.col("aid") + 1)
    one, two = ({c: F.col(p + c) for c in ("x0", "y0", "x1", "y1")} for p in "ab")
    return m.select(F.col("aid").alias("id"), F.col("bid").alias("other"), F.round(T.iou(one, two), 6).alias("iou"), T.inside(one, two).alias("inside"))


def _boxed(d: DataFrame) -> DataFrame:
    n = F.col("block_no")
    return d.withColumn("x0", F.lit(50)).withColumn("x1", F.lit(950)).withColumn("y0", n * 40 % 900).withColumn("y1", n * 40 % 900 + 30)


@query()
def translation_assign(spark, sf_dir):
    b = _boxed(_blocks(spark, sf_dir).select("doc_id", F.col("page").cast("int").alias("page"), "block_no", "text"))
    i = b.where("block_no % 4 <> 0").withColumn("item_id", F.format_string("i%05d", "block_no")).withColumn("source", F.upper("text"))
    return align.matched(b, i).select("doc_id", "page", "block_no", "item_id", F.round("score", 6).alias("score"))


@query()
def fidelity_pairs(spark, sf_dir):
    from ..functions import python as P

    d = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return d.withColumn("b", F.lag("a").over(w)).where("b is not null").select("conv_id", "turn", F.round(P.fidelity(F.col("a"), F.col("b")), 6).alias("ratio"))


GATE_SQL = rf"""
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS k, text FROM blocks WHERE type = 'paragraph'),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, CASE WHEN k % 4 = 0 THEN k - 1 ELSE k END AS lo, CASE WHEN k % 4 = 0 THEN k - 1 WHEN k % 6 = 1 THEN k + 1 ELSE k END AS hi, CASE WHEN k % 5 = 0 THEN '<div> ' || text WHEN k % 7 = 0 THEN '' WHEN k % 11 = 0 THEN '| ' || text || ' |' ELSE text END AS md FROM p),
o AS (SELECT doc_id, k, hi <= n AS ordered, CASE WHEN hi <= n THEN hi ELSE 0 END AS top FROM c WHERE k = 1
  UNION ALL SELECT c.doc_id, c.k, c.hi <= c.n AND c.lo > o.top, CASE WHEN c.hi <= c.n AND c.lo > o.top THEN c.hi ELSE o.top END FROM o JOIN c ON c.doc_id = o.doc_id AND c.k = o.k + 1),
gated AS (SELECT doc_id, k AS seq, hi - lo + 1 AS n_ids, lo, hi, ordered, CASE WHEN hi > n THEN 'unknown ids' WHEN NOT ordered THEN 'ids out of order or not consecutive' WHEN trim(md) = '' THEN 'empty output'
  WHEN regexp_matches(md, '(?m)^\s{{0,3}}(#{{1,6}}\s|```|~~~|<[a-zA-Z!/]|\|.*\|\s*$|!\[)') THEN 'forbidden Markdown' END AS problem FROM o JOIN c USING (doc_id, k))"""


def _gated(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Paragraphs of conversations with made segments: one a paragraph, some going back, reaching over two, empty, or forbidden."""
    p = _blocks(spark, sf_dir).where("type = 'paragraph'").withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no")))
    known = p.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "block_id"))), lambda x: x["block_id"]).alias("known_ids"))
    k, text = F.col("k"), F.col("text")
    lo = F.when(k % 4 == 0, k - 1).otherwise(k)
    ids = F.slice(F.concat("known_ids", F.array(F.lit("b9999"))), lo, F.when((k % 4 != 0) & (k % 6 == 1), 2).otherwise(1))
    md = F.when(k % 5 == 0, F.concat(F.lit("<div> "), text)).when(k % 7 == 0, "").when(k % 11 == 0, F.concat(F.lit("| "), text, F.lit(" |"))).otherwise(text)
    source = F.when(F.size(ids) == 2, md).otherwise(text)
    return p, check.segment_gate(p.join(known, "doc_id").select("doc_id", k.alias("seq"), ids.alias("ids"), "known_ids", source.alias("source"), md.alias("markdown")))


@query(f"WITH RECURSIVE {BLOCKS_SQL}, {GATE_SQL} SELECT doc_id, seq, problem, problem IS NULL AS accepted FROM gated")
def segment_gate(spark, sf_dir):
    return _gated(spark, sf_dir)[1].select("doc_id", "seq", "problem", "accepted")


@query(f"WITH RECURSIVE {BLOCKS_SQL}, {GATE_SQL} SELECT doc_id, printf('b%04d', block_no) AS block_id FROM (SELECT doc_id, block_no, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS k FROM blocks WHERE type = 'paragraph') x WHERE NOT EXISTS (SELECT 1 FROM gated g WHERE g.doc_id = x.doc_id AND g.ordered AND x.k BETWEEN g.lo AND g.hi)")
def segment_missing(spark, sf_dir):
    return check.missing_ids(*_gated(spark, sf_dir))


@query(f"WITH RECURSIVE {BLOCKS_SQL}, {GATE_SQL} SELECT doc_id, count(*) FILTER (problem IS NULL) AS n_segments, CAST(coalesce(sum(n_ids) FILTER (problem IS NULL), 0) AS BIGINT) AS n_covered, CAST(count(*) - coalesce(sum(n_ids) FILTER (problem IS NULL), 0) AS BIGINT) AS n_fallback FROM gated GROUP BY ALL")
def segment_stats(spark, sf_dir):
    return check.segment_stats(*_gated(spark, sf_dir))


@query("WITH p AS (SELECT p_partkey AS doc_id, p_name, p_brand, printf('b%04d', p_partkey) AS b FROM part) SELECT doc_id, 1 AS seq, b AS ids, p_name AS markdown FROM p UNION ALL SELECT doc_id, 2, 'b0001+' || b, p_brand FROM p")
def segment_parse(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    b = F.format_string("b%04d", F.col("p_partkey"))
    reply = F.concat(F.lit("```md\nnoise\n[["), b, F.lit("]]\n"), "p_name", F.lit("\n\n [[b0001 + "), b, F.lit("]] \n "), "p_brand", F.lit(" \n```"))
    out = check.parse_segments(p.select(F.col("p_partkey").alias("doc_id"), reply.alias("text")))
    return out.select("doc_id", "seq", F.array_join("ids", "+").alias("ids"), "markdown")


# ---------------------------------------------------------------- inline text, kinds and rendering over a whole table

_SUBS = "'0123456789', '₀₁₂₃₄₅₆₇₈₉'"


@query(
    f"SELECT p_partkey, 'H' || translate(p_size::VARCHAR, {_SUBS}) || 'O x²⁺ y$_{{ab' || p_size || '}}$ **' || p_brand || '** *i* $a^2$ $5 and $ see <https://x.example/' || p_partkey || '>. http://a.b m $^{{\\text{{a b}}}}$ z$^{{\\dagger}}$' AS v FROM part"
)
def clean_inline(spark, sf_dir):
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    raw = F.concat(
        F.lit("H<sub>"), size, F.lit("</sub>O x<sup>2+</sup> y<SUB> ab"), size, F.lit("</SUB> <b>"), "p_brand", F.lit("</b><br/><i>i</i> $ a^2 $ $5 and $ see https://x.example/"), n,
        F.lit(". http://a.b <mark class='q'>m</mark> <sup>a b</sup> z<sup>†</sup><sub> </sub>"),
    )
    return read(spark, sf_dir, "part").select("p_partkey", T.clean_inline(raw).alias("v"))


def _mixed_items(spark, sf_dir) -> DataFrame:
    """Layout items of all kinds, one a part, in documents of a thousand."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey") % 9
    kinds = ("text", "image", "chart", "seal", "table", "code", "list", "equation", "odd")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (k + 1).cast("int"))
    name, one = F.col("p_name"), lambda c: F.array(c)
    given = {
        "type": kind, "text": F.when(kind.isin("text", "equation", "seal"), F.concat(F.lit(" "), name, F.lit(" "))), "page_idx": (F.col("p_partkey") % 5).cast("int"), "img_path": F.when(kind.isin("image", "chart"), F.concat(F.lit("i/"), "p_partkey", F.lit(".png"))),
        "image_caption": F.when(kind.isin("image", "chart"), one(F.concat(F.lit("# "), "p_brand"))), "chart_footnote": F.when(kind == "chart", one(F.lit("- n"))), "table_caption": F.when(kind == "table", one(F.col("p_brand"))), "code_caption": F.when(kind == "code", one(F.col("p_brand"))),
        "code_body": F.when(kind == "code", F.concat(F.lit("```py\n"), name, F.lit("\n```"))), "list_items": F.when(kind == "list", F.array(F.concat(F.lit("1. "), name), F.lit("  "), F.col("p_brand"))), "content": F.when(kind.isin("odd", "chart"), name),
    }
    cols = [given[n].alias(n) if n in given else F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in blocks.ITEM_SCHEMA.split(", "))]
    return p.select(F.floor(F.col("p_partkey") / 1000).cast("long").alias("doc_id"), F.col("p_partkey").alias("pos"), *cols)


KINDS_SQL = """
k AS (SELECT p_partkey // 1000 AS doc_id, p_partkey AS pos, p_partkey % 9 AS k, p_name AS name, p_brand AS brand FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS block_no, ['paragraph', 'image', 'chart', 'image', 'table', 'code', 'list', 'equation', 'paragraph'][k + 1] AS type,
  CASE WHEN k IN (0, 2, 3, 5, 8) THEN name END AS text, CASE WHEN k IN (1, 2) THEN '# ' || brand WHEN k IN (4, 5) THEN brand WHEN k = 3 THEN '' END AS caption, CASE WHEN k = 2 THEN '- n' WHEN k IN (1, 3, 4) THEN '' END AS footnote,
  CASE WHEN k = 6 THEN 'text' END AS role, CASE WHEN k = 8 THEN 'odd' END AS source_type FROM k)"""


@query(f"WITH {KINDS_SQL} SELECT doc_id, block_no, type, text, caption, footnote, role, source_type FROM n")
def normalize_kinds(spark, sf_dir):
    return blocks.normalised(_mixed_items(spark, sf_dir)).select("doc_id", "block_no", "type", "text", "caption", "footnote", "role", "source_type")


@query(
    f"WITH {KINDS_SQL} SELECT doc_id, block_no, CASE k WHEN 0 THEN name WHEN 1 THEN '![# ' || brand || '](i/' || pos || '.png)' || chr(10) || chr(10) || '\\# ' || brand "
    "WHEN 2 THEN '![# ' || brand || '](i/' || pos || '.png)' || chr(10) || chr(10) || '\\# ' || brand || chr(10) || chr(10) || name || chr(10) || chr(10) || '\\- n' WHEN 4 THEN brand || chr(10) || chr(10) || '| a |' || chr(10) || '| --- |' "
    "WHEN 5 THEN brand || chr(10) || chr(10) || '```py' || chr(10) || name || chr(10) || '```' WHEN 6 THEN '- 1\\. ' || name || chr(10) || '- ' || brand WHEN 7 THEN '$$' || chr(10) || name || chr(10) || '$$' ELSE name END AS md FROM n WHERE k <> 3"
)
def render_kinds(spark, sf_dir):
    b = blocks.normalised(_mixed_items(spark, sf_dir)).withColumn("gfm", F.when(F.col("type") == "table", "| a |\n| --- |"))
    return render.anchored(b).select("doc_id", "block_no", "md")
