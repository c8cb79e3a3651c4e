"""The library's queries against their SQL, and behaviours that SQL can't state."""

import glob
import math
import os
import re
import sys

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from lamina.functions import python as P  # noqa: E402
from lamina.functions import text as T  # noqa: E402
from lamina.operators import align, bm25, blocks, catalog, check, chunks, lookup, outline, render  # noqa: E402
from lamina.plans.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float("%.9g" % v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return int(v) if isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_tokens_of_mixed_scripts(spark):
    d = spark.createDataFrame([("钙钛矿 Solar cells running the",)], "s string")
    r = d.select(T.tokens(F.col("s")).alias("i"), T.tokens(F.col("s"), query=True).alias("q")).first()
    assert r.i == ["钙", "钛", "矿", "钙钛", "钛矿", "solar", "cells", "running"]
    assert r.q == ["钙钛", "钛矿", "solar", "cells", "running"]


def test_stems():
    pairs = {"running": "run", "cells": "cell", "efficiency": "effici", "caresses": "caress", "ponies": "poni", "hopping": "hop", "hoping": "hope", "generously": "generous", "skies": "sky", "news": "news"}
    assert {w: P.stem(w) for w in pairs} == pairs
    assert P.stem("naïve") == "naïve"


@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_indel_ratio(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    want = 100.0 if not a and not b else 200.0 * m[-1][-1] / (len(a) + len(b))
    assert abs(P.indel_ratio(a, b) - want) < 1e-9


def test_table_spans():
    grid = P.table_grid("<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c<br>d</td><td>e|f</td></tr><tr><td>g</td></tr></table>")
    assert grid == [["a", "b", "b"], ["a", "c d", "e|f"], ["g", "", ""]]
    assert P.table_grid("") == []
    assert P.table_grid("<table><tr><td rowspan='3'>a</td><th>b &amp; <b>c</b></th></tr></table>") == [["a", "b & c"], ["a", ""], ["a", ""]]
    assert P.table_grid("<tr><td>x<td rowspan=2>y<tr><td colspan=1>z<!-- <td>no -->") == [["x", "y"], ["z", "y"]]


def test_snippets():
    s, found = P.snippet_of("钙钛矿太阳能电池的 Efficiency is high.", ["钛矿", "effici"])
    assert "«钛矿»" in s and "«Efficiency»" in s and found == ["effici", "钛矿"]
    assert P.snippet_of("x" * 300, ["no"]) == ("x" * 200, [])


def test_page_blocks():
    got = P.page_blocks("<nav>menu</nav><h1>T</h1><p>a<br>b</p><ul><li>x</li></ul><script>z</script><footer>f</footer>")
    assert got == [("furniture", None, "menu"), ("heading", 1, "T"), ("paragraph", None, "a b"), ("list", None, "x"), ("furniture", None, "f")]


@settings(deadline=None, max_examples=5)
@given(st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=12), min_size=1, max_size=8))
def test_clamp_and_paths_against_loops(spark, docs):
    rows = [(d, 1, n, "heading", lv, f"h{n}") for d, levels in enumerate(docs) for n, lv in enumerate(levels, 1)]
    h = spark.createDataFrame(rows, "doc_id int, page int, block_no int, type string, level int, text string")
    got = {(r.doc_id, r.block_no): r.clamped for r in outline.clamped(h).collect()}
    paths = {(r.doc_id, r.block_no): r.heading_path for r in outline.breadcrumbs(h).collect()}
    for d, levels in enumerate(docs):
        last, stack = None, []
        for n, lv in enumerate(levels, 1):
            last = lv if last is None else min(lv, last + 1)
            assert got[d, n] == last
            while stack and stack[-1][0] >= lv:
                stack.pop()
            stack.append((lv, f"h{n}"))
            assert paths[d, n] == [t for _, t in stack]


def test_marker_ranges(spark):
    text = ["[[b0001]]", "A", "", "", "[[b0002+b0003]]", "B", "C", "", "[[b0004]]", "D", ""]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text, 1)], "doc_id int, ln int, line string")
    got = {r.block_id: (r.first, r.last) for r in render.marker_ranges(lines).collect()}
    assert got == {"b0001": (1, 1), "b0002": (3, 4), "b0003": (3, 4), "b0004": (6, 6)}


def test_markdown_blocks(spark):
    md = "# Doc\n\n## 1 Intro\n\ntext one\n\n```\n# no heading\n```\n\n$$\nx\n$$\n\n## 2 方法\n\n| a | b |\n| - | - |"
    got = [(r.kind, r.level, r.first, r["last"]) for r in chunks.markdown_blocks(spark.createDataFrame([(1, md)], "doc_id int, text string")).orderBy("block_no").collect()]
    assert got == [("heading", 1, 1, 1), ("heading", 2, 3, 3), ("text", 0, 5, 5), ("code", 0, 7, 9), ("math", 0, 11, 13), ("heading", 2, 15, 15), ("table", 0, 17, 18)]


def test_markdown_lines():
    """The line rule written out: what opens, what closes, and that no line is lost."""
    md = "a\n  ~~~ x\n\n# in\n~~~~\n| t |\n|-|\nb\n![i](u)\n\n![i](u)\n$$ x $$\n\n $$\ny\n$$ z\n### H ##\n```\nopen"
    got = [(b["kind"], b["level"], b["first"], b["last"]) for b in chunks.blocks_in(md)]
    assert got == [("text", 0, 1, 1), ("code", 0, 2, 5), ("text", 0, 6, 9), ("text", 0, 11, 12), ("math", 0, 14, 16), ("heading", 3, 17, 17), ("code", 0, 18, 19)]
    lines = md.split("\n")
    for b in chunks.blocks_in(md):
        if b["kind"] != "heading":
            assert b["text"] == "\n".join(lines[b["first"] - 1 : b["last"]])
    assert chunks.blocks_in(None) == chunks.blocks_in("\n \n") == []


def test_type_aliases(spark):
    b = spark.createDataFrame([(1, 1, "image", "a cat"), (1, 2, "chart", "a cat"), (1, 3, "table", "a cat")], "doc_id int, block_no int, type string, text string")
    assert blocks.ALIASES["image"] == ("image", "chart")
    with pytest.raises(ValueError):
        lookup.locate(b, "cat", kind="section")


def test_synthetic_title(spark):
    rows = [(1, 1, 1, "heading", 3, "First.", "b0001"), (1, 1, 2, "paragraph", None, "x", "b0002")]
    b = spark.createDataFrame(rows, "doc_id int, page int, block_no int, type string, level int, text string, block_id string")
    got = outline.title_first(b).orderBy("shaped_no").collect()
    assert [(r.block_id, r.level, r.text) for r in got] == [("b0000", 1, "First"), ("b0001", 3, "First."), ("b0002", None, "x")]


def test_gate_rejects_inventions(spark):
    src = "The quick brown fox jumps over the lazy dog near the river bank"
    rows = [(1, 1, ["b1"], ["b1", "b2", "b3"], src, src), (1, 2, ["b2"], ["b1", "b2", "b3"], src, src + " and then invented a long story nobody told before"), (1, 3, ["b3"], ["b1", "b2", "b3"], src, "# " + src), (1, 4, ["b9"], ["b1", "b2", "b3"], src, src)]
    s = spark.createDataFrame(rows, "doc_id int, seq int, ids array<string>, known_ids array<string>, source string, markdown string")
    assert [r.accepted for r in check.segment_gate(s).orderBy("seq").collect()] == [True, False, False, False]
    rows = [(1, 1, ['b2'], ['b1', 'b2', 'b3'], src, '<div>' + src), (1, 2, ['b1'], ['b1', 'b2', 'b3'], src, src), (1, 3, ['b3'], ['b1', 'b2', 'b3'], src + ' $x$', src + ' $\\frac{x$')]
    got = [r.problem for r in check.segment_gate(spark.createDataFrame(rows, s.schema)).orderBy('seq').collect()]
    assert got == ['forbidden Markdown', 'ids out of order or not consecutive', 'invalid formula']


def test_units_put_text_on_first_block(spark):
    m = spark.createDataFrame([(1, 1, 1, "i1", 0.9), (1, 1, 2, "i2", 0.9), (1, 1, 3, "i3", 0.9)], align.OUT)
    i = spark.createDataFrame([(1, 1, "i1", "u", "whole", "a"), (1, 1, "i2", "u", "whole", "b"), (1, 1, "i3", None, None, "c")], "doc_id long, page int, item_id string, unit string, unit_text string, text string")
    got = {r.block_no: r.text_tr for r in align.unit_texts(m, i).collect()}
    assert got == {1: "whole", 2: "", 3: "c"}


def test_search_masks_after_scoring(spark):
    c = spark.createDataFrame([("a#0", "a", None, "pasta with sauce"), ("b#0", "b", "zh", "pasta again"), ("c#0", "c", None, "other text")], "chunk_id string, doc_id string, lang string, text string")
    hits, terms = bm25.search(c, "pasta unknownword", lang="zh")
    assert [r.chunk_id for r in hits.collect()] == ["b#0"]
    assert {r.term: r.known for r in terms.collect()} == {"pasta": True, "unknownword": False}
    assert bm25.search(c, "pasta", doc_ids=["c"])[0].count() == 0


def test_locate_unknown_type(spark):
    b = spark.createDataFrame([(1, 1, 1, "table", "Table 1")], "doc_id int, page int, block_no int, type string, preview string")
    assert lookup.locate(b, "table 1", kind="table").count() == 1
    with pytest.raises(ValueError):
        lookup.locate(b, "x", kind="nothing")


def test_get(spark):
    lines = blocks.document_lines(spark.createDataFrame([(1, "# A\n\np\n\n## B\n\nq")], "doc_id int, text string"))
    anchors = spark.createDataFrame([(1, 1, 1, 1, 1, "A"), (1, 2, 1, 3, 3, None), (1, 3, 2, 5, 5, "B"), (1, 4, 2, 7, 7, None)], "doc_id int, block_no int, page int, first int, last int, text string")
    sections = spark.createDataFrame([(1, 3, "B", 5, 7)], "doc_id int, block_no int, text string, first int, last int")
    assert lookup.get(lines, anchors, sections, 1, pages="2").first().text == "## B\n\nq"
    assert lookup.get(lines, anchors, sections, 1, span="1-3").first().text == "# A\n\np"
    assert lookup.get(lines, anchors, sections, 1, heading="b").first().text == "## B\n\nq"
    cut = lookup.get(lines, anchors, sections, 1, max_chars=4).first()
    assert cut.truncated and cut.text == "# A"


def test_empty_tables(spark):
    e = spark.createDataFrame([], "chunk_id long, text string")
    assert bm25.build(e).totals.first().n == 0
    assert catalog.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_streaming_index(spark, tmp_path):
    from lamina.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"doc_id": 1, "text": "alpha beta alpha", "lang": "en"}\n')
    ingest.start(ingest.documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.term, r.tf) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("alpha", 2), ("beta", 1)}


def test_fidelity_of_whole_turns(spark, tmp_path):
    same = "the same words " * 200  # 3,000 characters
    rows = [(1, 0, "user", same + "a" * 1000), (1, 1, "user", same + "b" * 1000)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.ratio for r in QUERIES["fidelity_pairs"](spark, str(tmp_path)).collect()] == [75.0]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 .!。钛\n", max_size=60), st.integers(1, 12))
def test_sentences_within(text, limit):
    """Parts hold all sentences in order, keep within the limit unless one sentence alone passes it, and none could have taken the next sentence."""
    est = lambda x: sum(c == "钛" for c in x) + int(1.3 * len(re.findall("[A-Za-z0-9]+", x)))
    parts = chunks.sentences_within(text, limit)
    assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)
    for a, b in zip(parts, parts[1:]):
        assert est(a + re.split(r"(?<=[。.!])\s*", b)[0]) > limit


def test_chunks_of_odd_texts(spark):
    """Null, empty and blank texts give no chunk; words that meet between blocks count once; sections never share a chunk."""
    md = "before\n\n# T ![x](u)\n\na\n\nb\n\n## S\n\n" + "w " * 400 + "\n\nend"
    d = spark.createDataFrame([(1, md), (2, None), (3, ""), (4, " \n ")], "doc_id int, text string")
    got = [(r.id, r.heading_path, r.first, r["last"], r.kinds, r.index_text.split("\n")[0]) for r in chunks.chunk_markdown(d).orderBy("id").collect()]
    assert got == [("1#0000", [], 1, 1, ["text"], ""), ("1#0001", ["T x"], 5, 7, ["text"], "T x"), ("1#0002", ["T x", "S"], 11, 11, ["text"], "S"), ("1#0003", ["T x", "S"], 13, 13, ["text"], "S")]


def test_cells_and_scripts(spark):
    d = spark.createDataFrame([("a|b $x|y$ \\(p\\|q\\)", "x<sup>$n$</sup><sub></sub><sup><i>12</i></sup> <s>k</s> <section>")], "c string, t string")
    r = d.select(T.cell(F.col("c")).alias("c"), T.clean_inline(F.col("t")).alias("t")).first()
    assert r.c == "a\\|b $x\\vert y$ $p\\Vert q$"
    assert r.t == "x$^{n}$¹² k <section>"


def _texts(spark):
    rows = [(i, f"w{i % 3} w{i % 5} w{i % 5} common") for i in range(40)] + [(50, "the of"), (51, None), (52, ""), (60, "w1 w2"), (60, ""), (60, "w2 w9"), (61, ""), (61, None)]
    return spark.createDataFrame(rows, "chunk_id long, text string")


def test_index_counts_and_scores_without_shuffles(spark):
    """Only sums a term cross tasks: no posting and no score of a chunk does."""
    index = bm25.build(_texts(spark).where("chunk_id < 60"))
    terms = bm25.query_terms(spark.createDataFrame([(1, "w1 w2 w2"), (2, "w4 missing")], "query_id int, query string"))
    for d in (index.postings, bm25.scores(terms, index)):
        assert "Exchange hash" not in d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stem", [False, True])
def test_scores_against_loops(spark, tmp_path, monkeypatch, stem):
    from collections import Counter
    from math import log

    chunks = _texts(spark)
    index = bm25.build(chunks, stem)
    bags = {}
    for i, text in [tuple(r) for r in chunks.collect()]:
        bags.setdefault(i, []).append([w for w in (text or "").split() if w not in ("the", "of")])
    bags = {i: Counter([w for p in parts for w in p] or [bm25.SENTINEL] * len(parts)) for i, parts in bags.items()}
    assert {(r.chunk_id, r.term): (r.dl, r.tf) for r in index.postings.collect()} == {(i, w): (b.total(), n) for i, b in bags.items() for w, n in b.items()}
    mean = sum(b.total() for b in bags.values()) / len(bags)
    wanted = {}
    for q, words in ((1, ["w1", "w2", "w2"]), (2, ["w4", "common"])):
        for i, b in bags.items():
            idf = lambda w: log(1 + (len(bags) - sum(w in x for x in bags.values()) + 0.5) / (sum(w in x for x in bags.values()) + 0.5))
            s = sum(idf(w) * b[w] / (b[w] + 1.2 * (0.25 + 0.75 * b.total() / mean)) for w in words if w in b)
            if s:
                wanted[q, i] = round(s, 9)
    terms = bm25.query_terms(spark.createDataFrame([(1, "w1 w2 w2"), (2, "w4 common")], "query_id int, query string"), stem)
    same = lambda d: {(r.query_id, r.chunk_id): round(r.score, 9) for r in d.collect()}
    ranks = lambda d: sorted((r.query_id, r.rank, r.chunk_id) for r in bm25.top(d, 3).collect())
    bm25.save(index, chunks, str(tmp_path))
    best = sorted((q, n + 1, i) for q in (1, 2) for n, (_, i) in enumerate(sorted((-s, i) for (p, i), s in wanted.items() if p == q)[:3]))
    for cells, weights, sent in ((2_000_000, 500_000, 1_000_000), (7, 1, 0)):
        monkeypatch.setattr(bm25, "CELLS", cells), monkeypatch.setattr(bm25, "WEIGHTS", weights), monkeypatch.setattr(bm25, "SENT", sent)
        for x in (index, bm25.load(spark, str(tmp_path))):
            assert same(bm25.scores(terms, x)) == wanted
            assert ranks(bm25.scores(terms, x, best=3)) == best


def test_index_is_saved_from_two_passes_over_texts(spark, tmp_path):
    """Postings and lengths; the test for repeated ids and the stamp read no words. A range of terms would cost a pass more."""
    passes = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    chunks = _texts(spark).where("chunk_id < 60").coalesce(1)
    index = bm25.build(chunks)
    index.words = index.words.mapInArrow(count, index.words.schema)
    index.postings = bm25._postings(index.words)
    bm25.save(index, chunks, str(tmp_path))
    assert passes.value == chunks.count()
    stored = bm25.load(spark, str(tmp_path))
    assert sorted(stored.terms.collect()) == sorted(index.terms.collect()) and stored.totals.collect() == index.totals.collect()


def test_missing_ids_need_no_texts(spark):
    from lamina.plans import queries

    plan = queries.QUERIES["segment_missing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_pages_matched_against_loops(spark, monkeypatch):
    """Every pair compared, as the rule says; the operator compares fewer."""
    import random

    from lamina.functions import python as P

    g, box = random.Random(5), ("x0", "y0", "x1", "y1")
    made = lambda kind, n: [(d, p, kind(i), g.choice([None, "", "ab" * g.randrange(4), "abc" * 150, "xyz"]), 0, y := g.randrange(3) * 10, 50, y + 10) for d in (1, None) for p in (1, 2) for i in range(n)]
    b, i = made(int, 6), made(lambda x: f"i{x}", 5)
    wanted = []
    for key in {r[:2] for r in b}:
        used = set()
        for x in [r for r in b if r[:2] == key]:
            best, at = align.LEAST, None
            for y in [r for r in i if r[:2] == key and r[2] not in used]:
                w = max(0, min(x[6], y[6]) - max(x[4], y[4])) * max(0, min(x[7], y[7]) - max(x[5], y[5]))
                s = 0.6 * P.indel_ratio((x[3] or "")[:400], (y[3] or "")[:400]) / 100 + 0.4 * (w / (500 + 500 - w))
                if s > best or at is None and s >= best:
                    best, at = s, y[2]
            if at is not None:
                used.add(at)
                wanted.append((*key, x[2], at, best))
    kinds = ", ".join(f"{c} int" for c in box)
    got = align.matched(spark.createDataFrame(b, f"doc_id long, page int, block_no int, text string, {kinds}"), spark.createDataFrame(i, f"doc_id long, page int, item_id string, source string, {kinds}"))
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in got.collect())
    rows = [[r | {"text": "a" * 400, "source": "a" * 400} for r in (dict(zip(("block_no", *box), (n, 0, n * 20, 50, n * 20 + 10))) | {"item_id": f"i{n}"} for n in range(12))]] * 2
    calls = []
    monkeypatch.setattr(P, "indel_ratio", lambda a, b, f=P.indel_ratio: calls.append(1) or f(a, b))
    assert len(align.chosen(*rows)) == 12 and len(calls) == 12
