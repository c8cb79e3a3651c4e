"""Each operator against brute force, an exact round trip or held-out rows, and on odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm import bpe, chat, common, components, lm_score, minhash, packing, quality_net, quality_rules, secret_scan, toxicity, vector_dedup
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def pairs(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r) for r in df.collect())


def empty_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# ------------------------------------------------ components


@settings(deadline=None, max_examples=2)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=25))
def test_components(spark, edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components.components(edges).collect()} == {0}


# ------------------------------------------------ 1 toxicity


@pytest.mark.parametrize("common", [0, 7, 1024])
def test_toxicity_nearest_is_exact(monkeypatch, common):
    monkeypatch.setattr(toxicity, "COMMON", common)
    g = np.random.default_rng(0)
    terms = [f"t{i}".encode() for i in range(30)]
    texts = [" ".join(f"t{i}" for i in g.integers(0, 30, g.integers(1, 8))) for _ in range(300)]
    index = toxicity.Index(terms, np.linspace(1, 3, 30), list(range(300)), [0, 1] * 150, texts)
    dense = np.zeros((300, 30))
    for i, t in enumerate(texts):
        at, w = index.vectors([t])[0]
        dense[i, at] = w
    found = index.nearest(index.vectors(texts[:60]), toxicity.K)
    for t, (e, s) in zip(texts[:60], found, strict=True):
        at, w = index.vectors([t])[0]
        q = np.zeros(30)
        q[at] = w
        all_ = dense @ q
        want = sorted(((-round(s, 9), i) for i, s in enumerate(all_) if s > 1e-12))[: toxicity.K]
        assert np.allclose(s, [-x for x, _ in want], atol=1e-8)


def test_toxicity_held_out(spark):
    bad, good = ["idiot", "moron", "scum"], ["tree", "house", "river", "cloud", "stone"]
    g = np.random.default_rng(1)
    rows = [(i, " ".join(g.choice(good, 30)) + (" " + g.choice(bad) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.toxicity(d.drop("toxic"), toxicity.train(d.drop("toxic"), d.select("doc_id", "toxic"))).collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.doc_id % 4 == 0) == int(r.score >= 0.7)


def test_toxicity_query_by_hand(spark, documents, labels):
    """Every column of the whole query against cosines over all examples, dense and in double precision."""
    d = documents.select("doc_id", "text")
    model = toxicity.train(d, labels)
    ix, sample = model.index, toxicity.labelled_sample(d, labels, "toxic", toxicity.FIT_ROWS)
    places = {t: i for i, t in enumerate(ix.space.place)}

    def vector(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
        words = re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]", " ", low).encode().split()
        v = np.zeros(len(places))
        for t, n in Counter(t for w in words for t in (w, *(b"^" + w[:n] for n in toxicity.PREFIXES if len(w) >= n))).items():
            if t in places:
                v[places[t]] = (1 + math.log(n)) * ix.idf[places[t]]
        return v / np.linalg.norm(v) if v.any() else v

    matrix = np.stack([v for r in sample if (v := vector(r[1])).any()])
    out = {r.doc_id: r for r in toxicity.toxicity(d, model).collect()}
    for r in documents.limit(60).collect():
        cosine = matrix @ vector(r.text or "")
        best = sorted((-round(s, 9), i) for i, s in enumerate(cosine) if s > 1e-12)[: toxicity.K]
        got = out[r.doc_id]
        assert np.allclose(got.cosines, [-s for s, _ in best], atol=1e-7)
        weights = [1 / (1.02 - min(s, 1.0)) for s in got.cosines]
        near = dict(zip(ix.ids.tolist(), ix.labels.tolist(), strict=True))
        vote = (sum(w * near[i] for w, i in zip(weights, got.neighbours, strict=True)) + ix.base) / (sum(weights) + 1)
        vote = min(max(vote, 1e-4), 1 - 1e-4)
        assert abs(got.score - 1 / (1 + math.exp(-(model.slope * math.log(vote / (1 - vote)) + model.shift)))) < 1e-6
        assert got.predicted == int(got.score >= 0.7) and got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_toxicity_learns_rare_words(spark):
    """Thirty words of about five examples each, none of which a test at the usual levels would tell from chance."""
    g = np.random.default_rng(4)
    bad, good = ["".join(g.choice(list("bcdfgkmpvz"), 9)) for _ in range(30)], [f"{c}tree" for c in "abcdefghij"]
    rows = [(i, " ".join(g.choice(good, 20)) + (" " + bad[i // 4 % 30] if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = [r for r in toxicity.toxicity(d.drop("toxic"), toxicity.train(d.drop("toxic"), d.select("doc_id", "toxic"))).collect() if r.held_out]
    assert np.mean([r.predicted for r in held if r.doc_id % 4 == 0]) > 0.9
    assert np.mean([r.predicted for r in held if r.doc_id % 4]) < 0.02


# ------------------------------------------------ 2 packing


def test_plan_is_whole_and_tight():
    g = np.random.default_rng(3)
    demand = np.bincount(np.minimum(4096, g.lognormal(5.5, 1, 3000).astype(int) + 1), minlength=4097)
    p = packing.plan(demand)
    got = Counter()
    for config, n in p:
        assert sum(config) <= 4096 and n > 0
        for length in config:
            got[length] += n
    assert got == {i: int(n) for i, n in enumerate(demand) if n}
    assert sum(n for _, n in p) <= math.ceil(demand @ np.arange(4097) / 4096 * 1.01) + 1


def filled(p):
    return sum(n for _, n in p)


def test_program_beats_best_fit_and_places_most():
    """Lengths of which best-fit alone wastes two sequences in eleven; and a usual histogram, of which the program places nearly all and reaches its own bound."""
    hard = np.zeros(4097, np.int64)
    hard[[2089, 1106, 1065, 942]] = 6000, 6000, 6000, 12_000
    started, due, bound = packing.programmed(hard)
    assert not due.any() and filled(started) == 9000 == round(bound)
    assert filled(packing.best_fit(hard, [])) == 11_000
    g = np.random.default_rng(8)
    usual = np.bincount(np.minimum(4096, g.lognormal(6, 1, 6000).astype(int) + 1), minlength=4097)
    started, due, bound = packing.programmed(usual)
    assert due.sum() < 0.05 * usual.sum()
    assert bound <= filled(packing.plan(usual)) <= np.ceil(bound) + 2


@settings(deadline=None, max_examples=25)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 4)), min_size=1, max_size=4))
def test_bound_and_minimality(sizes):
    """On small histograms the plan is never under its bound, and at most one over the fewest sequences."""
    demand = np.zeros(13, np.int64)
    for length, n in sizes:
        demand[length] += n
    items = tuple(int(i) for i in np.repeat(np.arange(13), demand))[::-1]

    def fewest(k, rooms, best):
        if len(rooms) >= best:
            return best
        if k == len(items):
            return len(rooms)
        for i, room in enumerate(rooms):
            if room >= items[k] and room not in rooms[:i]:
                best = fewest(k + 1, (*rooms[:i], room - items[k], *rooms[i + 1 :]), best)
        return fewest(k + 1, (*rooms, 12 - items[k]), best)

    _, bound = packing.duals(demand, 12)
    got = filled(packing.plan(demand, 12))
    if len(items) <= 8:
        assert np.ceil(bound - 1e-6) <= fewest(0, (), 99) <= got <= fewest(0, (), 99) + 1
    assert got >= np.ceil(bound - 1e-6)


def test_packing_against_the_library(spark, documents, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for d in (documents, odd):
        texts = {}
        for r in d.collect():
            texts.setdefault(r.doc_id, r.text or "")
        by, places, n = {}, {}, 0
        for r in packing.pack(d, path).collect():
            n += 1
            by.setdefault(r.doc_id, {})[r.piece] = r
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for doc, text in texts.items():
            ids = [*t.encode(text, add_special_tokens=False).ids, 1]
            assert len(by[doc]) == -(-len(ids) // 4096)
            for k, r in by[doc].items():
                part = ids[4096 * k : 4096 * (k + 1)]
                assert (r.start, r.length, r.ids_crc32) == (4096 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        for spans in places.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 4096


# ------------------------------------------------ 3 quality rules


def rules_by_hand(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed)


def test_quality_rules(spark, documents, labels, odd):
    model = quality_rules.train(documents, labels, 50)
    for d in (documents, odd):
        texts = Counter((r.doc_id, rules_by_hand(r.text)) for r in d.collect())
        out = quality_rules.quality_rules(d, model).collect()
        assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in out) == texts
        assert all(r.kept == (not r.base_failed and r.prob >= quality_rules.KEEP_FROM) for r in out)
        assert quality_rules.keep_good(d, model).count() == sum(r.kept for r in out)


# ------------------------------------------------ 4 vectors


@pytest.mark.parametrize("many", [0, 600])
def test_vectors_against_brute_force(spark, many):
    g = np.random.default_rng(2)
    base = g.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + g.normal(0, 0.03, 16) * (i % 3)).tolist(), i % 2) for i in range(200)]
    rows += [(1000 + i, base[0].tolist() if i % 2 else (base[0] + g.normal(0, 0.02, 16)).tolist(), 0) for i in range(many)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, base[1].tolist(), None), (904, base[0][:4].tolist(), 0), (905, [], 0), (906, [None] * 16, 0), (907, (base[0] * 5).tolist(), 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(d).collect()}
    ok = [(i, np.array(v), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and any(v)]
    n, up = Counter(), {i: i for i, _, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, x, k), (j, y, m) = ok[a], ok[b]
            if k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                n[i] += 1
                n[j] += 1
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    for i, _, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], top(i), top(i) == i), i


def test_odd_vectors(spark):
    """Labels that are words, null and repeated ids, and extra columns whose names clash with inner ones."""
    rows = [(1, [1.0, 0.0], "a b", 1, 2), (1, [1.0, 0.0], "a b", 1, 2), (2, [1.0, 0.01], "a b", 1, 2), (3, [1.0, 0.0], "c", 1, 2), (None, [1.0, 0.0], "a b", 1, 2), (4, [1.0, 0.0], None, 1, 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, h1 int, cell int")
    out = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(d).collect()))
    assert out == [(-1, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_no_vectors(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ------------------------------------------------ 5 secrets


SECRETS = ["password = 'abc123!'", 'API_KEY: "abcdef"', "Token=ab", "AKIA" + "A1" * 8, "AKIAshort", "f" * 24, "0" * 23, "secret=" + "0af" * 10, "ſecret=abcdefgh", "passwd=x" * 3, "token = é token=abcdef1"]


def spans_by_hand(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def cases_of(texts):
    rows = list(secret_scan.labelled(texts))
    return [r[1:] for r in rows], [r[0] for r in rows]


def test_secrets(spark, odd):
    net = secret_scan.fit(*cases_of([f"here is {s} in a text" for s in SECRETS]))
    texts = [f"before {s} after ü {s}" for s in SECRETS]
    for t in texts:
        assert secret_scan.base_spans(t) == spans_by_hand(t)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.secret_scan(d, net).collect():
        base = spans_by_hand(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(secret_scan.written(base).encode()).hexdigest()
        assert {x for x in secret_scan.written(base).split(",") if x} <= set(r.spans.split(","))
    masked = {r.doc_id: r.text for r in secret_scan.mask_secrets(d, net).collect()}
    assert not any("f" * 24 in t for t in masked.values())
    assert secret_scan.secret_scan(odd, net).count() == len(ODD) == secret_scan.mask_secrets(odd, net).count()


def test_secrets_beyond_mixed_runs():
    """Values of assignments, short or with signs, and runs of letters or digits alone are judged, and words after a colon are not taken."""
    g = np.random.default_rng(8)
    run = "".join(g.choice(list("bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ"), 32))
    texts = ['so pwd = "Tr0ub4dor&3" there', "the auth_key: hunter2x there", 'a password = "S3c!ret" there', f"and {run} there", "auth=83650194726583016492 there", "secret=abc123def@#9Z there"]
    scanner = secret_scan.Scanner(secret_scan.fit([], []))
    for t, want in zip(texts, ["Tr0ub4dor&3", "hunter2x", "S3c!ret", run, "83650194726583016492", "@#9Z"], strict=True):
        _, every, _ = scanner.spans([t])[0]
        assert want not in secret_scan.masked(t, every), (t, every)
    plain = ["Please note: nothing else happened here", 'the title="some other words" was', "size = 1200 at http://other.site.com/house", "a very internationalisation word"]
    assert [every for _, every, _ in scanner.spans(plain)] == [[]] * 4


def test_secret_net_by_hand():
    """Probabilities of the query against the network's sums written out; a key in the middle of a long run is seen; the threshold keeps the asked recall."""
    net = secret_scan.fit([], [])
    assert net.report["recall"] >= secret_scan.RECALL - 0.005 and net.report["findings"] > 100
    g = np.random.default_rng(3)
    key = "".join(g.choice(list("ABCDEFGHJKMNPQRSTUVWXYZ23456789abcdefghjkmnpqrstuvwxyz"), 40))
    text = "see /home/pages/" + "letters/" * 8 + key + "/letters" * 8 + " there"
    text = text.replace("/", "_")
    a, b = secret_scan.candidates(text)[0]
    views = secret_scan.views(text, a, b)
    assert len(views) > 4 and {c for v in views for c in range(text.index(v[0]), text.index(v[0]) + len(v[0]))} >= set(range(a, b))
    code = {**{c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}, **{c: 0 for c in "abcdef"}, **{c: 26 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: 27 for c in "0123456789"}, **{chr(c): 28 + i for i, c in enumerate(b"=:_-+/.\"' ")}}
    probs = []
    for t, s, e in views:
        left, right = t[max(0, s - 24) : s], t[e : e + 24]
        head, tail = t[s : min(e, s + 24)], t[max(s, e - 24) : e]
        x = [39] * (24 - len(left)) + [code[c] for c in left] + [code[c] for c in head] + [39] * (48 - len(head) - len(tail)) + [code[c] for c in tail] + [code[c] for c in right] + [39] * (24 - len(right))
        n, w = 96 - 5 + 1, net.p["w"]
        r = [[max(0.0, net.p["b"][f] + sum(w[k][x[i + k]][f] for k in range(5))) for f in range(16)] for i in range(n)]
        z, at = net.p["d"][0], 0
        quarters = [[int(i) for i in q] for q in np.array_split(np.arange(n), 4)]
        for kind in (max, lambda v: sum(v) / len(v)):
            for q in quarters:
                for f in range(16):
                    z += net.p["o"][at] * kind([r[i][f] for i in q])
                    at += 1
        probs.append(1 / (1 + math.exp(-(net.slope * z + net.shift))))
    assert abs(secret_scan.Scanner(net).spans([text])[0][2] - max(probs)) < 1e-9
    assert max(probs) >= net.threshold


def test_secret_net_tells_keys_from_words():
    net = secret_scan.fit([], [])
    made = secret_scan.key_samples(seed=99, n=60)
    assert (net.probability(secret_scan.windows(made)) >= net.threshold).mean() > 0.8
    assert (net.probability(secret_scan.windows(secret_scan.decoys(seed=98, n=60))) >= net.threshold).mean() < 0.1


def test_secret_net_learns_from_all(spark):
    """Every finding and every other candidate counts, however many; made keys are still told from decoys."""
    g = np.random.default_rng(5)
    keys = ["AKIA" + "".join(k) for k in g.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), (6000, 16))]
    rows = [(i, f"the key {k} was here, colour: blueish{i}") for i, k in enumerate(keys)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cases = secret_scan.all_cases(documents)
    assert {r.y: r["count"] for r in cases.groupBy("y").count().collect()} == {0: 6000, 1: 6000}
    net = secret_scan.train(documents)
    assert net.report["findings"] == cases.where("held and y = 1").count() + int(secret_scan.made_cases()[2][1200:].sum()) > 1500
    assert net.report["recall"] >= secret_scan.RECALL
    assert (net.probability(secret_scan.windows(secret_scan.key_samples(seed=99, n=60))) >= net.threshold).mean() > 0.8
    assert (net.probability(secret_scan.windows(secret_scan.decoys(seed=98, n=60))) >= net.threshold).mean() < 0.1
    assert not any(r.n_net for r in secret_scan.secret_scan(documents, net).collect())


# ------------------------------------------------ 6 MinHash


def test_minhash_against_brute_force(spark, documents, odd):
    g = np.random.default_rng(4)
    base = [f"w{i}" for i in g.integers(0, 10_000, 120)]
    near = [(10_000 + i, " ".join(w if j % 120 != i else f"x{i}" for j, w in enumerate(base))) for i in range(80)]
    more = spark.createDataFrame([*near, (20_000, " ".join(base)), (20_001, " ".join(base).upper())], "doc_id long, text string")
    for d in (documents.select("doc_id", "text").unionAll(more), odd):
        rows = d.collect()
        sets = {}
        for r in rows:
            w = WORD.findall(lower(r.text))
            if r.doc_id is not None:
                sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        up = {i: i for i in sets}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        ids = sorted(i for i in sets if sets[i])
        for n, a in enumerate(ids):
            for b in ids[:n]:
                x, y = sets[a], sets[b]
                if min(len(x), len(y)) * 100 >= 75 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                    p, q = top(a), top(b)
                    up[max(p, q)] = min(p, q)
        out = minhash.near_duplicates(d).collect()
        assert len(out) == len(rows)
        for r in out:
            if r.doc_id is not None:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)
        assert minhash.keep_one(d).count() == sum(r.kept for r in out)


@pytest.mark.parametrize("gain", [0.7, -1.0])
def test_minhash_wide_buckets(spark, monkeypatch, gain):
    """A bucket of near copies of which many are just under the bound: links and their absence are those of brute force, with and without turns of centres before the tiles."""
    monkeypatch.setattr(minhash, "GAIN", gain)
    monkeypatch.setattr(minhash, "SIDE", 16)
    g = np.random.default_rng(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        hit = {int(x) for x in g.choice(200, g.integers(1, 12), replace=False)}
        rows.append((i, " ".join(f"x{i}_{j}" if j in hit else w for j, w in enumerate(base))))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(196)} for _, t in rows]
    up = list(range(150))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: top(i) for i in range(150)}


def events(spark, monkeypatch):
    """The list that grows by "step" with every checkpoint, and by "gone" whenever the driver's garbage goes."""
    found, kind = [], type(spark.range(1))
    collect, checkpoint = common.gc.collect, kind.checkpoint
    monkeypatch.setattr(common.gc, "collect", lambda *a: (found.append("gone"), collect(*a))[1])
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **b: (found.append("step"), checkpoint(self, *a, **b))[1])
    return found


def test_minhash_lets_go_after_each_step(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(12)]
    found = events(spark, monkeypatch)
    assert minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").count() == 1
    assert found.count("step") > 8
    assert all(x != "step" or y == "gone" for x, y in zip(found, [*found[1:], "end"], strict=True))


# ------------------------------------------------ 7 BPE


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=60))
def test_bpe_matches_the_library(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    if not hasattr(test_bpe_matches_the_library, "t"):
        test_bpe_matches_the_library.t = Tokenizer.from_file(path)
    t, c = test_bpe_matches_the_library.t, bpe.codec(path)
    ids = t.encode(text, add_special_tokens=False).ids
    assert c.encode(text) == ids
    assert c.run([text])[0] == (len(ids), ",".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))


def test_bpe_query(spark, odd):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, x in [*ODD, (50, "a<|endoftext|> b  c <|endoftext|>"), (51, "ab" * 9000)]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    more = spark.createDataFrame([(50, "a<|endoftext|> b  c <|endoftext|>"), (51, "ab" * 9000)], "doc_id long, text string")
    d = odd.select("doc_id", "text").unionAll(more)
    assert Counter(tuple(r) for r in bpe.bpe_round_trip(d, public_tokenizers.path("byte_bpe_50k.json")).collect()) == want


# ------------------------------------------------ 8 LM


def test_lm_scores(spark, documents, odd):
    d = documents.select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    rows = d.collect()
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        k = tokens(r.text)
        want[r.doc_id, held(r.doc_id), len(k), sum(c[w] > 0 for w in k), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in k), 5)] += 1
    model, counts = lm_score.train(d)
    out = lm_score.lm_scores(d, model, counts).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    assert all(r.score < 0 for r in out)
    # The score against sums written out: softmax over classes, over a class's words, and shares of the rare class.
    lex, net = model.lexicon, model.net
    hashes = {lm_score._key(w or ""): w for w in c}
    rank = {hashes[k]: int(r) for k, r in zip(lex.keys.tolist(), lex.rank, strict=True) if r >= 0}
    p = {k: v.astype(float) for k, v in net.p.items()}
    dim = lm_score.DIM
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    def outcomes(before, last):
        """Probabilities of all training words and the unknown one."""
        code = lambda w: net.n + 1 if w == "start" else rank.get(w[0], net.n)
        h = np.concatenate([p["r"][code(before)], p["r"][code(last)]]) @ p["c"]
        cls = softmax(p["u"][:, :dim] @ h + p["u"][:, dim])
        word = p["q"][:, :dim] @ h + p["q"][:, dim]
        within = np.concatenate([softmax(word[lex.cls == k]) for k in range(net.k - 1)])
        by = np.concatenate([np.flatnonzero(lex.cls == k) for k in range(net.k - 1)])
        given = dict(zip(by.tolist(), within * cls[lex.cls[by]], strict=True))
        rare = {w: cls[-1] * (x - lex.discount) / lex.rare_tokens for w, x in c.items() if w not in rank}
        return {w: given[r] for w, r in rank.items()} | rare, cls[-1] * lex.unknown

    got = {r.doc_id: r.score for r in out}
    some = [r for r in rows if r.doc_id is not None and len(tokens(r.text)) < 60][:6] + [r for r in rows if r.doc_id == 9]
    assert len(some) > 3
    for r in some:
        k, total = tokens(r.text), 0.0
        for i, w in enumerate(k):
            of, unknown = outcomes((k[i - 2],) if i > 1 else "start", (k[i - 1],) if i else "start")
            assert abs(sum(of.values()) + unknown - 1) < 1e-6
            total += math.log10(of.get(w, unknown))
        if sum(x.doc_id == r.doc_id for x in rows) == 1:
            assert abs(total - got[r.doc_id]) < 1e-3 * max(1, abs(total))


def test_lm_learns_word_order(spark):
    """A word that always follows another is likelier there than its count alone says."""
    g = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"{a} after{a}" for a in g.choice(words, 60))) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    held = [r for r in lm_score.lm_scores(d, *lm_score.train(d)).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)


# ------------------------------------------------ 9 quality net


def test_quality_net_held_out(spark):
    g = np.random.default_rng(5)
    words = ["tree", "house", "river", "cloud", "stone", "quiet"]
    rows = [(i, " ".join((w + "***" if i % 3 == 0 else w) for w in g.choice(words, 40)), int(i % 3 != 0)) for i in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    net = quality_net.train(d.select("doc_id", "text"), d.select("doc_id", "quality"))
    out = quality_net.quality_scores(d.select("doc_id", "text"), net).collect()
    assert np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in out if r.held_out]) > 0.95
    assert quality_net.keep_good(d, net).columns == d.columns


def test_quality_net_gradients():
    net = quality_net.Net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, y, one = [quality_net.blocks(b"some bytes here, and more of them " * 3), quality_net.blocks(b"")], np.array([1.0, 0.0]), np.ones(2)

    def loss():
        z = net.logits(net.pooled(rows)[0])[0]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grads = net.gradients(rows, y, one)
    for k in ("w", "e", "h", "o"):
        i = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old, e = net.p[k][i], 1e-5
        net.p[k][i] = old + e
        up = loss()
        net.p[k][i] = old - e
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / (2 * e) - grads[k][i]) < 1e-3 * max(1, abs(grads[k][i]))


# ------------------------------------------------ 10 chat


def test_chat(spark):
    t = lambda c, *said: [(c, i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(said)]
    rows = [*t(1, "hi", "yes", "more"), *t(2, "hi"), *t(3, "hi", "yes"), *t(4, "hi", "no"), *t(5, "hi", "no"), *t(6, "hi", "yes", "more", "end"), (None, 0, "user", "x"), (7, 0, None, None), (7, 0, None, None), *[(8, i, "user", f"<|m{i}") for i in range(600)]]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.chat_format(d).orderBy("conv_id", "segment").collect()
    assert [(r.conv_id, r.segment, r.n_turns, r.n_copies, r.n_segment_turns) for r in out] == [(4, 0, 2, 2, 2), (6, 0, 4, 1, 4), (7, 0, 1, 1, 1), (8, 0, 600, 1, 256), (8, 1, 600, 1, 256), (8, 2, 600, 1, 88)]
    assert out[0].rendered == "<|user|>\nhi\n<|end|>\n<|assistant|>\nno\n<|end|>\n"
    assert out[2].rendered == "<|unknown|>\n\n<|end|>\n" and "< |m1" in out[3].rendered
    assert chat.chat_format(d.limit(0)).count() == 0


# ------------------------------------------------ odd and empty inputs of the learned operators


def test_odd_and_empty_tables(spark, odd, none):
    labels = empty_labels(spark)
    for d in (odd, none):
        n = d.count()
        tox = toxicity.toxicity(d, toxicity.train(d, labels)).collect()
        net = quality_net.quality_scores(d, quality_net.train(d, labels)).collect()
        assert len(tox) == len(net) == n == quality_rules.quality_rules(d, quality_rules.train(d, labels)).count()
        assert all(0 <= r.score <= 1 for r in [*tox, *net])
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(none, path).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert bpe.bpe_round_trip(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert secret_scan.secret_scan(none, secret_scan.train(none)).count() == 0
    model, counts = lm_score.train(none)
    assert lm_score.lm_scores(none, model, counts).count() == 0
    assert lm_score.lm_scores(odd, model, counts).count() == len(ODD)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sf, d = "/root/testdata/sf0.01", docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = d.count()
        d = stage(spark, d, sf).persist()
        assert d.columns == docs.columns
        assert 0.5 * before < d.count() <= before, name
    left = {r.doc_id for r in d.collect()}
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == left


def test_pipeline_lets_go_after_each_stage(spark, monkeypatch):
    import corpus_pipeline

    found = events(spark, monkeypatch)
    stages = [(str(i), lambda spark, docs, sf_dir, i=i: (found.append(i), docs)[1]) for i in range(3)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == 200
    assert [x for i, x in enumerate(found) if x != "gone" or found[i - 1 : i] != ["gone"]] == [0, "gone", 1, "gone", 2, "gone"]
