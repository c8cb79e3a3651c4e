"""Quality rules: fixed text statistics and a hashed n-gram logistic regression.

The regression sees hashed words, word pairs and character n-grams within words, as
shares of the text. Its logit is a sum over words and pairs, so a batch needs one
weight for each distinct word and one table look-up for each pair.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_pass, labelled_sample, platt, sigmoid, texts_of

BITS = 18
CHAR_N = (2, 3, 4)
#: Rows of each class in the fit, and the verdict's fixed threshold.
FIT_ROWS = 2000
KEEP_FROM = 0.5
MIN_WORDS, MAX_REPEATED = 10, 20
SYMBOLS = b"#*$%&|<>"
#: Words held at once by a worker; beyond, the memory of seen words starts anew.
MEMORY = 200_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, prob double, kept boolean"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def repeated_words(ids: np.ndarray, text: np.ndarray, texts: int, width: int = 5) -> np.ndarray:
    """Words of each text inside windows of width words that occur at least twice in it.

    ids number the words of all texts in a row, text numbers the text of each word."""
    n = len(ids) - width + 1
    if n < 2:
        return np.zeros(texts, np.int64)
    x = ids.astype(np.uint64) + np.uint64(1)
    h = text[:n].astype(np.uint64)
    for k in range(width):
        h = (h ^ x[k : k + n]) * _M1
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    h = h[at]
    order = np.argsort(h)
    order, h = at[order], h[order]
    same = np.flatnonzero(h[1:] == h[:-1])
    a, b = order[same], order[same + 1]
    true = text[a] == text[b]
    for k in range(width):
        true &= ids[a + k] == ids[b + k]
    hit = np.zeros(n, bool)
    hit[a[true]] = hit[b[true]] = True
    at = np.flatnonzero(hit)
    edge = np.bincount(at, minlength=n + width) - np.bincount(at + width, minlength=n + width)
    return np.bincount(text[np.cumsum(edge)[: len(ids)] > 0], minlength=texts)


class Words:
    """Numbers, hashes and character n-gram features of the words seen so far."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        outer = self

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                n = self[word] = len(self)
                outer.new.append(word)
                return n

        self.new: list[bytes] = []
        self.number = Numbers()
        self.hash = np.zeros(0, np.uint64)
        self.chars = np.zeros(0, np.int64)
        self.logit = np.zeros(0, np.float64)

    def take(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def learn(self) -> None:
        """Hashes, lengths and, with weights, logits of the words met since the last call."""
        if not self.new:
            return
        h = np.array([zlib.crc32(w) | (zlib.adler32(w) << 32) for w in self.new], np.uint64)
        self.hash = np.concatenate([self.hash, _mix(h)])
        self.chars = np.concatenate([self.chars, np.array([len(w.decode("utf-8", "replace")) for w in self.new], np.int64)])
        if self.weights is not None:
            owner, features = grams(self.new)
            own = np.bincount(owner, self.weights[features], len(self.new))
            own += self.weights[word_feature(self.hash[-len(self.new) :])]
            self.logit = np.concatenate([self.logit, own])
        self.new = []


def word_feature(h: np.ndarray) -> np.ndarray:
    return (_mix(h + np.uint64(1)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def pair_feature(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_mix(a * np.uint64(3) + b + np.uint64(2)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner (place of the word) and feature of each byte n-gram of the words, edges marked."""
    joined = b"".join(b"\x02" + w + b"\x03" for w in words)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    data = np.frombuffer(joined, np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    owners, features = [], []
    for n in CHAR_N:
        size = len(data) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + data[k : k + size]
        inside = owner[:size] == owner[n - 1 :]
        owners.append(owner[:size][inside])
        features.append((_mix(h[inside]) & np.uint64((1 << BITS) - 1)).astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owners, features = np.concatenate(owners), np.concatenate(features)
    order = np.argsort(owners, kind="stable")
    return owners[order], features[order]


def fit(sample: list[tuple[int, str, int]], epochs: int = 12, rate: float = 20.0) -> dict:
    """Weights, bias and calibration from labelled texts; every fifth row only calibrates.

    Without rows of both classes the verdict is the constant share of good rows."""
    w = np.zeros(1 << BITS, np.float64)
    y = np.array([r[2] for r in sample], np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return {"w": w.astype(np.float32), "bias": 0.0, "slope": 0.0, "shift": 20.0 if share >= 0.5 else -20.0}
    seen = Words()
    split = [text.encode().split() for _, text, _ in sample]
    taken = [seen.take(words) for words in split]
    names = [*seen.new]
    seen.learn()
    features, sizes = [], []
    for i in range(0, len(names), 20_000):  # in parts, as the grams of all words take much memory
        owner, f = grams(part := names[i : i + 20_000])
        features.append(f.astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(part)))
    features, start = np.concatenate(features), np.cumsum([0, *np.concatenate(sizes)])
    own = word_feature(seen.hash)
    rows = []
    for ids in taken:
        distinct, counts = np.unique(ids, return_counts=True)
        size = start[distinct + 1] - start[distinct]
        at = np.repeat(start[distinct] - np.cumsum(size) + size, size) + np.arange(size.sum())
        h = seen.hash[ids]
        f = np.concatenate([features[at], own[distinct], pair_feature(h[:-1], h[1:])])
        value = np.concatenate([np.repeat(counts, size), counts, np.ones(max(0, len(h) - 1))]) / max(1, len(ids))
        u, inv = np.unique(f, return_inverse=True)
        rows.append((u.astype(np.int32), np.bincount(inv, value, len(u)).astype(np.float32)))
    order = np.random.default_rng(5)
    train = [i for i in range(len(rows)) if i % 5]
    held = [i for i in range(len(rows)) if i % 5 == 0]
    bias, g2, b2 = 0.0, np.full(1 << BITS, 1e-2), 1e-2
    balance = {0: 0.5 / max(1e-9, 1 - y.mean()), 1: 0.5 / max(1e-9, y.mean())}
    for _ in range(epochs):
        order.shuffle(train)
        for i in train:
            f, v = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[f] @ v + bias, -40, 40)))
            g = (p - y[i]) * balance[int(y[i])]
            gv = g * v
            g2[f] += gv * gv
            w[f] -= 0.3 * gv / np.sqrt(g2[f])
            b2 += g * g
            bias -= 0.3 * g / np.sqrt(b2)
    w = w.astype(np.float32)
    raw = np.array([float(w[rows[i][0]].astype(float) @ rows[i][1] + bias) for i in held])
    slope, shift = platt(raw, y[held])
    return {"w": w, "bias": float(bias), "slope": max(slope, 0.0), "shift": shift}


class Scorer:
    """Statistics and probabilities of the texts of a batch."""

    def __init__(self, model: dict):
        self.model, self.words = model, Words(model["w"].astype(np.float64))

    def rows(self, texts: list[str]) -> dict[str, np.ndarray]:
        m, seen = self.model, self.words
        if len(seen.number) > MEMORY:
            seen.clear()
        data = [t.encode() for t in texts]
        split = [x.split() for x in data]
        n = np.array([len(w) for w in split], np.int64)
        ids = np.concatenate([seen.take(w) for w in split]) if texts else np.zeros(0, np.int64)
        seen.learn()
        text = np.repeat(np.arange(len(texts)), n)
        inside = text[1:] == text[:-1]
        h = seen.hash[ids]
        raw = np.bincount(text, seen.logit[ids], len(texts))
        raw += np.bincount(text[1:][inside], m["w"][pair_feature(h[:-1], h[1:])[inside]], len(texts))
        raw = raw / np.maximum(n, 1) + m["bias"]
        lines = [[x for x in d.split(b"\n") if x.split(None, 1)] if b"\n" in d else () for d in data]
        repeats = repeated_words(ids, text, len(texts))
        failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEATED * n)
        prob = sigmoid(m["slope"] * raw + m["shift"])
        return {
            "n_words": n,
            "word_chars": np.bincount(text, seen.chars[ids], len(texts)).astype(np.int64),
            "n_symbols": np.array([len(d) - len(d.translate(None, SYMBOLS)) for d in data], np.int64),
            "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
            "n_repeat_words": repeats,
            "base_failed": failed,
            "prob": prob,
            "kept": ~failed & (prob >= KEEP_FROM),
        }


def train(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """The model of labels.quality, from at most fit_rows rows of each class, none of the held-out fold."""
    return fit(labelled_sample(documents, labels, "quality", fit_rows))


def quality_rules(documents: DataFrame, model: dict) -> DataFrame:
    """Statistics and verdict of every whole text.

    Null texts have no words and fail the base rules, as empty ones do; repeated rows get a
    row each; a null doc_id stays null; columns other than doc_id and text are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    state: list[Scorer] = []

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Scorer(shared.value))
        out = state[0].rows(texts_of(batch))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64())} | {k: pa.array(v) for k, v in out.items()})

    return arrow_pass(documents, ["doc_id", "text"], score, SCHEMA)


def keep_good(documents: DataFrame, model: dict) -> DataFrame:
    """The rows of documents, whole, whose texts the rules keep."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    state: list[Scorer] = []

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Scorer(shared.value))
        return batch.filter(pa.array(state[0].rows(texts_of(batch))["kept"]))

    return arrow_pass(documents, documents.columns, keep, documents.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules(documents, train(documents, labels))
