"""Toxicity: nearest labelled examples by exact TF-IDF cosine, found in a block-max index.

Terms are words and the beginnings of words, so that inflected forms meet. The vector
space holds every term of the labelled texts; inverse document frequencies, counted over
all documents, are multiplied by a smooth weight of how unevenly the classes use the term,
so that terms of both classes count little and none is left out. Examples lie in blocks.
The postings of rarer terms are added up first and give the k-th best a floor; a common
term's largest weight in each block bounds what it can add there, so that one matrix
product of queries and block maxima tells which blocks can still reach the floor, and only
these are multiplied out. What comes within rounding of the k best is computed again in
double precision. Similarity-weighted votes of the k best are calibrated to probabilities.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, crc_fold, labelled_sample, platt, sigmoid, small_batches, texts_of

FIT_ROWS = 2000
#: Log-likelihood ratio at which a term's weight is a quarter of its full weight.
HALF = 10.0
#: Neighbours, examples of a block, terms that count as common, texts searched at once, and how far single precision may be off.
K, BLOCK, COMMON, TOGETHER, SLACK = 15, 64, 512, 32, 1e-4
TOXIC_FROM = 0.7
#: Words, and results of repeated vectors, that a worker keeps; beyond, the memory starts anew.
MEMORY = 100_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_terms int, neighbours array<long>, cosines array<double>"
#: A-Z become lower case; ASCII characters that are neither letters nor digits separate terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


#: Lengths, in bytes, of the beginnings of words that are terms too; of (4,), (5,) and (4, 5, 6) the one of the best recall, leaving each training row out.
PREFIXES = (5,)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its marked beginnings."""
    return [word, *[b"^" + word[:n] for n in PREFIXES if len(word) >= n]]


class Space(dict):
    """The places of a word's terms, kept for words met before."""

    def __init__(self, terms: list[bytes]):
        super().__init__()
        self.place = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        get = self.place.get
        got = tuple([i for t in terms_of(word) if (i := get(t)) is not None])
        if len(self) >= MEMORY:
            self.clear()
        self[word] = got
        return got

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and count of every term of the space in each text, by text and term."""
        folded = pa.array([t.encode().translate(_FOLD) for t in texts], pa.large_binary()).cast(pa.large_string())
        split = pc.ascii_split_whitespace(folded)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        got = [*map(self.__getitem__, words)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat, start = np.fromiter(chain.from_iterable(got), np.int64, size.sum()), np.cumsum(size) - size
        text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        pair, times = np.unique(text * max(len(got), 1) + coded.indices.to_numpy(), return_counts=True)
        word = pair % max(len(got), 1)
        at = _spans(start[word], start[word] + size[word])
        n = len(self.place) or 1
        code = np.repeat(pair // max(len(got), 1), size[word]) * n + flat[at]
        order = np.argsort(code)
        code, times = code[order], np.repeat(times, size[word])[order]
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        times = np.add.reduceat(times, begin) if len(begin) else times
        return code[begin] // n, code[begin] % n, times

    def __reduce__(self):
        return Space, ([*self.place],)


def weighted_terms(sample: list[tuple[int, str, int]]) -> tuple[list[bytes], np.ndarray]:
    """All terms of the examples, in byte order, and their weights from 0 (used alike by both classes) to 1; none without both classes."""
    held = (Counter(), Counter())
    size = [0, 0]
    for _, text, y in sample:
        held[y].update({t for w in set(words_of(text)) for t in terms_of(w)})
        size[y] += 1
    names = sorted(held[0].keys() | held[1].keys())
    if not all(size) or not names:
        return [], np.zeros(0)
    a = np.array([held[1][t] for t in names], float)
    b = np.array([held[0][t] for t in names], float)

    def part(k, n, p):
        return k * np.log(np.maximum(p, 1e-12)) + (n - k) * np.log(np.maximum(1 - p, 1e-12))

    both = (a + b) / sum(size)
    llr = 2 * (part(a, size[1], a / size[1]) + part(b, size[0], b / size[0]) - part(a, size[1], both) - part(b, size[0], both))
    llr = np.maximum(llr, 1e-6)  # a term that both classes use alike keeps a trace
    return names, (llr / (llr + HALF)) ** 2


def document_frequencies(documents: DataFrame, terms: list[bytes]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each term; counted over all documents, one row for each term and task."""
    small_batches(documents.sparkSession)
    size = len(terms)
    shared = documents.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(terms), 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, found, n = Space(pickle.loads(zlib.decompress(shared.value))), np.zeros(size + 1, np.int64), 0
        for b in batches:
            texts = texts_of(b)
            found[:size] += np.bincount(space.counts(texts)[1], minlength=size)
            n += len(texts)
        found[size] = n
        some = np.flatnonzero(found)
        for i in range(0, len(some), 10_000):
            k = some[i : i + 10_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(k), "n": pa.array(found[k])})

    df = np.zeros(len(terms) + 1, np.int64)
    got = documents.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term, and one
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return int(df[-1]), df[:-1]


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo..hi-1 of each pair, one after the other."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


class Index:
    """Labelled examples as unit TF-IDF vectors, in blocks of BLOCK examples."""

    def __init__(self, terms: list[bytes], idf: np.ndarray, ids: list[int], labels: list[int], texts: list[str]):
        self.space = Space(terms)
        self.idf = idf
        text, self.term, self.tf = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        for i in range(0, len(texts), 256):
            t, term, tf = self.space.counts(texts[i : i + 256])
            text, self.term, self.tf = np.append(text, t + i), np.append(self.term, term.astype(np.int32)), np.append(self.tf, tf.astype(np.int32))
        n = np.bincount(text, minlength=len(texts))
        full = np.flatnonzero(n)
        self.void = [y for y, k in zip(labels, n.tolist(), strict=True) if not k]
        self.ids = np.array(ids, np.int64)[full]
        self.labels = np.array(labels, np.int64)[full]
        self.base = (sum(self.void) + 0.5) / (len(self.void) + 1.0)
        self.from_ = np.concatenate([[0], np.cumsum(n[full])])
        self._build()

    def _build(self) -> None:
        """The examples' vectors one after the other; postings of rarer terms; weights of common ones in full, with their largest in each block."""
        n, terms = len(self.ids), len(self.idf)
        example = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.from_))
        self.value = (1 + np.log(self.tf)) * self.idf[self.term]
        if n:
            self.value /= np.sqrt(np.add.reduceat(self.value * self.value, self.from_[:-1]))[example]
        held = np.bincount(self.term, minlength=terms)
        often = np.argsort(-held, kind="stable")[:COMMON]
        self.row = np.full(terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.blocks = -(-n // BLOCK)
        self.common = np.zeros((len(often), self.blocks * BLOCK), np.float32)
        at = self.row[self.term]
        self.common[at[at >= 0], example[at >= 0]] = self.value[at >= 0]
        self.largest = self.common.reshape(len(often), self.blocks, BLOCK).max(2, initial=0)
        rare = np.flatnonzero(at < 0)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        self.start = np.searchsorted(self.term[rare], np.arange(terms + 1))
        self.example, self.weight = example[rare], self.value[rare].astype(np.float32)
        self.query = np.zeros(terms)  # of the text that is being computed

    def __getstate__(self):
        """Counts alone, packed: workers build the rest."""
        small = {k: getattr(self, k) for k in ("idf", "void", "ids", "labels", "base", "from_", "term", "tf")}
        return zlib.compress(pickle.dumps(small | {"terms": [*self.space.place]}), 1)

    def __setstate__(self, state: bytes) -> None:
        self.__dict__ |= pickle.loads(zlib.decompress(state))
        self.space = Space(self.__dict__.pop("terms"))
        self._build()

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms of the space in each text and their weights, of length one together."""
        text, at, tf = self.space.counts(texts)
        w = (1 + np.log(tf)) * self.idf[at]
        w /= np.sqrt(np.maximum(np.bincount(text, w * w, len(texts)), 1e-300))[text]
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        return [(at[a:b], w[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the places and cosines of the k nearest examples with a positive cosine, ties by place; but: for each a place to leave out, or -1."""
        out = []
        for i in range(0, len(vectors), TOGETHER):
            out += self._nearest(vectors[i : i + TOGETHER], k, but[i : i + TOGETHER] if but else [-1] * TOGETHER)
        return out

    def _nearest(self, vectors, k, but) -> list[tuple[np.ndarray, np.ndarray]]:
        n, width, texts = len(self.ids), self.blocks * BLOCK, len(vectors)
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * texts
        at, w = (np.concatenate(x) for x in zip(*vectors, strict=True))
        text = np.repeat(np.arange(texts), [len(v[0]) for v in vectors])
        size = self.start[at + 1] - self.start[at]
        p = _spans(self.start[at], self.start[at + 1])
        acc = np.bincount(np.repeat(text * width, size) + self.example[p], np.repeat(w.astype(np.float32), size) * self.weight[p], texts * width)
        acc = acc.astype(np.float32).reshape(texts, width)
        query = np.zeros((texts, len(self.common)), np.float32)
        row = self.row[at]
        query[text[row >= 0], row[row >= 0]] = w[row >= 0]
        # A block is multiplied out where its best so far and all that common terms can add reach the k-th best so far.
        for t, place in enumerate(but[:texts]):
            if place >= 0:
                acc[t, place] = -2
        acc[:, n:] = -2
        floor = np.partition(acc, width - k, 1)[:, width - k] if n > k else np.full(texts, -1, np.float32)
        bound = acc.reshape(texts, self.blocks, BLOCK).max(2) + query @ self.largest
        need = bound >= floor[:, None] - SLACK
        for j in np.flatnonzero(need.any(0)).tolist():
            some = np.flatnonzero(need[:, j])
            acc[some, j * BLOCK : (j + 1) * BLOCK] += query[some] @ self.common[:, j * BLOCK : (j + 1) * BLOCK]
        acc.reshape(texts, self.blocks, BLOCK)[~need] = -2
        floor = np.partition(acc, width - k, 1)[:, width - k] if n > k else floor
        out = []
        for t, (terms, weights) in enumerate(vectors):
            e = np.flatnonzero(acc[t] >= max(floor[t] - SLACK, 0)) if len(terms) else np.zeros(0, np.int64)
            e = e[(e < n) & (e != but[t])]
            if not len(e):
                out.append((np.zeros(0, np.int64), np.zeros(0)))
                continue
            self.query[terms] = weights
            p = _spans(self.from_[e], self.from_[e + 1])
            s = np.add.reduceat(self.query[self.term[p]] * self.value[p], np.cumsum([0, *np.diff(self.from_)[e][:-1]]))
            self.query[terms] = 0
            e, s = e[s > 0], s[s > 0]
            keep = np.lexsort((e, -np.round(s, 12)))[:k]
            out.append((e[keep], s[keep]))
        return out

    def vote(self, e: np.ndarray, s: np.ndarray) -> float:
        """Share of toxic among the neighbours, nearer ones heavier, with one far vote at the share of texts without terms."""
        w = 1.0 / (1.02 - np.minimum(s, 1.0))
        return float((w @ self.labels[e] + self.base) / (w.sum() + 1.0))


class Model:
    def __init__(self, index: Index, slope: float, shift: float):
        self.index, self.slope, self.shift = index, slope, shift
        self.seen: dict[bytes, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def rows(self, texts: list[str]) -> list[tuple[float, int, list[int], list[float]]]:
        """Score, number of terms, neighbours and their cosines of each text; equal vectors are searched once."""
        vectors = self.index.vectors(texts)
        keys = [at.tobytes() + w.tobytes() for at, w in vectors]
        new = {key: v for key, v in zip(keys, vectors, strict=True) if key not in self.seen}
        if len(self.seen) + len(new) > MEMORY:
            self.seen.clear()
            new = dict(zip(keys, vectors, strict=True))
        for (key, (at, _)), (e, s) in zip(new.items(), self.index.nearest([*new.values()], K), strict=True):
            p = float(sigmoid(np.array(self.slope * _logit(self.index.vote(e, s)) + self.shift)))
            self.seen[key] = (p, len(at), self.index.ids[e].tolist(), s.tolist())
        return [self.seen[key] for key in keys]


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def train(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """An index of at most fit_rows labelled rows of each class, none of the held-out fold, calibrated leaving each row out."""
    sample = labelled_sample(documents, labels, "toxic", fit_rows)
    terms, telling = weighted_terms(sample)
    n, df = document_frequencies(documents, terms)
    index = Index(terms, (np.log((1 + n) / (1 + df)) + 1) * telling, [r[0] for r in sample], [r[2] for r in sample], [r[1] for r in sample])
    vectors = [v for i in range(0, len(sample), 256) for v in index.vectors([r[1] for r in sample[i : i + 256]])]
    place = np.cumsum([len(at) > 0 for at, _ in vectors]) - 1
    found = index.nearest(vectors, K, [int(p) if len(at) else -1 for p, (at, _) in zip(place, vectors, strict=True)])
    raw, y = [_logit(index.vote(e, s)) for e, s in found], [r[2] for r in sample]
    slope, shift = platt(np.array(raw), np.array(y)) if raw else (0.0, -4.0)
    return Model(index, max(slope, 0.0), shift)


def toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """Score, verdict and evidence (nearest examples and their cosines) of every whole text.

    Null and empty texts, like all texts without a term of the space, have no neighbours and
    get the calibrated share of such examples; repeated rows get a row each; very long texts
    are read whole; an empty table gives no rows; columns other than doc_id and text are not read. Without labelled rows of both classes the score is the
    constant share."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = shared.value.rows(texts_of(batch))
        ids = batch.column(0)
        score = np.array([r[0] for r in rows])
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": ids.cast(pa.int64()),
                "held_out": pa.array(crc_fold(ids.to_pylist(), 3) == 1),
                "score": pa.array(score),
                "predicted": pa.array((score >= TOXIC_FROM).astype(np.int32)),
                "n_terms": pa.array([r[1] for r in rows], pa.int32()),
                "neighbours": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                "cosines": pa.array([r[3] for r in rows], pa.list_(pa.float64())),
            }
        )

    return arrow_pass(documents, ["doc_id", "text"], run, SCHEMA)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(documents, train(documents, labels))
