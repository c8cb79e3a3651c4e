"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters slide over overlapping chunks (each of two
neighbouring blocks, so every byte inside a text lies in two chunks) from the first
byte to the last; their largest responses over the whole text go through one hidden
layer to a probability, which held-back labelled rows calibrate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_pass, crc_fold, labelled_sample, platt, sigmoid, texts_of

BLOCK, EMBED, FILTERS, HIDDEN = 32, 8, 32, 16
PAD = 256
FIT_ROWS = 3000
ACCEPT_FROM = 0.5
#: Blocks embedded at once; bounds a worker's memory whatever a text's length.
STEP = 16_384
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def blocks(data: bytes) -> np.ndarray:
    """The text's bytes in rows of BLOCK, padded at both ends so that two blocks at least exist."""
    n = max(2, -(-(len(data)) // BLOCK) + 1)
    out = np.full(n * BLOCK, PAD, np.int16)
    out[BLOCK // 2 : BLOCK // 2 + len(data)] = np.frombuffer(data, np.uint8) if data else 0
    return out.reshape(n, BLOCK)


class Net:
    def __init__(self, seed: int = 3):
        g = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "e": (g.normal(0, 0.5, (257, EMBED))).astype(f),
            "w": (g.normal(0, 1 / np.sqrt(2 * BLOCK * EMBED), (2, BLOCK * EMBED, FILTERS))).astype(f),
            "b": np.zeros(FILTERS, f),
            "h": (g.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN))).astype(f),
            "c": np.zeros(HIDDEN, f),
            "o": (g.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)).astype(f),
            "d": np.zeros(1, f),
        }
        self.p["e"][PAD] = 0
        self.slope, self.shift = 1.0, 0.0

    def responses(self, x: np.ndarray) -> np.ndarray:
        """A row of filter responses for each chunk, that is each pair of neighbouring blocks."""
        both = np.concatenate([self.p["w"][0], self.p["w"][1]], 1)
        y = np.concatenate([self.p["e"][x[i : i + STEP]].reshape(-1, BLOCK * EMBED) @ both for i in range(0, len(x), STEP)])
        return y[:-1, :FILTERS] + y[1:, FILTERS:]

    def pooled(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Largest responses of each text, with all responses and where each text's begin."""
        x = np.concatenate(rows)
        start = np.cumsum([0, *(len(r) for r in rows[:-1])])
        y = self.responses(x)
        ends = start[1:] - 1  # a chunk must not join two texts
        y[ends] = -np.inf
        return np.maximum.reduceat(y, start, axis=0) + self.p["b"], y, start, x

    def logits(self, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.tanh(pool)
        h = np.tanh(a @ self.p["h"] + self.p["c"])
        return h @ self.p["o"] + self.p["d"][0], h, a

    def raw(self, texts: list[str]) -> np.ndarray:
        out, rows, held = [], [], 0
        for t in texts:
            rows.append(blocks(t.encode()))
            held += len(rows[-1])
            if held >= STEP:
                out.append(self.logits(self.pooled(rows)[0])[0])
                rows, held = [], 0
        if rows:
            out.append(self.logits(self.pooled(rows)[0])[0])
        return np.concatenate(out).astype(float) if out else np.zeros(0)

    def score(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.slope * self.raw(texts) + self.shift)

    def gradients(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        pool, all_y, start, x = self.pooled(rows)
        z, h, a = self.logits(pool)
        p, n = self.p, len(rows)
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / n).astype(np.float32)
        dh = np.outer(dz, p["o"]) * (1 - h * h)
        da = dh @ p["h"].T * (1 - a * a)
        stop = [*start[1:], len(x)]
        at = np.stack([s + np.argmax(all_y[s : e - 1], 0) for s, e in zip(start, stop, strict=True)])  # (n, FILTERS)
        dw, de = np.zeros_like(p["w"]), np.zeros_like(p["e"])
        for side in (0, 1):
            picked = x[at.ravel() + side]  # (n * FILTERS, BLOCK)
            emb = p["e"][picked].reshape(n, FILTERS, BLOCK * EMBED)
            dw[side] = np.einsum("nfk,nf->kf", emb, da, optimize=True)
            back = (da[:, :, None] * p["w"][side].T[None]).reshape(-1, EMBED)
            flat = picked.ravel()
            for k in range(EMBED):
                de[:, k] += np.bincount(flat, back[:, k], 257).astype(np.float32)
        de[PAD] = 0
        return {"e": de, "w": dw, "b": da.sum(0), "h": a.T @ dh, "c": dh.sum(0), "o": h.T @ dz, "d": dz.sum(keepdims=True)}


def fit(sample: list[tuple[int, str, int]], epochs: int = 6, batch: int = 24, rate: float = 3e-3) -> Net:
    """A network fitted to the labelled texts; every fifth row only calibrates.

    Without rows of both classes the score is the constant share of good rows."""
    net = Net()
    y = np.array([r[2] for r in sample], np.float32)
    if not len(y) or y.min() == y.max():
        net.slope, net.shift = 0.0, 4.0 if not len(y) or y[0] == 1 else -4.0
        return net
    rows = [blocks(t.encode()) for _, t, _ in sample]
    train = np.array([i for i in range(len(rows)) if i % 5])
    held = [i for i in range(len(rows)) if i % 5 == 0]
    share = float(y[train].mean())
    weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    g, step = np.random.default_rng(11), 0
    total = epochs * -(-len(train) // batch)
    for _ in range(epochs):
        g.shuffle(train)
        for i in range(0, len(train), batch):
            part = train[i : i + batch]
            step += 1
            lr = rate * min(1, step / 50) * (1 - 0.9 * step / total)
            for k, d in net.gradients([rows[j] for j in part], y[part], weight[part]).items():
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.99 * s[k] + 0.01 * d * d
                net.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    raw = net.raw([sample[i][1] for i in held])
    net.slope, net.shift = platt(raw, y[held])
    if net.slope <= 0:
        net.slope, net.shift = 1.0, 0.0
    return net


def train(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Net:
    """The network of labels.quality, from at most fit_rows rows of each class, none of the held-out fold."""
    return fit(labelled_sample(documents, labels, "quality", fit_rows))


def _scorer(spark: SparkSession, net: Net):
    shared = spark.sparkContext.broadcast((net.p, net.slope, net.shift))
    state: list[Net] = []

    def score(texts: list[str]) -> np.ndarray:
        if not state:
            state.append(Net())
            state[0].p, state[0].slope, state[0].shift = shared.value
        return state[0].score(texts)

    return score


def quality_scores(documents: DataFrame, net: Net) -> DataFrame:
    """A probability of good quality for every whole text.

    Null texts count as empty and get the empty text's score; repeated rows get a row each;
    columns other than doc_id and text are not read."""
    score = _scorer(documents.sparkSession, net)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = score(texts_of(batch))
        ids = batch.column(0)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": ids.cast(pa.int64()),
                "held_out": pa.array(crc_fold(ids.to_pylist(), 3) == 1),
                "score": pa.array(p),
                "predicted": pa.array((p >= ACCEPT_FROM).astype(np.int32)),
            }
        )

    return arrow_pass(documents, ["doc_id", "text"], run, SCHEMA)


def keep_good(documents: DataFrame, net: Net) -> DataFrame:
    """The rows of documents, whole, whose score reaches ACCEPT_FROM."""
    score = _scorer(documents.sparkSession, net)
    return arrow_pass(documents, documents.columns, lambda b: b.filter(pa.array(score(texts_of(b)) >= ACCEPT_FROM)), documents.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_scores(documents, train(documents, labels))
