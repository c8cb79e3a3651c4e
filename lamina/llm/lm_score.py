"""LM scoring: a log-bilinear neural model in numpy, trained by noise-contrastive estimation.

Its outcomes are those of the base: the training words, one unknown word, and the end.
Words are counted over all training documents. The most frequent have a context vector,
an output vector and a class each; all rare words and the unknown one make up the last
class. The two words before a token, as vectors turned by a matrix for each
place, predict the token's class, by a softmax over classes, and the word, by a softmax
over the words of that class; batched matrix products give both. A rare word has
its share, by count, of its class, from which absolute discounting sets the unknown
word's share aside; counts of words that the workers don't know come by a join.

Training begins at the driver, on a bounded sample, and goes on over all training
documents: each task takes a step for every BATCH of its tokens, and tasks' parameters are
averaged, a word's by how often each task met it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, crc_fold, small_batches, texts_of

PARTS, HELD = 5, 1
#: Words whose counts the workers know, words with vectors, most classes, words with a class of their own, distinct words that a counting task holds before it passes them on.
KNOWN, NEURAL, CLASSES, ALONE, FLUSH = 200_000, 32_768, 192, 64, 400_000
#: Words kept with their places and hashes by a worker.
MEMORY = 400_000
DIM, BATCH, NOISE, RATE = 16, 8192, 32, 0.05
#: Documents of the driver's first steps, and training tokens for which a task is worth its parameters.
FIRST_DOCS, TASK_TOKENS = 2000, 8_000_000
#: Tokens scored at once against all classes.
STEP = 1024
SCHEMA = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<int>"


def _key(word: str) -> int:
    """A word's 64-bit hash as a signed number; the end of a text is the empty word's."""
    h = xxhash.xxh3_64_intdigest(word.encode())
    return h - (1 << 64) if h >> 63 else h


END = _key("")


def tokens_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of the texts, the end (the empty word) last; each token's place among them, text after text; and where each text ends."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    offsets = split.offsets.to_numpy()
    at = np.insert(coded.indices.to_numpy().astype(np.int64), offsets[1:] - offsets[0], len(words))
    ends = offsets[1:] - offsets[0] + np.arange(1, len(texts) + 1)
    if "" not in words:
        return [*words, ""], at, ends
    # Splitting leaves an empty string where a text begins or ends with white space: no word.
    keep = at != words.index("")
    return [*words, ""], at[keep], np.cumsum(keep)[ends - 1]


class Lexicon:
    """Known words by hash, with their counts; the most frequent have a rank and, by rank, a class, the others are rare."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, once: int, twice: int):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.tokens, self.distinct = tokens, distinct
        by = np.lexsort((self.keys, -self.counts))[:NEURAL]
        self.rank = np.full(len(keys), -1)
        self.rank[by] = np.arange(len(by))
        self.ranked = self.counts[by]
        # The first ranks, the end among them, have a class each; others share one with words of like frequency, classes being of like count.
        mass = np.cumsum(self.ranked[ALONE:])
        share = CLASSES - 1 - ALONE
        late = np.minimum((mass - 1) * share // max(int(mass[-1]), 1), share - 1) if len(mass) else mass
        _, self.cls = np.unique(np.concatenate([np.arange(min(ALONE, len(by))), ALONE + late]).astype(np.int64), return_inverse=True)
        self.rare = int(self.cls.max()) + 1 if len(self.cls) else 0  # the last class
        self.rare_tokens = tokens - int(self.ranked.sum())
        rare_words = distinct - len(by)
        self.discount = once / (once + 2 * twice) if once else 0.5
        # Where training has no rare word, the class is the unknown word's alone.
        self.unknown = self.discount * rare_words / self.rare_tokens if self.rare_tokens else 1.0
        self.share = np.where(self.rank < 0, np.log10((self.counts - self.discount) / max(self.rare_tokens, 1)), 0.0)
        self.log_counts = np.log10(self.counts + 0.5)


class Reader:
    """Places of known words, -1 for others, and hashes, kept for words met before."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

        class Hashes(dict):
            def __missing__(self, word: str) -> int:
                if len(self) > MEMORY:
                    self.clear()
                h = self[word] = _key(word)
                return h

        self.hashes = Hashes()

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and hash of each token, and where each text ends."""
        words, at, ends = tokens_of(texts)
        key = np.fromiter(map(self.hashes.__getitem__, words), np.int64, len(words))
        keys = self.lexicon.keys
        if not len(keys):
            return np.full(len(at), -1), key[at], ends
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        place[keys[place] != key] = -1
        return place[at], key[at], ends

    def ranks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each token, -1 for rare ones, and where each text ends."""
        place, _, ends = self.read(texts)
        return self.lexicon.rank[place] * (place >= 0) - (place < 0) if len(self.lexicon.keys) else place, ends


class LogBilinear:
    """Scores of classes and of words after two words; words go by their rank; context n is a rare word, the next one stands before a text's start."""

    NAMES = ("r", "c", "q", "u")

    def __init__(self, lexicon: Lexicon, seed: int = 1):
        g, n, k = np.random.default_rng(seed), len(lexicon.ranked), lexicon.rare + 1
        self.cls, self.n, self.k, f = lexicon.cls, n, k, np.float32
        per = np.bincount(lexicon.cls, lexicon.ranked, k)
        per[-1] += lexicon.rare_tokens
        #: Shares of noise, as logarithms times the number of noise draws and as sums.
        self.log_noise, self.sums = {}, {}
        for name, counts in (("q", lexicon.ranked), ("u", per)):
            share = (counts + 0.5) / (counts + 0.5).sum() if len(counts) else counts.astype(float)
            self.log_noise[name], self.sums[name] = np.log(NOISE * share).astype(f), np.cumsum(share)
        outputs = lambda name: np.concatenate([np.zeros((len(self.sums[name]), DIM), f), (self.log_noise[name] - f(np.log(NOISE)))[:, None]], 1)
        self.p = {
            "r": g.normal(0, 0.1, (n + 2, DIM)).astype(f),  # of context words
            "c": g.normal(0, 1 / np.sqrt(DIM), (2 * DIM, DIM)).astype(f),  # of context places
            "q": outputs("q"),  # of words, with what a word has in any context last
            "u": outputs("u"),  # of classes, likewise
        }

    def contexts(self, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The context before last and the last one of each token."""
        x = np.where(at >= 0, at, self.n)
        out = []
        for back in (2, 1):
            c = np.full(len(x), self.n + 1, np.int64)
            c[back:] = x[:-back]
            for k in range(back):
                first = np.concatenate([[0], ends[:-1]]) + k
                c[first[first < ends]] = self.n + 1
            out.append(c)
        return out[0], out[1]

    def fit(self, at: np.ndarray, ends: np.ndarray, state: dict, g: np.random.Generator) -> None:
        """Noise-contrastive steps over a run of texts, one for each BATCH of tokens; noise is shared by a step's tokens. state: sums of squares and counts of updates, kept by the caller."""
        c1, c2 = self.contexts(at, ends)
        cls = np.where(at >= 0, self.cls[at] if self.n else 0, self.k - 1)
        order = g.permutation(len(at))
        for i in range(0, len(order), BATCH):
            k = order[i : i + BATCH]
            self._step(c1[k], c2[k], at[k], cls[k], state, g)

    def _step(self, c1, c2, at, cls, state, g) -> None:
        r, c = self.p["r"], self.p["c"]
        x = np.concatenate([r[c1], r[c2]], 1)
        h = np.concatenate([x @ c, np.ones((len(x), 1), np.float32)], 1)
        dh = self._contrast("u", h, cls, state, g)
        known = np.flatnonzero(at >= 0)
        if len(known):
            dh[known] += self._contrast("q", h[known], at[known], state, g)
        dx = dh @ c.T
        self._move("c", None, x.T @ dh, state, len(at))
        self._move("r", np.concatenate([c1, c2]), np.concatenate([dx[:, :DIM], dx[:, DIM:]]), state)

    def _contrast(self, name, h, at, state, g) -> np.ndarray:
        """One step of the outcomes' vectors against shared noise; gives the gradient of the context."""
        p, less = self.p[name], self.log_noise[name]
        some = np.minimum(np.searchsorted(self.sums[name], g.random(NOISE)), len(p) - 1)
        q, n = p[at], p[some]
        d = -1 / (1 + np.exp(np.minimum(np.einsum("ij,ij->i", h, q) - less[at], 30)))
        e = h @ n.T
        e -= less[some]
        np.exp(np.minimum(-e, 30, out=e), out=e)
        e += 1
        np.divide(1, e, out=e)
        self._move(name, np.concatenate([at, some]), np.concatenate([d[:, None] * h, e.T @ h]), state)
        return d[:, None] * q[:, :DIM] + e @ n[:, :DIM]

    def _move(self, name, rows, grad, state, n=0) -> None:
        """An adaptive step of the named parameter's rows, None for all."""
        p, (squares, met) = self.p[name], state[name]
        if rows is None:
            squares += grad * grad
            met += n
            p -= RATE * grad / np.sqrt(squares)
            return
        order = np.argsort(rows)
        sorted_ = rows[order]
        start = np.flatnonzero(np.diff(sorted_, prepend=-1))
        at, total = sorted_[start], np.add.reduceat(grad[order], start)
        s = squares[at]
        s += total * total
        squares[at] = s
        met[at] += np.diff(np.append(start, len(rows)))
        p[at] -= np.float32(RATE) * total / np.sqrt(s)

    def fresh(self) -> dict:
        return {k: (np.full_like(v, 1e-2), np.zeros(len(v))) for k, v in self.p.items()}

    @cached_property
    def turned(self) -> tuple[np.ndarray, np.ndarray]:
        """Context vectors turned by each place's matrix."""
        return self.p["r"] @ self.p["c"][:DIM], self.p["r"] @ self.p["c"][DIM:]

    @cached_property
    def members(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known words by class, where each class begins, and each word's place in its class."""
        by = np.argsort(self.cls, kind="stable")
        start = np.searchsorted(self.cls[by], np.arange(self.k + 1))
        inside = np.empty(self.n, np.int64)
        inside[by] = np.arange(self.n) - start[self.cls[by]]
        return by, start, inside

    def logs(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token; of a rare one, its class's."""
        c1, c2 = self.contexts(at, ends)
        (first, second), (by, start, inside) = self.turned, self.members
        h = first[c1] + second[c2]
        known = at >= 0
        cls = np.full(len(at), self.k - 1)
        cls[known] = self.cls[at[known]]
        out = np.empty(len(at))
        u, a = np.ascontiguousarray(self.p["u"][:, :DIM].T), self.p["u"][:, DIM]
        # Where no score can be large, exponentials need no shift.
        long = np.sqrt((h * h).sum(1).max(initial=0))
        plain = all(long * np.sqrt((v[:, :DIM] ** 2).sum(1).max(initial=0)) + np.abs(v[:, DIM]).max(initial=0) < 60 for v in (self.p["u"], self.p["q"]))
        for i in range(0, len(at), STEP):
            x = h[i : i + STEP] @ u
            x += a
            own = x[np.arange(len(x)), cls[i : i + STEP]].astype(np.float64)
            top = 0.0 if plain else x.max(1, keepdims=True)
            out[i : i + STEP] = own - np.ravel(top) - np.log(np.exp(x if plain else x - top, out=x).sum(1))
        order = np.flatnonzero(known)
        order = order[np.argsort(cls[order], kind="stable")]
        cut = np.searchsorted(cls[order], np.arange(self.k + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            words = by[start[k] : start[k + 1]]
            if len(words) == 1:
                continue
            q, b = np.ascontiguousarray(self.p["q"][words, :DIM].T), self.p["q"][words, DIM]
            step = max(1, STEP * 1024 // len(words))
            for i in range(cut[k], cut[k + 1], step):
                mine = order[i : min(i + step, cut[k + 1])]
                x = h[mine] @ q
                x += b
                own = x[np.arange(len(x)), inside[at[mine]]].astype(np.float64)
                top = 0.0 if plain else x.max(1, keepdims=True)
                out[mine] += own - np.ravel(top) - np.log(np.exp(x if plain else x - top, out=x).sum(1))
        return out


def counted(documents: DataFrame) -> DataFrame:
    """(h, c): how often each word and the end occur in training documents; a task passes on sums."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"h": pa.array([_key(w) for w in held], pa.int64()), "c": pa.array(held.values(), pa.int64())})

        for b in batches:
            use = crc_fold(b.column(0).to_pylist(), PARTS) != HELD
            words, at, _ = tokens_of([t for t, u in zip(texts_of(b), use, strict=True) if u])
            n = np.bincount(at, minlength=len(words))
            for w, c in zip(words, n.tolist(), strict=True):
                if c:
                    held[w] += c
            if len(held) > FLUSH:
                yield out()
                held.clear()
        if held:
            yield out()

    return checkpointed(documents.select("doc_id", "text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))


class Model:
    def __init__(self, lexicon: Lexicon, net: LogBilinear):
        self.lexicon, self.net = lexicon, net

    def __getstate__(self):
        return {"lexicon": self.lexicon, "net": self.net}

    @cached_property
    def reader(self) -> Reader:
        return Reader(self.lexicon)

    def rows(self, texts: list[str]) -> dict[str, pa.Array]:
        """Tokens, known tokens, their base terms, score but for rare words' shares of their class, rare words' hashes and times of each text."""
        at, key, ends = self.reader.read(texts)
        n = len(texts)
        owner = np.repeat(np.arange(n), np.diff(ends, prepend=0))
        known = at >= 0
        lex = self.lexicon
        rank = np.full(len(at), -1)
        rank[known] = lex.rank[at[known]]
        score = np.bincount(owner, self.net.logs(rank, ends), n) / np.log(10) + np.bincount(owner[known], lex.share[at[known]], n)
        base = np.bincount(owner[known], lex.log_counts[at[known]], n)
        pair = np.stack([owner[~known], key[~known]], 1)
        order = np.lexsort((pair[:, 1], pair[:, 0]))
        pair = pair[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]).any(1)])) if len(pair) else np.zeros(0, np.int64)
        offsets = pa.array(np.searchsorted(pair[new, 0], np.arange(n + 1)).astype(np.int32))
        return {
            "n_tokens": pa.array(np.diff(ends, prepend=0)),
            "known": pa.array(np.bincount(owner[known], minlength=n)),
            "base": pa.array(base, pa.float64()),
            "score": pa.array(score, pa.float64()),
            "rare": pa.ListArray.from_arrays(offsets, pa.array(pair[new, 1])),
            "times": pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(new, len(pair))).astype(np.int32))),
        }


def training_texts(batch: pa.RecordBatch) -> list[str]:
    use = crc_fold(batch.column(0).to_pylist(), PARTS) != HELD
    return [t for t, u in zip(texts_of(batch), use, strict=True) if u]


def averaged(documents: DataFrame, model: Model) -> None:
    """One pass of training steps over all training documents; tasks' parameters, averaged by how often each met them, replace the model's."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    tasks = max(1, -(-model.lexicon.tokens // TASK_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        g = np.random.default_rng(TaskContext.get().partitionId())
        reader, net = shared.value.reader, LogBilinear(shared.value.lexicon)
        net.p = {k: v.copy() for k, v in shared.value.net.p.items()}
        state = net.fresh()
        for b in batches:
            net.fit(*reader.ranks(training_texts(b)), state, g)
        for kind, name in enumerate(net.NAMES):
            met = state[name][1]
            some = np.flatnonzero(met)
            for i in range(0, len(some), 10_000):
                k = some[i : i + 10_000]
                v = np.zeros((len(k), DIM + 1))
                v[:, : net.p[name].shape[1]] = net.p[name][k] * met[k, None]
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(k), kind, np.int32)), "row": pa.array(k.astype(np.int32)), "n": pa.array(met[k])} | {f"v{j}": pa.array(v[:, j]) for j in range(DIM + 1)})

    columns = ["n", *(f"v{j}" for j in range(DIM + 1))]
    each = documents.select("doc_id", "text").coalesce(tasks).mapInArrow(run, "kind int, row int, " + ", ".join(f"{c} double" for c in columns))
    # At most two rows for each word with vectors, and those of classes, reach the driver.
    got = each.groupBy("kind", "row").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    kind, row, n = (got.column(c).to_numpy() for c in ("kind", "row", "n"))
    v = np.stack([got.column(f"v{j}").to_numpy() for j in range(DIM + 1)], 1) / n[:, None]
    for i, name in enumerate(model.net.NAMES):
        p, mine = model.net.p[name], kind == i
        p[row[mine]] = v[mine, : p.shape[1]]


def train(documents: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts of all training words."""
    counts = counted(documents)
    count = lambda k: F.coalesce(F.sum(F.when(F.col("c") == k, 1).otherwise(0)), F.lit(0))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), count(1).alias("once"), count(2).alias("twice")).first()
    top = counts.where("c > 1").orderBy(F.desc("c"), "h").limit(KNOWN).toArrow()
    lexicon = Lexicon(top.column("h").to_numpy(), top.column("c").to_numpy(), total.n, total.v, total.once, total.twice)
    model = Model(lexicon, LogBilinear(lexicon))
    if len(lexicon.keys):
        picked = documents.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(FIRST_DOCS).distinct()
        first = documents.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").toArrow()  # at most FIRST_DOCS rows
        net, g, state = model.net, np.random.default_rng(5), model.net.fresh()
        for b in first.to_batches(max_chunksize=256):
            net.fit(*model.reader.ranks(training_texts(b)), state, g)
        averaged(documents, model)
    return model, counts


def lm_scores(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Base and model scores of every whole text.

    Null and empty texts are an end alone; repeated rows get a row each; a null doc_id belongs
    to fold 0; an empty table gives no rows; very long texts are scored whole, STEP tokens at
    once; columns other than doc_id and text are not read. Without training documents all
    words are unknown and the score is 0, as the unknown word is the only outcome."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            ids = b.column(0).to_pylist()
            cols = {"uid": pa.array(np.arange(uid, uid + len(ids))), "doc_id": b.column(0).cast(pa.int64()), "held_out": pa.array(crc_fold(ids, PARTS) == HELD)}
            if ids:
                yield pa.RecordBatch.from_pydict(cols | shared.value.rows(texts_of(b)))
            uid += len(ids)

    rows = checkpointed(documents.select("doc_id", "text").mapInArrow(run, SCHEMA))
    rare = rows.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    c, lex = F.coalesce("c", F.lit(0)), model.lexicon
    share = F.when(c > 0, F.log10((c - lex.discount) / F.lit(float(max(lex.rare_tokens, 1))))).otherwise(F.lit(float(np.log10(lex.unknown))))
    more = rare.join(counts, "h", "left").groupBy("uid").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("base_more"), F.sum(F.col("times") * share).alias("score_more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known_more"))
    below = float(np.log10(lex.tokens + 0.5 * (lex.distinct + 1)))
    return rows.drop("rare", "times").join(more, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(int(lex.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"),
        (F.col("score") + F.coalesce("score_more", F.lit(0.0))).alias("score"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scores(documents, *train(documents))
