"""Secret scans: fixed patterns, and a character convolutional network that judges every
other candidate in its context.

Candidates are runs of key-like characters of length 16 or more, and values of 4 or more
characters after any word with : or =, quoted ones whole. The network sees a candidate's two ends and the text
around it, one-hot by character class and folded byte; along a longer candidate the window
moves on by half of what it sees, and the largest probability counts. It learns from labelled
findings: of all documents, all spans of the fixed patterns are positives and all other candidates
negatives, with made keys and with decoys made from ordinary words and common number formats,
on which it starts at the driver. Tasks train it on over their own cases and their parameters
are averaged. A quarter of the cases only calibrates; the threshold is the highest that keeps
the asked recall on held-back findings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, checkpointed, platt, sigmoid, small_batches, texts_of

KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A sign of assignment and its value; KEY is what stands before one.
VALUE = re.compile(r"""[:=][ \t]*(?:"([^"\n]{4,})"|'([^'\n]{4,})'|([^\s"'<>,;]{4,}))""")
KEY = re.compile(r"""[A-Za-z_][A-Za-z0-9_.-]*["']?[ \t]*$""")
#: An ASSIGN match holds one of these, whatever its case.
HINTS = ("passw", "secret", "token", "apikey", "api_key")
#: Context on each side, characters of a candidate's two ends.
AROUND, END = 24, 24
WIDTH = 2 * AROUND + 2 * END
RECALL = 0.99
#: Passes over all cases, a task's epochs in each, cases that a task holds at once, and groups in which tasks' networks are averaged.
ROUNDS, EPOCHS, BLOCK, GROUPS = 5, 3, 50_000, 16
#: Share of made cases in each class's weight.
MADE = 0.3
#: Bins of held-back scores, for each unit.
BINS = 100
CHANNELS, TAPS, FILTERS = 40, 5, 16
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long, max_prob double"
#: Channel of each folded byte: letters, digits, and signs that keys and assignments use; the rest by class.
_SIGNS = b"=:_-+/.\"' "


def _channels() -> np.ndarray:
    c = np.full(257, 38, np.int64)
    for b in range(256):
        if 97 <= b <= 122:
            c[b] = b - 97 if b > 102 else 0  # a-f as one: the letters of hexadecimals
        elif 65 <= b <= 90:
            c[b] = 26
        elif 48 <= b <= 57:
            c[b] = 27
        elif b in _SIGNS:
            c[b] = 28 + _SIGNS.index(b)
    c[256] = 39
    return c


_CHANNEL = _channels()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that the network judges, in order; an assigned value and a run may overlap."""
    out = {m.span() for m in CANDIDATE.finditer(text) if any(map(str.isalnum, m[0]))}
    if "=" in text or ":" in text:
        out |= {m.span(m.lastindex) for m in VALUE.finditer(text) if KEY.search(text[max(0, m.start() - 40) : m.start()])}
    return sorted(out)


def windows(cases: list[tuple[str, int, int]]) -> np.ndarray:
    """Channels of each case's context and ends, (n, WIDTH)."""
    out = np.full((len(cases), WIDTH), 39, np.int64)
    for i, (text, a, b) in enumerate(cases):
        left, right = text[max(0, a - AROUND) : a], text[b : b + AROUND]
        head, tail = text[a : min(b, a + END)], text[max(a, b - END) : b]
        for part, at, flush in ((left, 0, True), (head, AROUND, False), (tail, AROUND + END, True), (right, AROUND + 2 * END, False)):
            width = AROUND if at in (0, AROUND + 2 * END) else END
            x = _CHANNEL[np.frombuffer(part.encode("ascii", "replace"), np.uint8)]
            if len(x):
                out[i, slice(at + width - len(x), at + width) if flush else slice(at, at + len(x))] = x
    return out


class Net:
    """Convolution over the window, largest and mean response of each filter in each quarter, logistic output."""

    def __init__(self, seed: int = 2):
        g = np.random.default_rng(seed)
        self.p = {"w": g.normal(0, 0.3, (TAPS, CHANNELS, FILTERS)), "b": np.zeros(FILTERS), "o": g.normal(0, 0.2, 8 * FILTERS), "d": np.zeros(1)}
        self.slope, self.shift, self.threshold, self.report = 1.0, 0.0, 1.0, {}

    def forward(self, x: np.ndarray):
        w, n = self.p["w"], WIDTH - TAPS + 1
        a = self.p["b"] + sum(w[k][x[:, k : k + n]] for k in range(TAPS))
        r = np.maximum(a, 0)
        quarters = np.array_split(np.arange(n), 4)
        best = np.stack([q[0] + r[:, q].argmax(1) for q in quarters], 1)  # (n, 4, FILTERS)
        top = np.take_along_axis(r, best.reshape(len(x), -1, FILTERS), 1)
        mean = np.stack([r[:, q].mean(1) for q in quarters], 1)
        pooled = np.concatenate([top, mean], 1).reshape(len(x), -1)
        return pooled @ self.p["o"] + self.p["d"][0], pooled, a, best, quarters

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 4e-3, weight: np.ndarray | None = None) -> None:
        """Adam over the cases; unless given, weights are such that both classes weigh the same."""
        g = np.random.default_rng(9)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        if weight is None:
            weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        for _ in range(epochs):
            order = g.permutation(len(y))
            for i in range(0, len(y), batch):
                at = order[i : i + batch]
                z, pooled, a, best, quarters = self.forward(x[at])
                dz = (sigmoid(z) - y[at]) * weight[at] / len(at)
                dp = np.outer(dz, self.p["o"]).reshape(len(at), 8, FILTERS)
                da = np.zeros_like(a)
                np.put_along_axis(da, best, dp[:, :4], 1)
                for k, q in enumerate(quarters):
                    da[:, q] += dp[:, 4 + k][:, None] / len(q)
                da *= a > 0
                dw = np.zeros_like(self.p["w"])
                flat = da.reshape(-1, FILTERS)
                for k in range(TAPS):
                    hot = np.zeros((flat.shape[0], CHANNELS), np.float64)
                    hot[np.arange(len(hot)), x[at][:, k : k + a.shape[1]].ravel()] = 1
                    dw[k] = hot.T @ flat
                step += 1
                for k, d in {"w": dw, "b": flat.sum(0), "o": pooled.T @ dz, "d": dz.sum(keepdims=True)}.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    s[k] = 0.99 * s[k] + 0.01 * d * d
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)])
        return sigmoid(self.slope * z + self.shift)


def decoys(seed: int = 4, n: int = 400) -> list[tuple[str, int, int]]:
    """Key-like runs that are no secrets: version strings, dates, paths, numbered words."""
    g = np.random.default_rng(seed)
    word = lambda: "".join(g.choice(list("etaoinshrdlu"), g.integers(3, 8)))
    out = []
    for i in range(n):
        body = (
            f"{word()}-{word()}-{word()}-{g.integers(1, 99)}",
            f"20{g.integers(10, 30)}-0{g.integers(1, 9)}-{g.integers(10, 28)}T0{g.integers(0, 9)}-00",
            f"{word()}/{word()}/{word()}{g.integers(1, 9)}/{word()}",
            f"{word()}_{word()}_{word()}_v{g.integers(1, 30)}",
        )[i % 4]
        text = f"{word()} {word()} {body} {word()} {word()}"
        a = text.index(body)
        out.append((text, a, a + len(body)))
    key = ("note", "title", "name", "example", "http", "color", "width", "size", "date", "id", "result", "lang", "class", "time")
    for _ in range(2 * n):
        lead, body = (
            ("", "".join(word() for _ in range(g.integers(4, 7))).ljust(16, "e")),
            (("number ", "order ", "phone ", "at ")[g.integers(4)], "".join(g.choice(list("0123456789"), g.integers(16, 24)))),
            (f"{key[g.integers(len(key))]}: ", word() + "es"),
            (f'{key[g.integers(len(key))]}="', f"{word()} {word()} {word()}"),
            (f"{key[g.integers(len(key))]} = ", str(g.integers(1000, 10**7))),
            ("http:", f"//{word()}.{word()}.com/{word()}"),
            (f"{word()}: ", word() + "er"),
        )[g.integers(7)]
        text = f"{word()} {word()} {lead}{body}{chr(34) * (chr(34) in lead)} {word()}"
        a = text.index(lead + body) + len(lead)
        out.append((text, a, a + len(body)))
    return out


def key_samples(seed: int = 6, n: int = 400) -> list[tuple[str, int, int]]:
    """Findings written as labelled examples: random keys of common shapes after the words that introduce them."""
    g = np.random.default_rng(seed)
    upper, every, low = (list(a) for a in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"))
    word = lambda: "".join(g.choice(list("etaoinshrdlu"), g.integers(3, 8)))
    out = []
    for i in range(n):
        alphabet = (upper, every, low)[i % 3]
        body = "".join(g.choice(alphabet, g.integers(20, 44)))
        lead = ("", "key = ", "token: ", "secret=")[i % 4]
        text = f"{word()} {word()} {lead}{body} {word()}"
        a = text.index(body)
        out.append((text, a, a + len(body)))
    keys = ("pwd", "pass", "password", "passwd", "auth_key", "secret", "token", "client_secret", "private_key", "credential", "passphrase", "access_key", "db_pass", "api-key", "auth")
    letters, digits, signs = every[:52], every[52:], every + list("!@#$%&*.?")
    for _ in range(2 * n):
        kind = g.integers(5)
        lead, quote = keys[g.integers(len(keys))] + (": ", "=", " = ", ":")[g.integers(4)], ("", '"', "'")[g.integers(3)]
        if kind == 0:  # letters alone
            body, lead = "".join(g.choice(letters, g.integers(16, 44))), ("", lead)[g.integers(2)]
        elif kind == 1:  # digits alone
            body = "".join(g.choice(digits, g.integers(6, 32)))
        elif kind == 2:  # a word with digits
            body = word() + word()[: g.integers(1, 5)] + str(g.integers(1, 999)) + ("", "x", "!")[g.integers(3)]
        else:
            body = "".join(g.choice((every, signs)[kind - 3], g.integers(6, 18)))
        text = f"{word()} {word()} {lead}{quote}{body}{quote} {word()}"
        a = text.index(lead + quote + body) + len(lead + quote)
        out.append((text, a, a + len(body)))
    return out


Case = tuple[str, int, int]


def views(text: str, a: int, b: int) -> list[Case]:
    """What the network looks at to judge the candidate from a to b: all of it, in windows that overlap by half where it is longer than two ends."""
    starts = range(a, b - 2 * END, END) if b - a > 2 * END else ()
    spans = [(s, s + 2 * END) for s in starts] + [(max(a, b - 2 * END), b)]
    return [(text[max(0, s - AROUND) : e + AROUND], min(s, AROUND), min(s, AROUND) + e - s) for s, e in spans]


def fit(cases: list[Case], labels: list[int], epochs: int = 12) -> Net:
    """A network from labelled windows, made keys and decoys; every fourth case only calibrates and sets the threshold.

    net.report holds the number of held-back findings, and recall and precision among all held-back cases."""
    cases, labels = list(cases), list(labels)
    for made, label in ((decoys(), 0), (key_samples(), 1)):
        cases += made
        labels += [label] * len(made)
    x, y = windows(cases), np.array(labels)
    held = np.random.default_rng(12).random(len(y)) < 0.25
    net = Net()
    net.fit(x[~held], y[~held], epochs)
    z = net.forward(x[held])[0]
    slope, net.shift = platt(z, y[held])
    net.slope = max(slope, 1e-3)
    p = net.probability(x[held])
    good = np.sort(p[y[held] == 1])
    net.threshold = float(good[int((1 - RECALL) * len(good))]) if len(good) else 1.1
    found = p >= net.threshold
    net.report = {"findings": len(good), "recall": float(found[y[held] == 1].mean()) if len(good) else 1.0, "precision": float(y[held][found].mean()) if found.any() else 1.0}
    return net


def labelled(texts: list[str]) -> Iterator[tuple[int, str, int, int]]:
    """(label, window) of each candidate and each span of a fixed pattern in the texts; candidates that a span overlaps are left to it."""
    for t in texts:
        base = base_spans(t)
        for a, _, b in base:
            yield from ((1, *v) for v in views(t, a, b)[:1])
        for a, b in candidates(t):
            if not any(s < b and a < e for s, _, e in base):
                yield from ((0, *v) for v in views(t, a, b))


def all_cases(documents: DataFrame) -> DataFrame:
    """(y, held, x): label, hold-out and channels of every window of the texts; equal windows are held back or not together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(labelled(texts_of(batch)))
            x = [w.tobytes() for w in windows([c[1:] for c in found]).astype(np.uint8)]
            held = [xxhash.xxh3_64_intdigest(w) % 4 == 0 for w in x]
            yield pa.RecordBatch.from_pydict({"y": pa.array([c[0] for c in found], pa.int32()), "held": pa.array(held, pa.bool_()), "x": pa.array(x, pa.binary())})

    small_batches(documents.sparkSession)
    return checkpointed(documents.select("text").mapInArrow(run, "y int, held boolean, x binary"))


def _channels_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def made_cases() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and hold-out of the decoys and made keys, as fit() deals them."""
    keys, others = key_samples(), decoys()
    y = np.array([0] * len(others) + [1] * len(keys))
    return windows([*others, *keys]).astype(np.uint8), y, np.random.default_rng(12).random(len(y)) < 0.25


def one_round(cases: DataFrame, net: Net, count: dict[int, int], rate: float) -> None:
    """Every task trains the network over all its cases, mixed with made ones; its parameters become the mean of theirs, by their number of cases."""
    start, names, every = net.p, list(net.p), sum(count.values())
    part = {y: 1 - MADE if count.get(y) else 0.0 for y in (0, 1)}
    made_x, made_y, made_held = made_cases()
    made_x, made_y = made_x[~made_held], made_y[~made_held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done, g = Net(), 0, np.random.default_rng(TaskContext.get().partitionId())
        own.p = {k: v.copy() for k, v in start.items()}

        def learn(x: np.ndarray, y: np.ndarray) -> None:
            weight = np.array([0.5 * part[k] * every / max(count.get(k, 0), 1) for k in (0, 1)])[y]
            more = [g.permutation(np.flatnonzero(made_y == k))[: max(1, len(y))] for k in (0, 1)]
            extra = [np.full(len(m), 0.5 * (1 - part[k]) * len(y) / len(m)) for k, m in enumerate(more)]
            more = np.concatenate(more)
            own.fit(np.concatenate([x, made_x[more]]), np.concatenate([y, made_y[more]]), EPOCHS, rate=rate, weight=np.concatenate([weight, *extra]))

        xs, ys, n = [], [], 0
        for batch in batches:
            xs.append(_channels_of(batch.column(1)))
            ys.append(batch.column(0).to_numpy())
            n += len(ys[-1])
            if n >= BLOCK:
                learn(np.concatenate(xs), np.concatenate(ys))
                xs, ys, n, done = [], [], 0, done + n
        if n:
            learn(np.concatenate(xs), np.concatenate(ys))
        if done + n:
            flat = np.concatenate([own.p[k].ravel() for k in names]) * (done + n)
            yield pa.RecordBatch.from_pydict({"g": pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), "n": pa.array([done + n], pa.int64()), "p": pa.array([flat.tobytes()], pa.binary())})

    def total(rows: pa.Table) -> pa.Table:
        flat = sum(np.frombuffer(p, np.float64) for p in rows.column("p").to_pylist())
        return pa.table({"n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()), "p": pa.array([flat.tobytes()], pa.binary())})

    tasks = cases.where("not held").select("y", "x").mapInArrow(run, "g int, n long, p binary")
    rows = tasks.groupBy("g").applyInArrow(total, "n long, p binary").collect()  # at most GROUPS rows
    if rows:
        flat, at = sum(np.frombuffer(r.p, np.float64) for r in rows) / sum(r.n for r in rows), 0
        net.p = {}
        for k in names:
            net.p[k] = flat[at : at + start[k].size].reshape(start[k].shape).copy()
            at += start[k].size


def calibrate(cases: DataFrame, net: Net) -> None:
    """Calibration and threshold from all held-back cases and the made ones held back, whose scores come as a histogram."""
    own = Net()
    own.p = net.p

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _channels_of(batch.column(1))
            if len(x):
                yield pa.RecordBatch.from_pydict({"y": batch.column(0), "z": pa.array(np.clip(own.forward(x)[0], -40, 40))})

    z = cases.where("held").select("y", "x").mapInArrow(scores, "y int, z double")
    bins = z.groupBy("y", F.floor(F.col("z") * BINS).alias("at")).agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.min("z").alias("low")).collect()  # at most 2 * 80 * BINS rows
    made_x, made_y, made_held = made_cases()
    made_z = np.clip(own.forward(made_x[made_held])[0], -40, 40)
    y = np.concatenate([np.array([r.y for r in bins], np.int64), made_y[made_held]])
    n = np.concatenate([np.array([r.n for r in bins], np.float64), np.ones(len(made_z))])
    mean, low = (np.concatenate([np.array([r[k] for r in bins], np.float64), made_z]) for k in ("mean", "low"))
    made = np.arange(len(y)) >= len(bins)
    weight = n.copy()
    for k in (0, 1):  # both classes weigh the same, made cases MADE of each
        for kind in (False, True):
            here, other = (y == k) & (made == kind), ((y == k) & (made != kind)).any()
            weight[here] *= 0.5 * n.sum() * ((MADE if kind else 1 - MADE) if other else 1) / max(n[here].sum(), 1)
    slope, net.shift = platt(mean, y, weight=weight)
    net.slope = max(slope, 1e-3)
    cut = 40.0
    for kind in (False, True):  # the asked recall is kept among the texts' findings and among the made ones
        good = np.flatnonzero((y == 1) & (made == kind))
        if len(good):
            good = good[np.argsort(low[good], kind="stable")]
            missed = np.concatenate([[0.0], np.cumsum(n[good])[:-1]])
            cut = min(cut, low[good[np.flatnonzero(missed <= (1 - RECALL) * n[good].sum())[-1]]])
    net.threshold = float(sigmoid(net.slope * cut + net.shift))
    found, pos = low >= cut, y == 1
    net.report = {"findings": int(n[pos].sum()), "recall": float(n[pos & found].sum() / n[pos].sum()), "precision": float(n[pos & found].sum() / n[found].sum())}


def train(documents: DataFrame) -> Net:
    """The network, from all findings of the fixed patterns and all other candidates of the documents; it starts from made cases alone."""
    net = fit([], [])
    cases = all_cases(documents)
    count = {r.y: r["count"] for r in cases.where("not held").groupBy("y").count().collect()}
    for i in range(ROUNDS if count else 0):
        one_round(cases, net, count, 2e-3 / (1 + i))
    calibrate(cases, net)
    return net


class Scanner:
    def __init__(self, net: Net):
        self.net = net

    def spans(self, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]]:
        """For each text its base spans, all spans, and the largest probability of a candidate."""
        base = [base_spans(t) for t in texts]
        cases, first, owner, at = [], [], [], []
        for i, t in enumerate(texts):
            for a, b in candidates(t):
                first.append(len(cases))
                cases += views(t, a, b)
                owner.append(i)
                at.append((a, b))
        seen = self.net.probability(windows(cases))
        p = np.maximum.reduceat(seen, first) if first else seen
        most, more = [0.0] * len(texts), [[] for _ in texts]
        for i, (a, b), q in zip(owner, at, p, strict=True):
            most[i] = max(most[i], float(q))
            if q < self.net.threshold:
                continue
            # What a fixed pattern took is its own; the rest of a value after it is still reported.
            for s, _, e in base[i]:
                if s < b and a < e:
                    a = e
            if more[i] and a < more[i][-1][2]:
                more[i][-1] = (more[i][-1][0], 3, max(b, more[i][-1][2]))
            elif any(map(str.isalnum, texts[i][a:b])):
                more[i].append((a, 3, b))
        return [(x, sorted(x + y), m) for x, y, m in zip(base, more, most, strict=True)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scanner(spark: SparkSession, net: Net):
    shared = spark.sparkContext.broadcast(net)
    return lambda texts: Scanner(shared.value).spans(texts)


def secret_scan(documents: DataFrame, net: Net) -> DataFrame:
    """Spans of secrets in every whole text, in code points, end exclusive.

    Null texts count as empty and have no spans; repeated rows get a row each; columns other
    than doc_id and text are not read; an empty table gives no rows. Very long texts and
    candidates are scanned whole, in time that grows with their length. Spans of the network
    never overlap those of the fixed patterns."""
    scan = _scanner(documents.sparkSession, net)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = scan(texts_of(batch))
        count = lambda k: pa.array([sum(s[1] == k for s in every) for _, every, _ in rows], pa.int64())
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column(0).cast(pa.int64()),
                "n_assign": count(0),
                "n_access": count(1),
                "n_hex": count(2),
                "base_sha256": pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _, _ in rows]),
                "spans": pa.array([written(every) for _, every, _ in rows]),
                "n_net": count(3),
                "max_prob": pa.array([m for _, _, m in rows]),
            }
        )

    return arrow_pass(documents, ["doc_id", "text"], run, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span's characters replaced by one mark that names its kind; overlapping spans share one."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(documents: DataFrame, net: Net) -> DataFrame:
    """documents with secrets masked in text, and n_chars, where there is such a column, counted anew.

    Null texts stay null, rows without a secret stay as they are, repeated rows are masked alike,
    an empty table gives no rows; all other columns, whatever their names, are passed on."""
    scan = _scanner(documents.sparkSession, net)
    names = documents.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        new = [masked(t, every) for t, (_, every, _) in zip(texts, scan(texts), strict=True)]
        null = batch.column(names.index("text")).is_null().to_pylist()
        cols = {n: batch.column(i) for i, n in enumerate(names)}
        cols["text"] = pa.array([None if z else t for z, t in zip(null, new, strict=True)], batch.column(names.index("text")).type)
        if "n_chars" in cols:
            old = batch.column(names.index("n_chars"))
            cols["n_chars"] = pa.array([o if z or t == n else len(n) for o, z, t, n in zip(old.to_pylist(), null, texts, new, strict=True)], old.type)
        return pa.RecordBatch.from_pydict(cols)

    return arrow_pass(documents, names, run, documents.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_scan(documents, train(documents))
