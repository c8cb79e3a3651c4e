"""Best-fit packing of tokenised documents into sequences of fixed length.

The lengths' histogram, of one entry a length, is all that the plan needs. The covering
program over configurations (multisets of lengths that fit a sequence) is solved by
multiplicative weights: in each round a knapsack dynamic program prices configurations
under the lengths' weights, its table gives a best one around every length, and lengths
that fall behind gain weight. The weights, scaled so that no configuration is worth more
than one, are duals: they bound the number of sequences from below. Rounding prices again
under the best duals, over what is still due, and uses configurations worth (nearly) one
whole numbers of times. What is left goes, in order of length, to the fullest sequences
that have room. Pieces find their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, texts_of

CAPACITY, SEPARATOR = 4096, 1
#: Rounds of the program, the rate of its weights, how far below one a configuration's worth may be, pricings for each of these.
ROUNDS, ETA, SHORT, PASSES = 12, 0.3, (0.0, 1 / 2048, 1 / 512, 1 / 128, 1 / 32), 16
#: A pricing that places a smaller share of what is due is the last of its kind.
LEAST = 0.02
#: Words and pre-tokens kept with their ids by a worker, and the longest that are; words in two generations, of which the older goes.
MEMORY, KEPT = 200_000, 48
#: Words whose lower case and normal form are plain, and how the vocabulary's published pattern splits them.
PLAIN = regex.compile(r"[\x21-\x7e\u00c0-\u012f\u0131-\u017f]+")
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PRE_TOKEN_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
Plan = list[tuple[tuple[int, ...], int]]


def byte_letters() -> dict[int, str]:
    """The published byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokens:
    """Ids of whole texts. Words between ASCII white space are encoded on their own: neither the
    vocabulary's normal forms nor its pattern reach across white space. Plain words are split
    into pre-tokens here, of which there are fewer, and only new ones are merged."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        merge, letters = self.tokenizer.model.tokenize, byte_letters()

        class Parts(dict):
            def __missing__(self, part: str) -> bytes:
                named = part if part.isascii() else part.encode().decode("latin-1").translate(letters)
                ids = array("I", [t.id for t in merge(named)]).tobytes()
                if len(self) > MEMORY:
                    self.clear()
                if len(part) <= KEPT:
                    self[part] = ids
                return ids

        self.parts = Parts()
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word."""
        found, rest, part = {}, [], self.parts.__getitem__
        for w in words:
            if "<|" in w or not (w.isascii() and w.isprintable() or PLAIN.fullmatch(w)):
                rest.append(w)
                continue
            low = w.lower()
            if low.isalpha():
                found[w] = part(low)
            else:
                found[w] = b"".join(map(part, (PRE_TOKEN_ASCII if low.isascii() else PRE_TOKEN).findall(low)))
        coded = self.tokenizer.encode_batch(rest, add_special_tokens=False)
        return found | {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, coded, strict=True)}

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian 32-bit ids of each text."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.kept) > MEMORY:
            self.kept, self.older = {}, self.kept
        got = [*map(self.kept.get, words)]
        late = [i for i, x in enumerate(got) if x is None]
        again = {words[i]: x for i in late if (x := self.older.get(words[i])) is not None}
        found = self.encoded([words[i] for i in late if words[i] not in again])
        self.kept |= again
        for i in late:
            w = words[i]
            got[i] = x = again.get(w) or found[w]
            if len(w) <= KEPT:
                self.kept[w] = x
        # Each word's ids, one after the other, are copied to all its places at once.
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        pool, start = np.frombuffer(b"".join(got), "<u4"), np.cumsum(size) - size
        at = coded.indices.to_numpy()
        n = size[at]
        end = np.cumsum(n)
        ids = pool[np.repeat(start[at] - end + n, n) + np.arange(n.sum())]
        cut = np.concatenate([[0], end])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(documents: DataFrame, path: str) -> DataFrame:
    """A row for each piece, numbered among the pieces of its length in its task."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen = np.zeros(CAPACITY + 1, np.int64)
        end = np.array([SEPARATOR], "<u4")
        for batch in batches:
            rows = []
            for doc, words in zip(batch.column(0).to_pylist(), tokens(path).texts(texts_of(batch)), strict=True):
                ids = np.concatenate([words, end])
                for k in range(0, len(ids), CAPACITY):
                    part = ids[k : k + CAPACITY]
                    n = len(part)
                    rows.append((doc, k // CAPACITY, k, n, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity, and the length to take first there, the largest of equals; where none helps, minus the next lower capacity where one does."""
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    down, worth = lengths[::-1], value[::-1]
    fit = len(lengths) - np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    last = 0
    for c in range(1, capacity + 1):
        best[c], first[c] = best[c - 1], -last
        k = fit[c]
        if k < len(lengths):
            x = best[c - down[k:]] + worth[k:]
            i = int(x.argmax())
            if x[i] > best[c]:
                best[c], first[c], last = x[i], down[k + i], c
    return best, first


def traced(first: np.ndarray, c: int) -> list[int]:
    """The lengths of a best configuration of capacity c, from knapsack's table."""
    out = []
    while c > 0:
        n = int(first[c])
        if n > 0:
            out.append(n)
            c -= n
        else:
            c = -n
    return out


def duals(demand: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, float]:
    """The worth of each length, of which no configuration holds more than one, and the bound on the number of sequences that it proves."""
    lengths = np.flatnonzero(demand)
    due, worth = demand[lengths].astype(float), np.zeros(capacity + 1)
    if not len(lengths):
        return worth, 0.0
    most, y = 0.0, lengths / capacity
    for _ in range(ROUNDS):
        best, first = knapsack(lengths, y, capacity)
        if (bound := float(due @ y / best[capacity])) > most * (1 + 1e-9):
            most = bound
            worth[lengths] = y / best[capacity]
        left = np.zeros(capacity + 1)
        left[lengths] = due
        for i in lengths[::-1].tolist():  # best configurations, each as often as its scarcest length allows
            if left[i] > 0:
                config = Counter([i, *traced(first, capacity - i)])
                times = min(left[k] / n for k, n in config.items())
                for k, n in config.items():
                    left[k] -= times * n
        behind = left[lengths] / due
        if not behind.any():
            break
        y = y * np.exp(ETA * (behind - behind.mean()))
    return worth, most


def programmed(demand: np.ndarray, capacity: int = CAPACITY) -> tuple[Plan, np.ndarray, float]:
    """Configurations with whole counts, what they leave due, and the program's bound."""
    worth, bound = duals(demand, capacity)
    due, out = demand.astype(np.int64).copy(), []
    for short in SHORT:
        for _ in range(PASSES):
            lengths = np.flatnonzero(due)
            best, _ = knapsack(lengths, worth[lengths], capacity)
            before = due.sum()
            down = lengths[::-1]
            value, fit = worth[down], len(down) - np.searchsorted(lengths, np.arange(capacity + 1), side="right")
            for i in lengths[::-1].tolist():
                while due[i] and worth[i] + best[capacity - i] >= 1 - short - 1e-9:
                    # Of the best fillings, the one of the largest lengths that are still due.
                    config, room, total = Counter([i]), capacity - i, worth[i]
                    due[i] -= 1
                    while fit[room] < len(down):
                        x = best[room - down[fit[room] :]] + value[fit[room] :]
                        x[due[down[fit[room] :]] <= 0] = -1
                        k = int((x >= x.max() - 1e-12).argmax())
                        if x[k] < 0:
                            break
                        length = int(down[fit[room] + k])
                        config[length] += 1
                        due[length] -= 1
                        room -= length
                        total += worth[length]
                    if total < 1 - short - 1e-9:
                        for k, m in config.items():
                            due[k] += m
                        break
                    n = min(int(due[k]) // m for k, m in config.items())
                    for k, m in config.items():
                        due[k] -= n * m
                    out.append((tuple(sorted(config.elements(), reverse=True)), n + 1))
            if before - due.sum() <= LEAST * before:
                break
    return out, due, bound


def best_fit(due: np.ndarray, started: Plan, capacity: int = CAPACITY) -> Plan:
    """The plan completed: lengths in descending order go to the fullest sequence that has room, many alike at once."""
    due = due.astype(np.int64).copy()
    rooms: dict[int, list[list]] = {}
    full = np.zeros(capacity + 1, bool)  # rooms with at least one group

    def put(config: tuple[int, ...], n: int) -> None:
        room = capacity - sum(config)
        rooms.setdefault(room, []).append([config, n])
        full[room] = True

    for config, n in started:
        put(config, n)
    for length in range(capacity, 0, -1):
        while due[length]:
            room = length + int(full[length:].argmax())
            if not full[room]:
                most = capacity // length
                n = int(due[length]) // most
                if n:
                    put((length,) * most, n)
                if rest := int(due[length]) % most:
                    put((length,) * rest, 1)
                due[length] = 0
                break
            group = rooms[room][-1]
            n = min(int(due[length]), group[1])
            group[1] -= n
            if not group[1]:
                rooms[room].pop()
                full[room] = bool(rooms[room])
            put((*group[0], length), n)
            due[length] -= n
    return sorted((config, n) for groups in rooms.values() for config, n in groups)


def plan(demand: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Configurations and whole counts that hold every piece of the histogram exactly once."""
    started, due, _ = programmed(demand, capacity)
    return best_fit(due, started, capacity)


def runs(found: Plan) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: a slot of each configuration takes as many ranks as the configuration has sequences."""
    out, rank, sequence = [], {}, 0
    for config, n in found:
        offset = 0
        for length in config:
            r = rank.get(length, 0)
            out.append((length, r, sequence, offset))
            rank[length] = r + n
            offset += length
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(documents: DataFrame, path: str) -> DataFrame:
    """Sequence and offset of every piece of every document.

    Null and empty texts are one piece, the separator alone; repeated rows and repeated ids
    are packed once for each row; columns other than doc_id and text are not read. An empty
    table gives no rows. At most CAPACITY histogram rows reach the driver, and the plan that
    goes back to the executors is bounded by rounds, pricings and lengths, not by documents."""
    spark = documents.sparkSession
    cut = checkpointed(pieces(documents, path))
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = checkpointed(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))))
    demand = np.zeros(CAPACITY + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most CAPACITY rows
        demand[r.length] = r.n
    shared = spark.sparkContext.broadcast(runs(plan(demand)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            cols = {n: b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(row[:, 2] + rank - row[:, 1]), "offset": pa.array(row[:, 3])})

    ranked = cut.join(counts.select("length", "task", "first"), ["length", "task"]).withColumn("rank", F.col("first") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PLACED)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
