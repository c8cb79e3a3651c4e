"""BPE encoding and decoding with segment trees over adjacent pair ranks.

A pre-token's symbols stand in a row; leaf i of a segment tree holds the rank of the pair
that begins at symbol i together with i, so the root's minimum is the leftmost
lowest-rank merge. A merge changes at most three leaves, each updated along its path to
the root. Many pre-tokens of one padded size are merged at once, a row of a matrix each.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_pass, texts_of

#: Splits text before merges: the published pattern of the byte-level vocabulary.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


@lru_cache(maxsize=1)
def newer_characters() -> regex.Pattern:
    """Letters and digits of the pattern engine's Unicode that the tokenizers library's older one doesn't know."""
    from tokenizers.pre_tokenizers import ByteLevel

    # Only characters that this Python doesn't know can differ.
    young = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c)]
    marked = "".join(f"\na{c}" for c in young) + "".join(f"\n1{c}" for c in young)
    ends = {e for _, (_, e) in ByteLevel(add_prefix_space=False).pre_tokenize_str(marked)}
    n = len(young)
    out = [c for i, c in enumerate(young) if 3 * i + 2 in ends and 3 * (n + i) + 2 in ends]
    return regex.compile("[" + "".join(map(regex.escape, out or ["\ue000"])) + "]")


#: Pieces of text kept with their ids by a worker: two generations of so many, of which the older goes. Longer pieces are not kept.
MEMORY, KEPT_CHARS = 350_000, 64
#: Symbols that the trees merged at once may hold together.
AT_ONCE = 1 << 20
NONE = np.int64(1) << np.int64(60)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        letters = byte_letters()
        byte = {c: b for b, c in letters.items()}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        keys = left << np.int64(20) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.stop = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge."""
        k = left << np.int64(20) | right
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.rank[at], NONE)


def merge_rows(v: Vocabulary, rows: list[bytes], leaves: int) -> list[list[int]]:
    """Ids of each row of bytes, none longer than leaves; leaves is a power of two."""
    n = len(rows)
    shift = np.int64(leaves.bit_length())
    length = np.array([len(r) for r in rows], np.int64)
    sym = np.full((n, leaves), -1, np.int64)
    filled = np.arange(leaves) < length[:, None]
    sym[filled] = v.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
    after = np.where(np.arange(1, leaves + 1) < length[:, None], np.arange(1, leaves + 1), -1)
    before = np.broadcast_to(np.arange(-1, leaves - 1), (n, leaves)).copy()
    tree = np.full((n, 2 * leaves), NONE, np.int64)
    pair = after >= 0
    where = np.nonzero(pair)
    r = v.ranks(sym[where], sym[where[0], where[1] + 1])
    tree[where[0], leaves + where[1]] = np.where(r < NONE, r << shift | where[1], NONE)
    size = leaves
    while size > 1:
        level = tree[:, size : 2 * size]
        tree[:, size // 2 : size] = np.minimum(level[:, ::2], level[:, 1::2])
        size //= 2
    live = np.flatnonzero(tree[:, 1] < NONE)
    while len(live):
        root = tree[live, 1]
        at = root & ((np.int64(1) << shift) - 1)
        gone = after[live, at]
        sym[live, at] = v.merged[root >> shift]
        nxt = after[live, gone]
        sym[live, gone] = -1
        after[live, at] = nxt
        has = nxt >= 0
        before[live[has], nxt[has]] = at[has]
        tree[live, leaves + gone] = NONE
        new = np.full(len(live), NONE, np.int64)
        rr = v.ranks(sym[live[has], at[has]], sym[live[has], nxt[has]])
        new[has] = np.where(rr < NONE, rr << shift | at[has], NONE)
        tree[live, leaves + at] = new
        prev = before[live, at]
        had = prev >= 0
        rr = v.ranks(sym[live[had], prev[had]], sym[live[had], at[had]])
        tree[live[had], leaves + prev[had]] = np.where(rr < NONE, rr << shift | prev[had], NONE)
        nodes = [leaves + gone, leaves + at, leaves + np.where(had, prev, at)]
        while nodes[0][0] > 1:
            nodes = [x >> 1 for x in nodes]
            for x in nodes:
                tree[live, x] = np.minimum(tree[live, 2 * x], tree[live, 2 * x + 1])
        live = live[tree[live, 1] < NONE]
    return [row[row >= 0].tolist() for row in sym]


def merge_all(v: Vocabulary, tokens: list[bytes]) -> list[list[int]]:
    """Ids of each pre-token; those of one padded size are merged together."""
    out: list[list[int]] = [[] for _ in tokens]
    by: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        if t:
            by.setdefault(max(2, 1 << (len(t) - 1).bit_length()), []).append(i)
    for leaves, at in by.items():
        step = max(1, AT_ONCE // leaves)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            for i, ids in zip(part, merge_rows(v, [tokens[i] for i in part], leaves), strict=True):
                out[i] = ids
    return out


class Codec:
    """Encodes and decodes whole texts, keeping the ids of pieces of text met before.

    A piece is a stretch between single spaces, with its leading space. The pattern never
    joins text across such a space, unless spaces meet: those texts are split as a whole.
    A str key stands for a piece with a space before it, a bytes key for the piece as it is,
    an int for a special token."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.special = {i: (str(i), self.v.bytes[i]) for i in self.v.special.values()}
        self.ids: dict = {}
        self.raw: dict = {}
        self.older: tuple[dict, dict] = ({}, {})

    def split(self, text: str) -> list[str]:
        """Pre-tokens. Characters that the pattern engine counts as letters or digits, but the vocabulary's older Unicode doesn't know, are none."""
        if text.isascii() or max(text) < "\u0530" or not (newer := newer_characters()).search(text):
            return PATTERN.findall(text)
        return [text[m.start() : m.end()] for m in PATTERN.finditer(newer.sub("\u0378", text))]

    def pieces(self, text: str) -> list:
        if "  " in text:
            return [t.encode() for t in self.split(text)]
        head, *rest = text.split(" ")
        return [head.encode(), *rest] if head else rest

    def parts(self, text: str) -> list:
        """Keys of the pieces of the text, and ids of the special tokens in it."""
        if not self.v.stop or "<|" not in text or not self.v.stop.search(text):
            return self.pieces(text) if text else []
        out, at = [], 0
        for m in self.v.stop.finditer(text):
            out += [*(self.pieces(text[at : m.start()]) if m.start() > at else []), self.v.special[m[0]]]
            at = m.end()
        return out + (self.pieces(text[at:]) if at < len(text) else [])

    def learn(self, keys: list) -> tuple[dict, dict]:
        """What each piece encodes to: its ids as text, and the bytes that these ids decode to."""
        split = [[t.encode() for t in self.split(k.decode() if k.__class__ is bytes else " " + k)] for k in keys]
        tokens = list({t for s in split for t in s})
        ids = dict(zip(tokens, merge_all(self.v, tokens), strict=True))
        written = {t: ",".join(map(str, i)) for t, i in ids.items()}
        back = {t: self.decode_bytes(i) for t, i in ids.items()}
        return (
            {k: ",".join([written[t] for t in s]) for k, s in zip(keys, split, strict=True)},
            {k: b"".join([back[t] for t in s]) for k, s in zip(keys, split, strict=True)},
        )

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.v.bytes[i] for i in ids])

    def run(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, the ids as text, and the decoded text."""
        parts = [self.parts(t) for t in texts]
        wanted = set().union(*parts)
        if len(self.ids) > MEMORY:
            self.ids, self.raw, self.older = {}, {}, (self.ids, self.raw)
        missing = wanted - self.ids.keys() - self.special.keys()
        again = missing & self.older[0].keys()
        for kept, old in zip((self.ids, self.raw), self.older, strict=True):
            kept.update((k, old[k]) for k in again)
        ids, raw = self.learn(list(missing - again))
        long = [k for k in ids if len(k) > KEPT_CHARS]
        special = [k for k in wanted if k.__class__ is int]
        self.ids |= ids | {k: self.special[k][0] for k in special}
        self.raw |= raw | {k: self.special[k][1] for k in special}
        id_of, raw_of, out = self.ids.__getitem__, self.raw.__getitem__, []
        for s in parts:
            written = ",".join(map(id_of, s))
            out.append((written.count(",") + 1 if s else 0, written, b"".join(map(raw_of, s)).decode("utf-8", "replace")))
        for k in long:
            del self.ids[k], self.raw[k]
        return out

    def encode(self, text: str) -> list[int]:
        written = self.run([text])[0][1]
        return [int(x) for x in written.split(",")] if written else []

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_round_trip(documents: DataFrame, path: str) -> DataFrame:
    """Digest of the ids of every whole text, and of the text that those ids decode to.

    path is where executors find the tokenizer file. Null texts count as empty and have no
    ids; repeated rows get a row each; columns other than doc_id and text are not read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = codec(path).run(texts_of(batch))
        sha = lambda k: pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows])
        return pa.RecordBatch.from_pydict(
            {"doc_id": batch.column(0).cast(pa.int64()), "n_tokens": pa.array([r[0] for r in rows], pa.int64()), "ids_sha256": sha(1), "decoded_sha256": sha(2)}
        )

    return arrow_pass(documents, ["doc_id", "text"], run, SCHEMA)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
