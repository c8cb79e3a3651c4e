"""MinHash near-dedup with circulant signatures, banding and exact Jaccard verification.

Two permutations give all coordinates: the first scatters a shingle over the 32-bit
circle, the second, shifted by k around it, orders shingles for coordinate k. Bands of
coordinates are buckets. Texts with equal shingle sets form a class that only its
smallest id represents. A bucket with few pairs gives them all; in a wide one every member
is held against one centre, and again against others once links have been followed, until
few pairs are left that no links join, or a turn gains little; those are all compared, in
tiles of bounded size, without making rows of pairs.
Pairs whose signatures agree too little are dropped (five standard errors below the
bound), all others are confirmed on their full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, let_go, settled, texts_of
from .components import components, forest

WORDS, PERCENT = 5, 75
BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
#: Pairs whose signatures agree in a smaller share of coordinates are no candidates.
AGREE = 0.6
#: Families of bands with a centre of their own, turns with centres at most, pairs for each member that count as few, and members of a tile.
CENTRES, TURNS, FEW, TILE = 4, 6, 4, 2048
#: Members on each side of a tile in which wide buckets are compared in full.
SIDE = 128
#: Share of the open pairs that a turn must leave at most, to be followed by another of its kind.
GAIN = 0.7
PAIR = ["a", "b", "ca", "cb"]
TILED = "key long, t int, u int, id long, c long, asks boolean, others array<long>"
#: Words kept with their hashes by a worker; beyond, the memory starts anew.
MEMORY = 400_000
#: Shingles hashed at once, so that the arrays stay in cache.
STEP = 8192
#: Bits of the filter of candidate ids: so many for each, between bounds.
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 16, 1 << 16, 1 << 26
SIGNED = "doc_id long, d1 long, d2 long, n long, bands array<long>, low binary"
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def scatter(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self):
        class Hashes(dict):
            def __missing__(self, word: bytes) -> int:
                h = self[word] = xxhash.xxh3_64_intdigest(word)
                return h

        self.hashes = Hashes()

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.hashes) > MEMORY:
            self.hashes.clear()
        out = []
        for t in texts:
            words = t.encode().lower().split()  # bytes: A-Z only, ASCII white space only
            if not words:
                out.append(np.zeros(0, np.uint64))
                continue
            x = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
            width = min(WORDS, len(x))
            n = len(x) - width + 1
            h = np.full(n, width, np.uint64)
            for k in range(width):
                h = scatter(h + x[k : k + n] * _M2)
            h.sort()
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(coordinates, sets) smallest values; every set has a member."""
    sizes = np.array([len(s) for s in sets])
    x = (scatter(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    out = np.full((COORDINATES, len(sets)), 0xFFFFFFFF, np.uint32)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sets)), sizes)
    y, z = np.empty(STEP, np.uint32), np.empty(STEP, np.uint32)
    for i in range(0, len(x), STEP):
        part = x[i : i + STEP]
        a, b = y[: len(part)], z[: len(part)]
        first, last = owner[i], owner[min(i + STEP, len(x)) - 1]
        starts = np.concatenate([[0], ends[first:last] - i])
        for k in range(COORDINATES):
            np.add(part, np.uint32(k), out=a)  # the circle turned by k
            np.right_shift(a, 16, out=b)
            np.bitwise_xor(a, b, out=a)
            np.multiply(a, np.uint32(0x85EBCA6B), out=a)
            np.right_shift(a, 13, out=b)
            np.bitwise_xor(a, b, out=a)
            np.multiply(a, np.uint32(0xC2B2AE35), out=a)
            np.right_shift(a, 16, out=b)
            np.bitwise_xor(a, b, out=a)
            row = out[k, first : last + 1]
            np.minimum(row, np.minimum.reduceat(a, starts), out=row)
    return out


def signed(documents: DataFrame) -> DataFrame:
    """For each row its set's digest and size, band buckets and the low bytes of its coordinates; no digest for empty sets."""
    state: list[Shingles] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Shingles())
        sets = state[0].sets(texts_of(batch))
        full = [i for i, s in enumerate(sets) if len(s)]
        d1, d2, bands, low = ([None] * len(sets) for _ in range(4))
        if full:
            sig = signatures([sets[i] for i in full])
            at = np.zeros((BANDS, len(full)), np.uint64)
            for r in range(ROWS):
                at = scatter(at * _M2 + sig[r::ROWS].astype(np.uint64) + np.uint64(1))
            at = scatter(at + np.arange(BANDS, dtype=np.uint64)[:, None]).T.astype(np.int64)
            for j, i in enumerate(full):
                both = xxhash.xxh3_128_intdigest(sets[i].tobytes())
                d1[i], d2[i] = (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)
                bands[i] = at[j]
                low[i] = (sig[:, j] & np.uint32(255)).astype(np.uint8).tobytes()
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column(0).cast(pa.int64()),
                "d1": pa.array(d1, pa.int64()),
                "d2": pa.array(d2, pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "bands": pa.array(bands, pa.list_(pa.int64())),
                "low": pa.array(low, pa.binary()),
            }
        )

    return arrow_pass(documents, ["doc_id", "text"], run, SIGNED)


def agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b, ca, cb) that may be alike by their sizes and signatures."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("low").alias(f"l{c}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COORDINATES) for k in (4, 5))
        share = ((a == b).mean(1) - 1 / 256) / (1 - 1 / 256)  # low bytes of unlike coordinates agree once in 256
        return batch.select(PAIR).filter(pa.array(share >= AGREE))

    return arrow_pass(both, [*PAIR, "la", "lb"], run, "a long, b long, ca long, cb long")


def id_filter(ids: DataFrame, n: int):
    """A Bloom filter of n ids, of at most FILTER_MOST bits; beyond, it lets more through and the join after it decides."""
    bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_BITS * n - 1).bit_length()))
    place = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(bits))
    at = ids.select(place(1).alias("at")).unionAll(ids.select(place(2)))
    words = at.groupBy(F.shiftright("at", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(at, 32) as int)))").alias("v")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy().astype(np.uint32)
    return bits, table


def sets_of(ids: DataFrame, n: int, documents: DataFrame) -> DataFrame:
    """(id, s): the full shingle sets of the documents whose id is among the n ids; of other documents only the ids are read on."""
    bits, table = id_filter(ids, n)
    shared = documents.sparkSession.sparkContext.broadcast(table)
    state: list[Shingles] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Shingles())
        at = np.stack([batch.column(k).to_numpy() for k in (2, 3)])
        hit = (shared.value[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).all(0)
        kept = batch.filter(pa.array(hit))
        sets = state[0].sets(texts_of(kept))
        return pa.RecordBatch.from_pydict({"id": kept.column(0).cast(pa.int64()), "s": pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))})

    place = lambda seed: F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(bits))
    read = documents.where("doc_id is not null").select(F.col("doc_id"), "text", place(1).alias("p"), place(2).alias("q"))
    sets = settled(arrow_pass(read, ["doc_id", "text", "p", "q"], run, "id long, s array<long>").join(ids.hint("merge"), "id", "left_semi"))
    shared.destroy()  # the sets lie in the shared folder: no task will ask for it again
    return sets


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the components of those pairs whose full shingle sets are alike enough."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")).hint("merge")
    common = F.size(F.array_intersect("sa", "sb"))
    alike = common * 100 >= (F.size("sa") + F.size("sb") - common) * PERCENT
    return pairs.join(side("a"), "a").join(side("b"), "b").where(alike).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def open_buckets(named: DataFrame) -> DataFrame:
    """Buckets that hold several components: how many pairs of these are open, the component of most members, and a centre."""
    parts = named.groupBy("key", "c").agg(F.count("*").alias("m"), F.min(F.struct("o", "id")).alias("s"))
    whole = parts.groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("q"), F.max(F.struct("m", "c")).alias("main"), F.min(F.struct("s.o", "s.id", "c")).alias("centre"), F.count("*").alias("parts"))
    left = F.col("n") * F.col("n") - F.col("q")
    return whole.where("parts > 1").select("key", left.alias("left"), (left > FEW * F.col("n")).alias("wide"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), F.ceil(F.col("n") / SIDE).cast("int").alias("ts"), F.ceil((F.col("n") - F.col("main.m")) / SIDE).cast("int").alias("us"), F.col("main.c").alias("cm"), F.col("centre.id").alias("x"), F.col("centre.c").alias("cx"))


def candidate_pairs(named: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b, ca, cb): pairs of members of one bucket and of different components.

    A bucket with few such pairs gives them all, dealt out in tiles of TILE members; in a
    wide one all members are held against one centre, one pair each."""
    held = named.select("key", "id", "c").join(whole.hint("merge"), "key")
    own = F.pmod(F.xxhash64("id", F.lit(9)), F.col("tiles")).cast("int")
    others = held.where("not wide").select("key", own.alias("tile"), "id", "c")
    stray = held.where("not wide and c <> cm").select("key", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("id").alias("x"), F.col("c").alias("cx"))
    cols = ["id", "c", "x", "cx"]
    both = held.where("wide").select(*cols).unionAll(others.join(stray.hint("merge"), ["key", "tile"]).select(*cols)).where("c <> cx")
    low = F.col("id") < F.col("x")
    swapped = lambda p, q: F.when(low, F.col(p)).otherwise(F.col(q))
    both = both.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"), swapped("c", "cx").alias("ca"), swapped("cx", "c").alias("cb"))
    return both.groupBy("a", "b").agg(F.min("ca").alias("ca"), F.min("cb").alias("cb"))


def tiled(named: DataFrame, whole: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, t, u, id, c, asks, others): in wide buckets, members to compare in full, dealt out in tiles.

    A tile holds at most about SIDE members and SIDE of those outside the main component
    (asks), with, for each of these, the members whose signatures agree enough. A pair that
    shares several buckets stands in the first only. Pairs never become rows."""
    held = named.select("key", "id", "c").join(whole.where("wide").select("key", "cm", "ts", "us").hint("merge"), "key")
    held = held.join(reps.select(F.col("doc_id").alias("id"), "n", "bands", "low").hint("merge"), "id")
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(9)), F.col(n)).cast("int")
    place = lambda t, u, asks: F.struct(t.alias("t"), u.alias("u"), F.lit(asks).alias("asks"))
    stray = F.col("c") != F.col("cm")
    asked = F.transform(F.sequence(F.lit(0), F.col("us") - 1), lambda i: place(own("ts"), i, False))
    asking = F.when(stray, F.transform(F.sequence(F.lit(0), F.col("ts") - 1), lambda i: place(i, own("us"), True))).otherwise(F.array().cast("array<struct<t:int,u:int,asks:boolean>>"))
    dealt = held.select("key", "id", "c", "n", "bands", "low", stray.alias("stray"), F.explode(F.concat(asked, asking)).alias("x"))

    def agree(table: pa.Table) -> pa.Table:
        n, ids, comp, asks, strays = (table.column(k).to_numpy() for k in ("n", "id", "c", "asks", "stray"))
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(n), BANDS)
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(n), COORDINATES)
        band = int((bands[0] == table.column("key")[0].as_py()).argmax())
        of, used, rows, others = np.flatnonzero(~asks), np.zeros(len(n), bool), [], []
        for i in np.flatnonzero(asks).tolist():
            near = (comp[of] != comp[i]) & (np.minimum(n[of], n[i]) * 100 >= np.maximum(n[of], n[i]) * PERCENT) & (~strays[of] | (ids[i] < ids[of]))
            near &= ((low[of] == low[i]).mean(1) - 1 / 256) / (1 - 1 / 256) >= AGREE
            near &= ~(bands[of, :band] == bands[i, :band]).any(1)
            if near.any():
                used[of[near]] = True
                rows.append(i)
                others.append(ids[of[near]])
        all_ = np.concatenate([np.array(rows, np.int64), np.flatnonzero(used)])
        out = table.select(["key", "t", "u", "id", "c", "asks"]).take(pa.array(all_))
        return out.append_column("others", pa.array([*others, *[None] * int(used.sum())], pa.list_(pa.int64())))

    return dealt.select("key", "x.*", "id", "c", "n", "bands", "low", "stray").groupBy("key", "t", "u").applyInArrow(agree, TILED)


def tile_links(tiles: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): components joined by pairs of tiled() whose full sets are alike enough; a tile gives no more than join what it holds."""

    def verify(table: pa.Table) -> pa.Table:
        ids, comp, asks = (table.column(k).to_numpy() for k in ("id", "c", "asks"))
        of = np.flatnonzero(~asks)
        s = table.column("s").combine_chunks()
        at, every = s.offsets.to_numpy(), s.values.to_numpy().view(np.uint64)
        size = np.diff(at)
        place = {int(ids[j]): k for k, j in enumerate(of)}
        flat = np.concatenate([every[at[j] : at[j + 1]] for j in of]) if len(of) else np.zeros(0, np.uint64)
        end = np.cumsum(size[of])
        a, b, others = [], [], table.column("others")
        for i in np.flatnonzero(asks).tolist():
            mine = every[at[i] : at[i + 1]]
            hit = np.concatenate([[0], np.cumsum(mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat)])
            common = hit[end] - hit[end - size[of]]
            k = np.array([place[x] for x in others[i].as_py()])
            good = k[common[k] * 100 >= (size[of[k]] + size[i] - common[k]) * PERCENT]
            a += [int(comp[i])] * len(good)
            b += comp[of[good]].tolist()
        edges = forest(a, b)
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([x for _, x in edges], pa.int64())})

    return tiles.join(sets.hint("merge"), "id").groupBy("key", "t", "u").applyInArrow(verify, "a long, b long")


def linked(members: DataFrame, reps: DataFrame, documents: DataFrame) -> DataFrame | None:
    """(id, c) of every representative, c its component, or None without any link: every pair of a bucket (band, key, id) is confirmed, refused, or joined by other links.

    Each turn works on the components found so far, so that its links join components and
    no earlier link is read again. In wide buckets centres differ between CENTRES families
    of bands and between turns, so that few members miss all; once few pairs are open in
    wide buckets, or a turn has closed few of them, all are compared, within tiles."""
    size, label, tested, before = members.count(), None, None, None
    for turn in range(TURNS + 1):
        named = members.withColumn("c", F.col("id")) if label is None else members.join(label.hint("merge"), "id")
        named = named.select("key", "id", "c", F.xxhash64("id", F.col("band") % CENTRES, F.lit(turn)).alias("o"))
        whole = settled(open_buckets(named))
        left = whole.agg(F.sum(F.when(F.col("wide"), F.col("left"))).alias("n")).first().n or 0
        last = turn == TURNS or left <= FEW * size * (turn > 0) or (before is not None and left > GAIN * before)
        before = left
        pairs = candidate_pairs(named, whole.where("not wide") if last else whole)
        if tested is not None:
            pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")
        pairs = settled(pairs)
        tested = pairs.select("a", "b") if tested is None else tested.unionAll(pairs.select("a", "b"))
        some = settled(agreeing(pairs, reps))
        ids = some.select(F.explode(F.array("a", "b")).alias("id"))
        tiles = settled(tiled(named, whole, reps)) if last and left else None
        if tiles is not None:
            ids = ids.unionAll(tiles.select("id"))
        ids = settled(ids.distinct())
        if n := ids.count():
            sets = sets_of(ids, n, documents)
            links = confirmed(some, sets)
            if tiles is not None:
                links = links.unionAll(tile_links(tiles, sets))
            found = components(links).select(F.col("node").alias("c"), F.col("component").alias("to"))
            known = reps.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("c")) if label is None else label
            label = settled(known.join(found.hint("merge"), "c", "left").select("id", F.coalesce("to", "c").alias("c")))
            sets = links = found = known = None
        named = whole = pairs = some = ids = tiles = None
        let_go(documents.sparkSession)
        if last:
            break
    return label


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Null and empty texts have no shingles and are linked with nothing. Rows with equal sets
    are one class; copies are never expanded into pairs. Repeated rows get a row each, with
    the same component. Rows of different texts under one id count as one document in links.
    A null doc_id has no component and is kept. Columns other than doc_id and text aren't read."""
    rows = settled(signed(documents))
    first = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n", "bands", "low")).alias("s"))
    reps = settled(first.select("d1", "d2", "s.*"))
    buckets = reps.select(F.posexplode("bands").alias("band", "key"), F.col("doc_id").alias("id"))
    several = buckets.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    members = settled(buckets.join(several.hint("merge"), "key"))
    label = linked(members, reps, documents)
    known = reps.select("d1", "d2", F.col("doc_id").alias("id"))
    classes = known.select("d1", "d2", F.col("id").alias("c")) if label is None else known.join(label.hint("merge"), "id").select("d1", "d2", "c")
    out = rows.select("doc_id", "n", "d1", "d2").join(classes.hint("merge"), ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of documents, whole, of the smallest id of each component; of rows that share an id, all."""
    gone = near_duplicates(documents).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(gone, documents["doc_id"] == gone["_gone"], "left_anti")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
