"""Embedding near-dedup by product quantisation.

A coarse k-means of a bounded sample deals unit vectors to inverted lists; the residual
to the list's centre is coded by subspace codebooks. A vector probes every list whose
Voronoi cell may hold a vector within the link radius, which the distance to the plane
between the two centres decides, so no link is lost. In a list, table look-ups give the
distance to each coded vector; those that cannot be within the radius even with their
known coding error are dropped, all others are compared by exact cosine.

Lists are cut into tiles of bounded size, a pair of tiles a task's unit. A tile gives
counts and a spanning forest of its links, never all pairs; equal vectors are one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed
from .components import components, forest

COSINE = 0.98
#: Link radius between unit vectors, with room for rounding.
RADIUS = float(np.sqrt(2 - 2 * COSINE)) + 1e-9
SAMPLE, LISTS, PARTS, CODES, STEPS = 20_000, 4096, 8, 64, 8
TILE = 256
FINE = "vec_id long, label string, dim int, copies long, embedding array<double>, cell int, code binary, err double, asks boolean"


def kmeans(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 1) -> np.ndarray:
    g = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[g.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Quantiser:
    """Centres of the inverted lists and codebooks of the residuals' parts."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.centres = kmeans(sample, min(LISTS, max(1, int(np.sqrt(rows) / 2))))
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(np.ascontiguousarray(rest[:, a:b]), CODES, seed=3 + i) for i, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True))]

    def code(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals' parts, and how far each vector is from what its codes stand for."""
        rest = x - self.centres[cell]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], 1).astype(np.uint8)
        again = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - again) ** 2).sum(1))

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's own list, and all lists that may hold a vector within the radius."""
        square = (x * x).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres * self.centres).sum(1)
        own = square.argmin(1)
        owners, back = np.unique(own, return_inverse=True)
        between = np.stack([np.sqrt(((self.centres - self.centres[o]) ** 2).sum(1)) for o in owners])[back]
        plane = (square - square[np.arange(len(x)), own][:, None]) / (2 * np.maximum(between, 1e-15))
        near = plane <= RADIUS + 1e-9
        near[np.arange(len(x)), own] = True
        return own, [np.flatnonzero(r) for r in near]

    def distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distance of each x to each coded vector of the list, from tables."""
        rest = x - self.centres[cell]
        out = np.zeros((len(x), len(codes)), np.float32)
        for i, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            book = self.books[i]
            table = (rest[:, a:b] ** 2).sum(1)[:, None] - 2 * rest[:, a:b] @ book.T + (book**2).sum(1)
            out += np.take(table.astype(np.float32), codes[:, i], axis=1)
        return out


def unit(raw: np.ndarray) -> np.ndarray:
    top = np.abs(raw).max(1, keepdims=True)  # first scaled, so that squares neither vanish nor overflow
    x = raw / np.where(top > 0, top, 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) and pc.min_max(pc.list_value_length(column)).as_py() == {"min": width, "max": width}:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    rows = column.to_pylist()
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those
    without a label (of any simple type; labels are compared as text), are linked with nothing; so are vectors of different lengths with each
    other. Repeated rows count as separate vectors of one class. A null vec_id has no
    component and is kept. An empty table gives no rows. Columns other than vec_id, embedding
    and label are not read."""
    spark = embeddings.sparkSession
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    sound &= F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    keyed = every.withColumn("h1", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("h1").isNotNull(), F.xxhash64(F.lit(77), "embedding")))
    first = keyed.where("h1 is not null and vec_id is not null").groupBy("label", "h1", "h2").agg(F.count("*").alias("copies"), F.min(F.struct("vec_id", "embedding")).alias("s"))
    classes = checkpointed(first.select("label", "h1", "h2", "copies", "s.*"))
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if size.n:
        sample = classes.select("embedding").orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SAMPLE).toArrow()
        model = Quantiser(unit(padded(sample.column(0), size.d)), size.n)
        linked = _linked(classes, model, size.d)
    else:
        linked = spark.createDataFrame([], "a long, b long, n long")
    counts = linked.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n"))
    found = components(linked.where("b is not null").select("a", "b")).select(F.col("node").alias("vec_id"), F.col("component").alias("c"))
    known = classes.join(counts, "vec_id", "left").join(found, "vec_id", "left")
    known = known.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("c", "vec_id").alias("c"))
    out = keyed.select("vec_id", "label", "h1", "h2").join(known, ["label", "h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    return out.select(
        "vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def _linked(classes: DataFrame, model: Quantiser, width: int) -> DataFrame:
    """Rows (a, null, n): n vectors linked with a; and rows (a, b, 0): links that span the same components as all."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def fine(batches):
        q: Quantiser = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(padded(batch.column(3), width))
            own, near = q.probes(x)
            codes, err = q.code(x, own)
            row = np.repeat(np.arange(len(x)), [len(p) + 1 for p in near])
            cell = np.concatenate([np.concatenate([[o], p]) for o, p in zip(own, near, strict=True)])
            asks = np.ones(len(row), bool)
            asks[np.cumsum([0, *(len(p) + 1 for p in near[:-1])])] = False
            held = batch.take(pa.array(row))
            cols = {n: held.column(i) for i, n in enumerate(("vec_id", "label", "copies", "embedding"))}
            cols["dim"] = pc.list_value_length(held.column(3)).cast(pa.int32())
            cols |= {"cell": pa.array(cell.astype(np.int32)), "code": fixed(codes[row]), "err": pa.array(err[row]), "asks": pa.array(asks)}
            yield pa.RecordBatch.from_pydict({n.split()[0]: cols[n.split()[0]] for n in FINE.split(", ")})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    rows = checkpointed(classes.select("vec_id", "label", "copies", "embedding").mapInArrow(fine, FINE))
    keys = ["label", "dim", "cell"]
    held = rows.groupBy(*keys).agg(F.sum(F.when(F.col("asks"), 0).otherwise(1)).alias("rows"), F.sum(F.when(F.col("asks"), 1).otherwise(0)).alias("asking"))
    tiles = held.where("rows > 0").select(*keys, F.ceil(F.col("rows") / TILE).cast("int").alias("ts"), F.ceil(F.col("asking") / TILE).cast("int").alias("us"))
    dealt = rows.join(tiles, keys).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.when(F.col("asks"), F.col("us")).otherwise(F.col("ts"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("ts") - 1)).otherwise(F.sequence(F.lit(0), F.col("us") - 1))))
    dealt = dealt.withColumn("t", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own"))).withColumn("u", F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")))

    def compare(table: pa.Table) -> pa.Table:
        q: Quantiser = shared.value
        asks = table.column("asks").to_numpy()
        ids, copies = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
        raw = padded(table.column("embedding"), width)
        x = unit(raw)
        at, of = np.flatnonzero(asks), np.flatnonzero(~asks)
        a, b, n = [], [], []
        if len(at) and len(of):
            codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[of]
            err = table.column("err").to_numpy()[of]
            far = np.sqrt(np.maximum(q.distances(x[at], int(table.column("cell")[0].as_py()), codes), 0))
            i, j = np.nonzero(far - err <= RADIUS + 1e-3)
            i, j = at[i], of[j]
            cosine = np.concatenate([np.einsum("nd,nd->n", x[i[k : k + 20_000]], x[j[k : k + 20_000]]) for k in range(0, len(i), 20_000)]) if len(i) else np.zeros(0)
            close = (cosine >= COSINE) & (ids[i] != ids[j])
            i, j = i[close], j[close]
            total = np.bincount(i, copies[j], len(ids)).astype(np.int64)
            some = np.flatnonzero(total)
            edges = forest(ids[i].tolist(), ids[j].tolist())
            a = [*ids[some].tolist(), *(e[0] for e in edges)]
            b = [None] * len(some) + [e[1] for e in edges]
            n = [*total[some].tolist(), *([0] * len(edges))]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return checkpointed(dealt.select(*keys, "t", "u", "vec_id", "copies", "embedding", "code", "err", "asks").groupBy(*keys, "t", "u").applyInArrow(compare, "a long, b long, n long"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
