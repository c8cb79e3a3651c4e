"""What the training-data operators share: checkpoints, hold-out folds, bounded
samples of labelled rows, and Arrow passes over whole texts."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; long texts make larger counts a memory risk.
BATCH_ROWS = "256"
WORD = r"[^\x20\x09-\x0D]+"


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Python passes over texts get small Arrow batches, so that a worker holds few texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the cluster's shared checkpoint folder and cut from its lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Has the driver notice what no one refers to any more: only then does Spark delete shuffle files and old checkpoints."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """checkpointed(df), and what planning and running it left in the driver's heap goes at once: over many steps the heap would grow to its bound, whatever the data."""
    done = checkpointed(df)
    let_go(df.sparkSession)
    return done


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where it is unset and driver and executors are one process, as in tests, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="lamina-checkpoint-")


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo parts; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(0))


def smallest(df: DataFrame, by: str, n: int, key: str = "h") -> DataFrame:
    """The rows of the n smallest keys of each value of by; keys are 63-bit hashes, not negative.

    First a histogram of the keys' leading 20 bits, a bounded number of rows, tells how far to read, so that
    tasks pass on few rows beyond those asked for, however many tasks there are."""
    part = F.shiftright(key, 43)
    held: dict = {}
    for r in sorted(df.groupBy(by, part.alias("p")).agg(F.count("*").alias("n")).collect()):
        at = held.setdefault(r[0], [r.p, 0])
        if at[1] < n:
            held[r[0]] = [r.p, at[1] + r.n]
    some = df.where(F.lit(False))
    for value, (cut, _) in sorted(held.items()):
        some = some.unionAll(df.where((F.col(by) == value) & (part <= cut)).orderBy(*dict.fromkeys([key, *df.columns])).limit(n))
    return some


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int = 200_000, parts: int = 3, held: int = 1
) -> list[tuple[int, str, int]]:
    """At most per_class rows (doc_id, text, label) of each class, none of the held-out fold.

    The rows with the smallest hashes of their ids are taken, so the sample is the same in
    every run; its size, not its composition, is what keeps the fit bounded. Null labels and
    null ids are no examples; repeated ids count once, with the larger label; texts longer
    than max_chars are left out of the fit only.
    """
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold("_id", parts) != held))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
        .withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.col("_id"), F.lit(17)), 1))
    )
    ids = F.broadcast(smallest(picked, "_y", per_class, "_h").select("_id", "_y"))  # at most 2 * per_class rows
    texts = documents.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_t"))
    rows = texts.join(ids, "_id").where(F.length("_t") <= max_chars).groupBy("_id", "_y").agg(F.min("_t").alias("_t"))
    return sorted((r._id, r._t, r._y) for r in rows.collect())


def arrow_pass(
    df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """fn over each Arrow batch of the columns; other columns never reach Python."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.select(*columns).mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def crc_fold(ids: list, parts: int) -> np.ndarray:
    """The same remainder as fold(), in Python."""
    import zlib

    return np.array([0 if i is None else zlib.crc32(str(i).encode()) % parts for i in ids], np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(scores: np.ndarray, y: np.ndarray, steps: int = 200, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from raw scores to labels (Newton, with Platt's soft targets); a score of weight n counts n times."""
    weight = np.ones(len(scores)) if weight is None else weight
    pos, neg = float(weight[y == 1].sum()), float(weight[y == 0].sum())
    if not pos or not neg:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([scores, np.ones_like(scores)], 1).astype(float)
    w = np.array([0.0, np.log((pos + 1) / (neg + 1))])

    def loss(w):
        z = x @ w
        return float(np.sum(weight * (np.logaddexp(0, z) - t * z)))

    last = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (weight * (p - t)))
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * move) > last:
            rate /= 2
        w = w - rate * move
        now = loss(w)
        if last - now < 1e-10:
            break
        last = now
    return float(w[0]), float(w[1])
