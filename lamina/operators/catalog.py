"""Catalog maintenance: last entry wins, upserts, content identity, orphaned assets, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row of each key of an append-only catalog."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Fields of new over those of old, row by row; a null in new leaves the old value."""
    o, n = old.alias("o"), new.alias("n")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*cols)


def deduplicated(documents: DataFrame, content: str = "text", key: str = "doc_id") -> DataFrame:
    """Exact content identity: (content_id, first, copies)."""
    return documents.groupBy(F.substring(F.sha2(F.col(content), 256), 1, 16).alias("content_id")).agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def orphans(assets: DataFrame, uses: DataFrame) -> DataFrame:
    return assets.join(uses.select("asset_id").distinct(), "asset_id", "left_anti")


def fingerprint(files: DataFrame, recipe: str, group: str) -> DataFrame:
    """A digest of a group's recipe, file names and file digests, whatever their order. Each file is one digest, so a group's list stays small."""
    rows = F.array_sort(F.collect_list(F.concat_ws(":", "name", "digest")))
    return files.groupBy(group).agg(F.sha2(F.concat(F.lit(recipe + "|"), F.array_join(rows, "|")), 256).alias("fingerprint"))


def ambiguous(journal: DataFrame) -> DataFrame:
    """Requests that were sent and never ended."""
    return journal.where("kind = 'dispatch'").join(journal.where("kind = 'terminal'").select("request_id"), "request_id", "left_anti")


def decision_changes(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Blocks whose class differs between two runs, or that only one has."""
    o, n = old.select(*key, F.col(value).alias("old")), new.select(*key, F.col(value).alias("new"))
    return o.join(n, key, "full").where(~F.col("old").eqNullSafe(F.col("new")))
