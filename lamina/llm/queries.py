"""Queries over the training-data operators, and their DuckDB counterparts where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_OPS = {
    "op2_packing": "packing",
    "op1_toxicity": "toxicity",
    "op3_quality_rules": "quality_rules",
    "op4_vector_dedup": "vector_dedup",
    "op5_secret_scan": "secret_scan",
    "op6_minhash": "minhash",
    "op7_bpe": "bpe",
    "op8_lm_score": "lm_score",
    "op9_quality_classifier": "quality_net",
    "op10_chat_format": "chat",
}


def _query(name: str, module: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(import_module(f"{__package__}.{module}"), name)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name, module) for name, module in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_format": import_module(f"{__package__}.chat").ORACLE}
