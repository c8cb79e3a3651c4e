"""A running state along ordered rows, for rules in which each decision depends on the one before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

from .bm25 import small_batches


def running(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Callable, name: str, kind: DataType) -> DataFrame:
    """rows with a column of what step gives along the rows of each key, in order.

    step(state, *inputs) returns (new state, value); the state is None on a key's first row. One
    shuffle and one sort; rows pass in Arrow batches and only inputs become Python values, so a
    key's rows are never held together. Null keys are one key, rows of equal order come in any
    order, and an empty table gives an empty one."""
    out = StructType([*[StructField(f.name, f.dataType, True) for f in rows.schema.fields], StructField(name, kind, True)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        key, state = None, None
        for batch in batches:
            made = []
            for k, x in zip(zip(*[batch.column(c).to_pylist() for c in keys]), zip(*[batch.column(c).to_pylist() for c in inputs])):
                if k != key:
                    key, state = k, None
                state, value = step(state, *x)
                made.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, to_arrow_type(kind))], names=[*batch.schema.names, name])

    small_batches(rows.sparkSession)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, out)
