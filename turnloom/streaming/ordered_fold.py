"""Folds over the rows of each key in order, for state machines that no window expresses.

Rows are dealt by key and sorted within partitions, and a partition is read row by row: a key of any
length holds no more than its state and one batch in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

BATCH = 2000


def in_order(df: DataFrame, keys: list[str], order: list[str], row: type, fold: Callable[[Iterator], Iterator[tuple]], schema: str) -> DataFrame:
    """fold's output rows for each key's rows, as tuples of the type row with df's columns, in order."""
    out_schema = to_arrow_schema(StructType(_parse_datatype_string(schema).fields))
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(out_schema)], schema=out_schema)

        out: list[tuple] = []
        for _, group in groupby(rows(), key=lambda r: tuple(r[i] for i in at)):
            for got in fold(row(*r) for r in group):
                out.append(got)
                if len(out) == BATCH:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
