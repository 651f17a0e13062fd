"""Row functions over Arrow batches: nulls stay nulls and integers whole, whatever a batch holds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are taken from a batch at a time, which bounds what lies in Python's memory.
AT_A_TIME = 2000


def map_rows(df: DataFrame, start: Callable[[], Callable[..., Iterable[tuple]]], schema: StructType) -> DataFrame:
    """Rows of ``schema`` from the rows of ``df``, without a shuffle.

    ``start`` is called once a task and gives a function of one value a column
    of df that returns the rows it becomes.
    """
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        for b in batches:
            for i in range(0, b.num_rows, AT_A_TIME):
                part = b.slice(i, AT_A_TIME)
                rows = [r for values in zip(*(c.to_pylist() for c in part.columns)) for r in one(*values)]
                columns = zip(*rows) if rows else [()] * len(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, wanted)], schema=wanted)

    return df.mapInArrow(run, schema)


def with_key(df: DataFrame, key: str, *fields: str) -> StructType:
    """Schema of ``key`` as in df and of fields given as ``name type``."""
    out = StructType().add(key, df.schema[key].dataType)
    for f in fields:
        name, kind = f.split(" ", 1)
        out = out.add(name, kind)
    return out
