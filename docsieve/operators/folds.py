"""Ordered folds: a value for each row that hangs on all rows of its key before it.

Rows are dealt by key and sorted within their partition, and each key's are streamed past a state, so that
memory holds the state of one key and a batch of rows, however many rows a key has. The order of one key's
rows is one task's work, as each step needs the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

_KINDS = {"int": (T.IntegerType(), pa.int32()), "long": (T.LongType(), pa.int64()), "double": (T.DoubleType(), pa.float64()), "string": (T.StringType(), pa.string()), "boolean": (T.BooleanType(), pa.bool_())}


def ordered_fold(
    rows: DataFrame, keys: list[str], order: list[str | Column], using: list[str], start: Callable[[], object], step: Callable, out: str, kind: str
) -> DataFrame:
    """The rows with a further column ``out``, what ``step`` returns for the state and the row's ``using`` values.

    ``start`` makes the state of a key; ``step`` may change it. ``kind`` is int, long, double, string or boolean. Rows with
    equal ``order`` come in any order, so it should be a whole one; null keys are a key of their own.
    """
    names = rows.columns

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            values = []
            whose = zip(*(batch.column(k).to_pylist() for k in keys))
            for own, row in zip(whose, zip(*(batch.column(c).to_pylist() for c in using))):
                if held is None or own != held:
                    held, state = own, start()
                values.append(step(state, *row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, _KINDS[kind][1])], [*names, out])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(stream, T.StructType([*rows.schema.fields, T.StructField(out, _KINDS[kind][0])]))
