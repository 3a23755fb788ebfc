"""Groups that are gone through as rows stream by, at no cost of their own; a frame a group costs more than the rows of a small one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomspan.plans.shared import bounded_batches

#: Rows and characters or bytes in one batch of results.
MOST_ROWS, MOST_SIZE = 10_000, 4_000_000


def streamed(rows: DataFrame, key: str, order: list[str], one: Callable[[Iterator[tuple]], tuple | None], fields: list[T.StructField]) -> DataFrame:
    """(key, fields): what ``one`` makes of each group's rows, other columns in their order, given one by one in ascending ``order``. Rows are
    exchanged by key and sorted; None gives no row."""
    bounded_batches(rows.sparkSession)
    rows = rows.select(key, *(c for c in rows.columns if c != key))
    shape = T.StructType([T.StructField(key, rows.schema[key].dataType), *fields])
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out, size = [], 0
        for value, group in groupby(every, itemgetter(0)):
            made = one(row[1:] for row in group)
            if made is None:
                continue
            out.append((value, *made))
            size += sum(len(x) for x in made if isinstance(x, (str, bytes)))
            if len(out) >= MOST_ROWS or size >= MOST_SIZE:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, shape)
