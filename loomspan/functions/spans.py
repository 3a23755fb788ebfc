"""Matches of a regular expression with their places. Spark's own functions give the strings but not where they are."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<start, end, g1..gn>> of all matches, places from 0 in code points and half-open; a group that took no part is
    null. ``pattern`` is a Python expression. One scan of each text, in Arrow batches; lists are built in linear time."""
    names = [f"g{k}" for k in range(1, groups + 1)]
    shape = "array<struct<start:int,end:int" + "".join(f",{n}:string" for n in names) + ">>"

    def found(texts: pa.Array) -> pa.Array:
        known = re.compile(pattern)
        offsets, rows = [0], []
        for t in texts.to_pylist():
            rows += known.finditer(t or "")
            offsets.append(len(rows))
        columns = [pa.array([m.start() for m in rows], pa.int32()), pa.array([m.end() for m in rows], pa.int32()), *[pa.array([m[k] for m in rows], pa.string()) for k in range(1, groups + 1)]]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "end", *names]))

    return F.arrow_udf(found, shape)(text)
