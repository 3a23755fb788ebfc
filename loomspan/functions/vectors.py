"""Vectors as arrays of numbers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for empty vectors, different lengths and zero norms. Norms that are known are not computed again."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def hashed_words(text: Column, size: int = 64, length_one: bool = False) -> Column:
    """Deterministic stand-in for an embedding service: counts of words by the first four hex digits of their MD5,
    scaled to length one if asked (a zero vector stays zero). An Arrow UDF:
    as built-in expressions each of the counts would hash all words again."""

    def counts(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def one(t: str | None) -> list[float]:
            out = [0.0] * size
            for w in (t or "").split(" "):
                if w:
                    k = known.get(w)
                    if k is None:
                        k = known[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % size
                    out[k] += 1.0
            n = sum(x * x for x in out) ** 0.5 if length_one else 0.0
            return [x / n for x in out] if n else out

        return texts.map(one)

    return F.pandas_udf(counts, ArrayType(DoubleType()))(F.lower(text))


def unit(v: Column) -> Column:
    """Length one; a zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)
