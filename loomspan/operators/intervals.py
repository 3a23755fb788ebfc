"""Joins of two tables of half-open intervals by overlap, as equi-joins on bins.

Bins have levels, each ``STEP`` times as wide as the one below, the narrowest as wide as the data's short intervals are. An interval is at home on
the level whose bins are as long as itself at least, so it touches two of them at most, however long it is; on every wider level
that the other table has homes on it is a guest. Two intervals meet on the wider of their two homes, in the bin in which their overlap begins, so
a pair is found once, and short intervals don't meet each other in the wide bins that long ones need.

Bins with many rows on both sides are split into blocks that meet each other, so no task gets a whole hot bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 8
#: Rows of a bin on one side that one task takes at least.
BLOCK = 10_000
_OWN = ("__lo", "__hi")


def _level(length: Column, width: float) -> Column:
    """The lowest level with bins of this length at least."""
    wide = F.greatest(F.ceil(F.log(float(STEP), F.greatest(length / width, F.lit(1.0)))), F.lit(0)).cast("int")
    return F.when(_width(wide, width) < length, wide + 1).otherwise(wide)  # the logarithm may round


def _width(level: Column, width: float) -> Column:
    return F.round(F.pow(F.lit(float(STEP)), level)) * width


def _measured(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """All columns in one, with the interval as doubles; empty intervals and those with a missing end overlap nothing."""
    return df.select(F.struct("*").alias(name), F.col(start).cast("double").alias("__lo"), F.col(end).cast("double").alias("__hi")).where("__lo < __hi")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], start: str = "char_start", end: str = "char_end", block: int = BLOCK) -> DataFrame:
    """(left, right): structs of the rows of both tables that have equal ``keys`` and overlap. Both have ``keys``, ``start`` and ``end``, numbers
    up to 2**53; null keys meet nothing; repeated rows give repeated pairs."""
    a, b = _measured(left, start, end, "left"), _measured(right, start, end, "right")
    short = a.select(F.col("__hi") - F.col("__lo")).union(b.select(F.col("__hi") - F.col("__lo"))).toDF("n").agg(F.percentile_approx("n", 0.5, 1000)).first()[0]
    width = max(float(short or 1.0), 1.0)
    homes = lambda df: sorted(r[0] for r in df.select(_level(F.col("__hi") - F.col("__lo"), width)).distinct().collect())  # noqa: E731  bound: one a level
    levels = {"left": homes(a), "right": homes(b)}

    def binned(df: DataFrame, name: str, other: str) -> DataFrame:
        """A row for each bin that an interval touches on its home and on each wider level that the other table needs."""
        own = _level(F.col("__hi") - F.col("__lo"), width)
        visited = F.array_distinct(F.concat(F.array("__home"), F.filter(F.array(*map(F.lit, levels[other])).cast("array<int>"), lambda x: x > F.col("__home"))))
        rows = df.withColumn("__home", own).withColumn("__level", F.explode(visited)).withColumn("__w", _width(F.col("__level"), width))
        last = F.ceil(F.col("__hi") / F.col("__w")) - 1
        rows = rows.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__lo") / F.col("__w")), F.greatest(last, F.floor(F.col("__lo") / F.col("__w"))))))
        return rows.select(*(F.col(f"{name}.{k}").alias(f"__k{i}") for i, k in enumerate(keys)), "__level", "__bin", (F.col("__level") == F.col("__home")).alias(f"__home_{name}"), F.col("__lo").alias(f"__lo_{name}"), F.col("__hi").alias(f"__hi_{name}"), "__w", name)

    return _met(binned(a, "left", "right"), binned(b, "right", "left"), [*(f"__k{i}" for i in range(len(keys))), "__level", "__bin"], block)


def _met(a: DataFrame, b: DataFrame, place: list[str], block: int) -> DataFrame:
    # Where both sides are at home or one is: guests don't meet guests.
    blocks = lambda df, n: df.groupBy(*place).agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    hot = blocks(a, "__m").join(blocks(b, "__n"), place).where((F.col("__m") > 1) | (F.col("__n") > 1))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    dealt = lambda name, n: F.pmod(F.xxhash64(f"__lo_{name}", f"__hi_{name}", name), F.coalesce(F.col(n), F.lit(1))).cast("int")
    a = a.join(hot, place, "left").withColumn("__i", dealt("left", "__m")).withColumn("__j", every("__n")).drop("__m", "__n")
    b = b.drop("__w").join(hot.toDF(*place, "__m", "__n"), place, "left").withColumn("__j", dealt("right", "__n")).withColumn("__i", every("__m")).drop("__m", "__n")
    once = F.floor(F.greatest("__lo_left", "__lo_right") / F.col("__w")) == F.col("__bin")
    meet = (F.col("__lo_left") < F.col("__hi_right")) & (F.col("__lo_right") < F.col("__hi_left"))
    return a.join(b, [*place, "__i", "__j"]).where((F.col("__home_left") | F.col("__home_right")) & once & meet).select("left", "right")
