"""Running values over an order, and as-of joins, for keys of any number of rows.

A window by key brings all rows of a key to one task. Here the order over keys and rows is cut into ranges of about equal size; each range
is scanned by itself, and what a key carries from the ranges before is read off a summary: a row for each range and key that
stretches over more than one, which are two a range at most. So one key may hold every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.plans.shared import materialize

RANGE, READ = "__range", "__read"


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """``rows`` with, for each name of ``sums``, the total of its values over the rows of the same ``keys`` up to this one in ascending
    ``order``, nulls first and counting nothing, and for each name of ``lasts`` the latest value that isn't null. Rows equal in keys and
    order follow each other as they were read. Null keys are keys. The rows are written once, in ranges."""
    sums, lasts = sums or {}, lasts or {}
    spark, columns = rows.sparkSession, rows.columns
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    values = rows.select("*", *(c.alias(f"__s_{k}") for k, c in sums.items()), *(F.when(c.isNotNull(), F.struct(c.alias("v"))).alias(f"__l_{k}") for k, c in lasts.items()), F.monotonically_increasing_id().alias(READ))
    sort = [F.asc_nulls_first(F.col(c)) for c in [*keys, *order, READ]]
    cut = materialize(values.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn(RANGE, F.spark_partition_id()), "ranges")
    place = F.struct(*order, READ)
    parts = cut.groupBy(RANGE, *keys).agg(*(F.coalesce(F.sum(f"__s_{k}"), F.lit(0)).alias(f"__s_{k}") for k in sums), *(F.max_by(f"__l_{k}", F.when(F.col(f"__l_{k}").isNotNull(), place)).alias(f"__l_{k}") for k in lasts))
    wide = parts.groupBy(*keys).agg(F.min(RANGE).alias("__a"), F.max(RANGE).alias("__b")).where("__a < __b").select(*(F.col(k).alias(f"__w{i}") for i, k in enumerate(keys)))
    same = lambda name: reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{name}{i}")) for i, k in enumerate(keys)), F.lit(True))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.join(F.broadcast(wide), same("__w"), "left_semi")  # bound: fewer keys than ranges
    carried = carried.select(F.col(RANGE).alias("__r"), *(F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)), *(F.sum(f"__s_{k}").over(before).alias(f"__cs_{k}") for k in sums), *(F.last(f"__l_{k}", ignorenulls=True).over(before).alias(f"__cl_{k}") for k in lasts))
    here = Window.partitionBy(RANGE, *keys).orderBy(*(F.asc_nulls_first(F.col(c)) for c in [*order, READ])).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *(F.coalesce(F.sum(f"__s_{k}").over(here), F.lit(0)).alias(f"__hs_{k}") for k in sums), *(F.last(f"__l_{k}", ignorenulls=True).over(here).alias(f"__hl_{k}") for k in lasts))
    whole = local.join(F.broadcast(carried), (F.col(RANGE) == F.col("__r")) & same("__c"), "left")  # bound: two rows a range
    return whole.select(*columns, *((F.col(f"__hs_{k}") + F.coalesce(f"__cs_{k}", F.lit(0))).alias(k) for k in sums), *(F.coalesce(f"__hl_{k}", f"__cl_{k}")["v"].alias(k) for k in lasts))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], ties: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` of the same ``keys`` whose time isn't after its own; of rows of one time the
    last by ``ties``. Without such a row, and for a null key or time, they are null. Every row of ``left`` is returned once."""
    ties = ties or []
    known = reduce(Column.__and__, (F.col(k).isNotNull() for k in [*keys, right_time]))
    of = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    none = lambda df, names: [F.lit(None).cast(df.schema[c].dataType) for c in names]
    events = right.where(known).select(*of, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(ties)), F.struct(*values).alias("__value"))
    asked = left.select(*of, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), *(c.alias(f"__o{i}") for i, c in enumerate(none(right, ties))), F.lit(None).cast(events.schema["__value"].dataType).alias("__value"), F.struct("*").alias("__left"))
    both = events.withColumn("__left", F.lit(None).cast(asked.schema["__left"].dataType)).unionByName(asked)
    names = [f"__k{i}" for i in range(len(keys))]
    found = running(both, names, ["__t", "__side", *(f"__o{i}" for i in range(len(ties)))], lasts={"__found": F.col("__value")}, ranges=ranges).where("__side = 1")
    return found.select("__left.*", *(F.when(F.col("__t").isNotNull(), F.col(f"__found.{v}")).alias(v) for v in values))
