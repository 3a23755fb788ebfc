"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomspan.plans.shared import bounded_batches as bounded_batches


def named(column: str) -> Column:
    """The column of just this name, dots and back-ticks in it included."""
    return F.col("`" + column.replace("`", "``") + "`")


#: Numbers in a table that is broadcast at most: some 16 MB. The optimizer would go by the size of its files, and they are compressed.
BROADCAST_NUMBERS = 1_000_000


def small_side(df: DataFrame, numbers: Column) -> DataFrame:
    """``df`` as the small side of a join: broadcast if its rows hold ``BROADCAST_NUMBERS`` numbers at most; else to be merged with the
    other side by an exchange."""
    total = df.agg(F.coalesce(F.sum(numbers), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_NUMBERS else df.hint("merge")


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs.mapInArrow`` with the same columns, by place: their names may be any."""
    plain = [f"c{k}" for k in range(len(docs.columns))]
    shape = StructType([StructField(n, f.dataType) for n, f in zip(plain, docs.schema.fields, strict=True)])
    return docs.toDF(*plain).mapInArrow(run, shape).toDF(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def fold(id_col: str, modulus: int, held: int) -> Column:
    """True for rows of the held-out fold. A null id is in no fold: it isn't held out, and never learnt from."""
    return F.coalesce(crc_of_id(id_col) % modulus == held, F.lit(False))


def hash_order(id_col: str) -> list[Column]:
    """A fixed pseudo-random order of ids, for bounded samples that don't depend on partitioning."""
    return [F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)]


#: Share by which a sample by hash may exceed what was asked for before it is cut again.
SLACK = 1.1


def share(hashed: Column, most: int, of: int) -> Column:
    """True for about ``most`` of ``of`` rows, by a 64-bit hash of theirs."""
    return F.lit(True) if of <= most else hashed < F.lit(int(-(2**63) + 2**64 * most / of))
