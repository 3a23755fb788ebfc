"""Keyed tables that are changed in place of being rewritten, by any number of writers.

A change adds a segment: the new rows, in folders by a hash bucket of their key, and the list of keys whose earlier rows no longer count.
Segments are never altered. The log holds one small file a version that names the segments in order; a writer adds the next number,
which only one can: who comes second adds its segment to the log it then finds, without writing any row again. A reader takes one
version of the log, so it sees a change whole or not at all. Rows that a later segment's list names are dropped by one join on read;
``compact`` merges buckets that have many segments, and only these, and ``vacuum`` deletes what no kept version names.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.plans.shared import _hadoop_path

BUCKETS = 16
#: Segments that a bucket has before ``compact`` merges it.
MANY = 8
BUCKET, SEGMENT = "__bucket", "__segment"


class Outrun(RuntimeError):
    """Other writers were faster at every attempt."""


@dataclass
class Segment:
    """A folder with rows and a list of keys, and in which buckets they count."""

    path: str
    rows: list[int] = field(default_factory=list)
    gone: list[int] = field(default_factory=list)

    def without(self, buckets: set[int]) -> Segment:
        return Segment(self.path, [b for b in self.rows if b not in buckets], [b for b in self.gone if b not in buckets])


@dataclass
class Snapshot:
    version: int
    keys: list[str]
    buckets: int
    schema: T.StructType | None
    segments: list[Segment]


class KeyedTable:
    """Rows by ``keys``, of which any number may share a key; a change replaces all rows of the keys that it names. Null keys are keys. The log
    knows the keys and the number of buckets, so they are only needed for the first change."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys or [], buckets

    # -------------------------------------------------------------- log

    def _names(self, folder: str) -> list[str]:
        path, fs = _hadoop_path(self.spark, f"{self.root}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("log") if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or the one named; without any the empty version 0."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return Snapshot(0, self.keys, self.buckets, None, [])
        path, fs = _hadoop_path(self.spark, self._log(version))
        stream = fs.open(path)
        try:
            found = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Snapshot(version, found["keys"], found["buckets"], T.StructType.fromJson(found["schema"]), [Segment(**s) for s in found["segments"]])

    def _log(self, version: int) -> str:
        return f"{self.root}/log/{version:012d}.json"

    def _commit(self, now: Snapshot) -> bool:
        """True if this version is ours: its file appears whole, under a name that nobody else has taken."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        pending, fs = _hadoop_path(self.spark, f"{self.root}/log/.pending-{uuid.uuid4().hex}")
        stream = fs.create(pending, True)
        stream.write(bytearray(json.dumps({"keys": now.keys, "buckets": now.buckets, "schema": now.schema.jsonValue(), "segments": [vars(s) for s in now.segments]}).encode()))
        stream.close()
        path, _ = _hadoop_path(self.spark, self._log(now.version))
        try:
            if fs.getScheme() == "file":  # a link fails if the name is taken, where a local rename would replace
                java = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(java(path), java(pending))
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(pending.toUri(), conf).rename(pending, path, none)
            return True
        except Exception as e:
            if fs.exists(path) and "Exist" in str(e):
                return False
            raise
        finally:
            fs.delete(pending, False)

    # -------------------------------------------------------------- segments

    def _bucket(self, now: Snapshot) -> Column:
        return F.pmod(F.xxhash64(*now.keys), F.lit(now.buckets)).cast("int")

    def _put(self, df: DataFrame, path: str) -> list[int]:
        """Writes by bucket, a task some buckets, large ones split; the buckets that have any."""
        df.hint("rebalance", BUCKET).write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.root}/{path}")
        return sorted(int(n.split("=")[1]) for n in self._names(path) if n.startswith(f"{BUCKET}="))

    def _shaped(self, df: DataFrame, now: Snapshot) -> DataFrame:
        """Rows with the table's columns and types; the first change defines them."""
        return df if now.schema is None else df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in now.schema.fields))

    def _segment(self, rows: DataFrame | None, gone: DataFrame | None, now: Snapshot, replace: bool) -> Segment:
        out = Segment(f"data/{uuid.uuid4().hex}")
        keys = None
        if rows is not None:
            out.rows = self._put(rows.withColumn(BUCKET, self._bucket(now)), f"{out.path}/rows")
            if replace:  # as they were written, so that what makes them runs once
                keys = self._part(out.path, "rows", rows.schema).select(*now.keys, BUCKET)
        if gone is not None:
            kinds = (now.schema or rows.schema if rows is not None else now.schema) or gone.schema
            other = gone.select(*(F.col(k).cast(kinds[k].dataType).alias(k) for k in now.keys)).withColumn(BUCKET, self._bucket(now))
            keys = other if keys is None else keys.unionByName(other)
        if keys is not None:
            out.gone = self._put(keys.distinct(), f"{out.path}/gone")
        return out

    def _part(self, path: str, part: str, schema: T.StructType) -> DataFrame:
        shape = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(shape).parquet(f"{self.root}/{path}/{part}")

    # -------------------------------------------------------------- changes

    def append(self, rows: DataFrame) -> int:
        """Adds ``rows`` to those that their keys have."""
        return self.upsert(rows, replace=False)

    def upsert(self, rows: DataFrame | None, gone: DataFrame | None = None, attempts: int = 20, replace: bool = True) -> int:
        """``rows`` stand for all rows of their keys, and rows of the keys of ``gone`` go; the new version. A change that breaks off leaves the
        table as it was."""
        now = self.snapshot()
        rows = None if rows is None else self._shaped(rows, now)
        segment = self._segment(rows, gone, now, replace)
        for _ in range(attempts):
            schema = now.schema if now.schema is not None else rows.schema if rows is not None else None
            if schema is None or not (segment.rows or segment.gone):
                return now.version if now.schema is not None or rows is None else self._settled(now, schema, attempts)
            if self._commit(Snapshot(now.version + 1, now.keys, now.buckets, schema, [*now.segments, segment])):
                return now.version + 1
            now = self.snapshot()
        raise Outrun(self.root)

    def _settled(self, now: Snapshot, schema: T.StructType, attempts: int) -> int:
        """An empty first change defines the columns."""
        return now.version + 1 if self._commit(Snapshot(now.version + 1, now.keys, now.buckets, schema, [])) else self.snapshot().version

    def compact(self, many: int = MANY) -> list[int]:
        """Merges the rows of buckets that more than ``many`` segments name into one segment; these buckets. What other writers add meanwhile
        stays behind it; if one of them has merged too, nothing is done."""
        now = self.snapshot()
        named = [b for s in now.segments for b in {*s.rows, *s.gone}]
        touched = {b for b in named if named.count(b) > many}
        if not touched:
            return []
        merged = Segment(f"data/{uuid.uuid4().hex}")
        merged.rows = self._put(self._live(now, touched), f"{merged.path}/rows")
        for _ in range(20):
            last = self.snapshot()
            if last.segments[: len(now.segments)] != now.segments:
                return []
            kept = [s for s in (x.without(touched) for x in now.segments) if s.rows or s.gone]
            if self._commit(Snapshot(last.version + 1, last.keys, last.buckets, last.schema, [*kept, merged, *last.segments[len(now.segments) :]])):
                return sorted(touched)
        return []

    def vacuum(self, keep: int = 2, age_s: float = 86_400) -> int:
        """Deletes versions but the last ``keep`` and the segments that these don't name, if they are older than ``age_s``: younger ones may
        belong to a writer that hasn't finished. How many segments went."""
        known = self.versions()
        for v in known[:-keep]:
            path, fs = _hadoop_path(self.spark, self._log(v))
            fs.delete(path, False)
        named = {s.path for v in known[-keep:] for s in self.snapshot(v).segments}
        n = 0
        for name in self._names("data"):
            path, fs = _hadoop_path(self.spark, f"{self.root}/data/{name}")
            if f"data/{name}" not in named and fs.getFileStatus(path).getModificationTime() / 1000 <= time.time() - age_s:
                fs.delete(path, True)
                n += 1
        return n

    # -------------------------------------------------------------- reading

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the newest; None for a table that no change has defined."""
        now = self.snapshot(version)
        return None if now.schema is None else self._live(now).drop(BUCKET)

    def _live(self, now: Snapshot, buckets: set[int] | None = None) -> DataFrame:
        own = lambda some: [b for b in some if buckets is None or b in buckets]
        parts = [self._part(s.path, "rows", now.schema).where(F.col(BUCKET).isin(b)).withColumn(SEGMENT, F.lit(i)) for i, s in enumerate(now.segments) if (b := own(s.rows))]
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*now.schema.fields, T.StructField(BUCKET, T.IntegerType())]))
        rows = reduce(DataFrame.unionByName, parts)
        keys = T.StructType([now.schema[k] for k in now.keys])
        first = min(i for i, s in enumerate(now.segments) if own(s.rows))
        # a segment's own list is of earlier rows, so only lists behind the first rows matter
        lists = [self._part(s.path, "gone", keys).where(F.col(BUCKET).isin(b)).withColumn("__last", F.lit(i)) for i, s in enumerate(now.segments) if i > first and (b := own(s.gone))]
        if not lists:
            return rows.drop(SEGMENT)
        last = reduce(DataFrame.unionByName, lists).groupBy(BUCKET, *now.keys).agg(F.max("__last").alias("__last"))
        last = last.select(F.col(BUCKET).alias("__b"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(now.keys)), "__last")
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(now.keys)), F.col(BUCKET) == F.col("__b"))
        live = rows.join(last, same, "left").where(F.col("__last").isNull() | (F.col(SEGMENT) >= F.col("__last")))
        return live.select(*now.schema.names, BUCKET)
