"""Parquet files whose schemas have drifted, rewritten to one evolved schema.

Columns are known by their field ids: a file's names, order and types may be any. The plan of a file is a list of the evolved columns, each
with the place in the file of the column of that id, or with the value that fills it. A task streams through the row groups of one
file at a time: batches of bounded rows are cast and filled by the plan, appended to the new file and fed to running digests, so its
memory doesn't grow with the file. Spark deals the files to tasks; what a task returns is one row a file.

Files are written under a name of their own outside the folder and moved into it when they are complete, so a task that is lost or runs
twice leaves either no file or the whole one; drifted files are only removed once all the new ones stand.
"""

from __future__ import annotations

import hashlib
import math
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import bounded_batches, named, table
from loomspan.plans.shared import _hadoop_path, materialize, release, shared_root

#: Rows held at a time by a task that writes or rewrites a file, and by a row group that it writes.
BATCH_ROWS = 16_384
_ID = b"PARQUET:field_id"


def evolved(columns: list[tuple[str, pa.DataType]]) -> pa.Schema:
    """Nullable columns with field ids from 1."""
    return pa.schema([pa.field(n, t, metadata={_ID: str(k).encode()}) for k, (n, t) in enumerate(columns, 1)])


CLIENTS = evolved([("client_id", pa.int64()), ("master_id", pa.int64()), ("source", pa.string()), ("updated_at", pa.timestamp("us")), ("name", pa.string()), ("email", pa.string()), ("city", pa.string()), ("nation_id", pa.int64()), ("segment", pa.string()), ("balance", pa.float64())])
#: What fills a column that a file lacks, by field id.
FILLS = {7: "none", 8: -1}


def version_of(file_no: int) -> int:
    v = zlib.crc32(b"7:%d" % file_no) % 24
    return v if v <= 15 else 0


def drift(schema: pa.Schema, version: int) -> tuple[pa.Schema, list[int]]:
    """The schema of a starting file of this version, and of each of its columns the place in ``schema``."""
    fields = list(enumerate(schema))
    if version & 1:  # names alone change places
        renamed = {5: schema.field(5).name, 4: schema.field(4).name}
        fields = [(k, f.with_name(renamed[9 - k]) if k in renamed else f) for k, f in fields]
    if version & 8:
        fields = [(k, f.with_type({9: pa.float32(), 7: pa.int32()}.get(k, f.type))) for k, f in fields]
    if version & 4:
        fields = [(k, f) for k, f in fields if k not in (6, 7)]
    if version & 2:
        fields = fields[:1] + fields[:0:-1]
    return pa.schema([f for _, f in fields]), [k for k, _ in fields]


def _ids(schema: pa.Schema) -> list[int | None]:
    return [int(f.metadata[_ID]) if f.metadata and _ID in f.metadata else None for f in schema]


def column_plan(schema: pa.Schema, target: pa.Schema, fills: dict[int, object]) -> list[tuple[int | None, pa.Field, object]]:
    """For each column of ``target``: the place of the column with its id in ``schema`` (None: it's missing), its field, and what fills it."""
    place = {i: k for k, i in reversed(list(enumerate(_ids(schema)))) if i is not None}
    return [(place.get(i), f, fills.get(i)) for i, f in zip(_ids(target), target, strict=True)]


def conform(batch: pa.RecordBatch, plan: list[tuple[int | None, pa.Field, object]]) -> list[pa.Array]:
    """The batch's columns by the plan. Nulls stay; a missing column is filled, with nulls if nothing else is named."""
    return [pa.repeat(pa.scalar(fill, f.type), batch.num_rows) if k is None else batch.column(k).cast(f.type) for k, f, fill in plan]


def scaled_floor(values: pa.Array, by: int = 1_048_576) -> pa.Array:
    """floor(by * value) as decimal text, exact for any size; NaN and infinities by their names."""
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False) * by
    whole = np.isfinite(x) & (np.abs(x) < 2**62)
    out = pa.array(np.floor(np.where(whole, x, 0)).astype(np.int64)).cast(pa.string()).to_pylist() if not whole.all() else pa.array(np.floor(x).astype(np.int64)).cast(pa.string())
    if not whole.all():
        raw = values.to_pylist()
        out = pa.array([None if v is None else o if w else str(math.floor(v * by)) if math.isfinite(v) and math.isfinite(v * by) else str(v) for o, w, v in zip(out, whole.tolist(), raw, strict=True)], pa.string())
    return pc.if_else(values.is_valid(), out, pa.scalar(None, pa.string()))


def _text(column: pa.Array) -> pa.Array:
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us")).cast(pa.int64())
    return scaled_floor(column) if pa.types.is_floating(column.type) else column.cast(pa.string())


class Digest:
    """Running sums over the batches of a file: rows, null values, and sha256 of the first column and of whole rows."""

    def __init__(self) -> None:
        self.rows = self.nulls = 0
        self.ids, self.lines = hashlib.sha256(), hashlib.sha256()

    def add(self, columns: list[pa.Array]) -> None:
        if not len(columns[0]):
            return
        texts = [pc.fill_null(_text(c), "?") for c in columns]
        for digest, mark, rows in ((self.ids, b",", texts[0]), (self.lines, b"\n", pc.binary_join_element_wise(*texts, "|"))):
            if self.rows:
                digest.update(mark)
            digest.update(mark.join(rows.cast(pa.binary()).to_pylist()))
        self.rows += len(columns[0])
        self.nulls += sum(c.null_count for c in columns)


def _pending(folder: str) -> str:
    """Where files of the folder are written until they are complete."""
    return folder.rstrip("/") + "-pending"


class Folder:
    """A folder that all executors see, by its URI, for files that Spark's own writers don't make."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")

    def at(self, name: str) -> str:
        return posixpath.join(self.path, name)

    def open(self, name: str) -> pq.ParquetFile:
        return pq.ParquetFile(self.fs.open_input_file(self.at(name)), pre_buffer=False)

    def write(self, name: str, schema: pa.Schema) -> Writer:
        return Writer(self, name, schema)


class Writer:
    """One Parquet file, written beside the folder and moved into it on ``close``."""

    def __init__(self, folder: Folder, name: str, schema: pa.Schema):
        self.folder, self.name, self.schema = folder, name, schema
        pending = _pending(folder.path)
        for path in (pending, folder.path):
            folder.fs.create_dir(path, recursive=True)
        self.pending = posixpath.join(pending, f"{name}-{uuid.uuid4().hex}")
        self.sink = folder.fs.open_output_stream(self.pending)
        self.writer = pq.ParquetWriter(self.sink, schema, compression="zstd", store_schema=False)

    def add(self, columns: list[pa.Array]) -> None:
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        self.writer.close()
        self.sink.close()
        self.folder.fs.move(self.pending, self.folder.at(self.name))


def numbered(rows: DataFrame, order: list[Column], files: int) -> tuple[DataFrame, int]:
    """``rows`` with file_no and, within it, place, in ``order`` over the whole table, and the number of files. Ranges of the order are sorted
    in parallel; a range's first rank is the number of rows in ranges before it. A key of any number of rows is split among ranges,
    equal rows by where they were read, which can't be told afterwards. What is gathered is a count a range."""
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    keyed = rows.select("*", *(c.alias(f"__k{i}") for i, c in enumerate(order)), F.monotonically_increasing_id().alias("__read"))
    keys = [F.asc_nulls_first(c) for c in [*(f"__k{i}" for i in range(len(order))), *rows.columns, "__read"]]
    dealt = keyed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = materialize(dealt.select(*rows.columns, F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")), "ranked")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    counts = counts.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("__all"))
    total = counts.agg(F.coalesce(F.max("__all"), F.lit(0))).first()[0]
    size = 1 + total // files
    rank = F.col("__at") + F.col("__before")
    placed = dealt.join(F.broadcast(counts), "__range")  # bound: a row a range
    out = placed.select(*rows.columns, F.floor(rank / size).cast("int").alias("file_no"), (rank % size).alias("place"))
    out._loomspan_path = dealt._loomspan_path
    return out, -(-total // size)


def write_drifted(rows: DataFrame, files: int, folder: str, schema: pa.Schema = CLIENTS) -> DataFrame:
    """Writes ``rows`` (columns of ``schema``, file_no, place) as one file a number, drifted by its version: (file_no, version, name). A task
    streams its files' rows in order, a file after the other."""
    bounded_batches(rows.sparkSession)
    n = len(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, writer, places, where = [], None, None, [], Folder(folder)
        for batch in batches:
            numbers = batch.column(n).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if numbers[a] != now:
                    if writer:
                        writer.close()
                    now = int(numbers[a])
                    start, places = drift(schema, version_of(now))
                    out.append((now, version_of(now), f"start-{now:05d}.parquet"))
                    writer = where.write(out[-1][2], start)
                for first in range(a, b, BATCH_ROWS):
                    part = batch.slice(first, min(b - first, BATCH_ROWS))
                    writer.add([part.column(k).cast(f.type, safe=False) for k, f in zip(places, writer.schema, strict=True)])
        if writer:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))], names=["file_no", "version", "name"])

    tasks = max(1, min(files, max(rows.sparkSession.sparkContext.defaultParallelism, -(-files // 8))))
    dealt = rows.select(*(named(f.name) for f in schema), "file_no", "place").repartitionById(tasks, F.col("file_no") % tasks).sortWithinPartitions("file_no", "place")
    return materialize(dealt.drop("place").mapInArrow(run, "file_no int, version int, name string"), "drifted-files")


REPORT = T.StructType([T.StructField(n, t) for n, t in (("file_no", T.IntegerType()), ("version", T.IntegerType()), ("n_rows", T.LongType()), ("n_nulls", T.LongType()), ("ids_sha256", T.StringType()), ("rows_sha256", T.StringType()), ("start_columns", T.StringType()), ("columns", T.StringType()), ("path", T.StringType()), ("rewritten", T.BooleanType()), ("was", T.StringType()))])


def rewrite_file(folder: Folder, name: str, new_name: str, target: pa.Schema = CLIENTS, fills: dict[int, object] = FILLS) -> tuple[Digest, list[str], list[str], str]:
    """One file streamed to ``new_name`` in the evolved schema, or only read if it has that schema already: its digest, the names of its columns
    before and after, and the name of the file that stands for it."""
    digest = Digest()
    with folder.open(name) as source:
        have = source.schema_arrow
        plan = column_plan(have, target, fills)
        same = [f.name for f in have] == target.names and have.types == target.types and _ids(have) == _ids(target)
        writer = None if same else folder.write(new_name, target)
        for batch in source.iter_batches(batch_size=BATCH_ROWS):
            columns = conform(batch, plan)
            if writer:
                writer.add(columns)
            digest.add(columns)
        if writer:
            writer.close()
    return digest, have.names, target.names, name if same else new_name


def rewrite(files: DataFrame, folder: str, target: pa.Schema = CLIENTS, fills: dict[int, object] = FILLS) -> DataFrame:
    """Rewrites ``files`` (file_no, version, name) in ``folder`` and returns REPORT rows without ``was``, one a final file. When all new files
    stand, the drifted ones go, by tasks as well; either step may run again. Only the report goes through Spark, never rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = Folder(folder)
        for batch in batches:
            for no, version, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d, before, after, final = rewrite_file(where, name, f"part-{no:05d}.parquet", target, fills)
                row = (no, version, d.rows, d.nulls, d.ids.hexdigest(), d.lines.hexdigest(), ",".join(before), ",".join(after), f"{folder}/{final}", final != name, name)
                yield pa.RecordBatch.from_pylist([dict(zip(REPORT.names, row, strict=True))], schema=_REPORT_ARROW)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = Folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if where.fs.get_file_info(where.at(name)).type != pafs.FileType.NotFound:
                    where.fs.delete_file(where.at(name))
            yield batch

    tasks = max(1, min(files.count(), max(files.sparkSession.sparkContext.defaultParallelism, files.rdd.getNumPartitions())))
    report = materialize(files.select("file_no", "version", "name").repartitionById(tasks, F.col("file_no") % tasks).mapInArrow(run, REPORT), "rewritten-files")
    release(files)
    report.where("rewritten").select("was").mapInArrow(remove, "was string").write.format("noop").mode("overwrite").save()
    return report.drop("was")


_REPORT_ARROW = pa.schema([(f.name, {"integer": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}.get(f.dataType.typeName(), pa.string())) for f in REPORT])


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one call, which stays."""
    return f"{shared_root(spark)}/loomspan-{name}-{uuid.uuid4().hex}"


def drift_and_rewrite(clients: DataFrame, folder: str, files: int = 1000) -> DataFrame:
    """Deals the rows of ``clients``, by crc32 of the id and the id, to at most ``files`` drifted files, about as long each, and rewrites these.
    Null ids come first; rows of one id go by their other columns, nulls first, and equal rows can't be told apart. Columns that the
    evolved schema doesn't name are left out; nulls stay null; texts of any length are kept whole, whatever characters they hold. An
    empty table makes no file and no row. NaN and infinite balances are digested by name."""
    spark = clients.sparkSession
    kinds = {pa.int64(): "long", pa.string(): "string", pa.timestamp("us"): "timestamp_ntz", pa.float64(): "double"}
    rows = clients.select(*(named(f.name).cast(kinds[f.type]).alias(f.name) for f in CLIENTS))
    crc = F.crc32(F.col("client_id").cast("string").cast("binary"))
    placed, n = numbered(rows, [crc, F.col("client_id")], files)
    drifted = write_drifted(placed, n, folder)
    release(placed)
    report = rewrite(drifted, folder)
    pending, fs = _hadoop_path(spark, _pending(folder))
    fs.delete(pending, True)  # what lost tasks left
    return report


def op11_schema_rewrite(spark, sf_dir: str) -> DataFrame:
    """A row for each final file of ``clients``, in a new folder under spark.checkpoint.dir."""
    return drift_and_rewrite(table(spark, sf_dir, "clients"), new_folder(spark, "schema-rewrite"))
