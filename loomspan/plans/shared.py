"""Tables shared between stages: written once to the folder that every executor sees."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes in one Arrow batch, whatever the length of the texts; a text of more is a batch of its own.
ARROW_BYTES = "4m"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local master, which is one machine, may leave it unset: then a temporary folder serves."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Python worker holds at a time. One value for all operators, so a plan that runs later has the same bound;
    a bound that the session has already stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries within go as soon as their query has ended; afterwards the setting is what it was."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost
    executor costs nothing that was finished. The files go when the driver's JVM ends, or by ``release``."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/loomspan/{name}-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomspan_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_loomspan_path", None)
        if path:
            p, fs = _hadoop_path(df.sparkSession, path)
            fs.delete(p, True)
