"""Stored entities under one folder: whole tables in versions, and tables changed by key, as far as the sources' fingerprints change."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.text import normalize_question
from loomspan.plans.shared import _hadoop_path, materialize
from loomspan.sources.tables import KeyedTable

DESCRIPTION = T.StructType([T.StructField(n, T.StringType()) for n in ("subject", "axes_or_layout", "takeaway")] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("key_visual_elements", "numbers_visible")])
#: An answered question as it is kept; ``plan`` is JSON.
ENTRY = "doc_id long, question string, question_norm string, question_embedding array<double>, answer string, doc_ids array<string>, plan string, ts double, source string"
MANIFEST = "doc_id long, fingerprint string, n_files long, version int, ts double"


class Store:
    """Entities by name. A write makes a new version beside the old one; the name then points to it by one rename, so a reader sees the
    old table or the new one, and a write that breaks off leaves the old one as it was."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, name: str):
        return _hadoop_path(self.spark, f"{self.root}/{name}/_current")

    def version(self, name: str) -> str | None:
        """The folder that the name points to; None for what isn't stored, or is changed by key."""
        path, fs = self._pointer(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _point(self, name: str, version: str) -> None:
        jvm = self.spark.sparkContext._jvm
        fresh, fs = _hadoop_path(self.spark, f"{self.root}/{name}/_current-{uuid.uuid4().hex}")
        stream = fs.create(fresh, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        path, _ = self._pointer(name)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, path, options)

    def keyed(self, name: str, keys: list[str] | None = None) -> KeyedTable:
        """The entity as a table that is changed by key; ``keys`` are those of a table that doesn't exist yet."""
        return KeyedTable(self.spark, f"{self.root}/{name}", keys)

    def has(self, name: str) -> bool:
        return self.version(name) is not None or bool(self.keyed(name).versions())

    def non_empty(self, name: str) -> bool:
        """Whether the entity is stored and has a row."""
        df = self.load(name)
        return df is not None and not df.isEmpty()

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """The stored table. ``df`` may be read from the version that it replaces."""
        before, version = self.version(name), f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        self.publish(name, version, before)
        return self.load(name)

    def publish(self, name: str, version: str, before: str | None) -> None:
        """Lets the name point to a version that is complete; what it pointed to before goes."""
        self._point(name, version)
        for old in ("log", "data", *([before] if before else [])):  # of a table that was changed by key, or of the version before
            path, fs = _hadoop_path(self.spark, f"{self.root}/{name}/{old}")
            fs.delete(path, True)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Rows added to the current version by Spark's commit protocol; the first ones make it."""
        version = self.version(name)
        if version is None:
            if not self.has(name):
                return self.save(name, df)
            self.keyed(name).append(df)
            return self.load(name)
        df.write.mode("append").parquet(f"{self.root}/{name}/{version}")
        return self.load(name)

    def load(self, name: str) -> DataFrame | None:
        """None for what isn't stored."""
        version = self.version(name)
        return self.keyed(name).read() if version is None else self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def upsert(self, name: str, df: DataFrame, key: list[str]) -> DataFrame:
        """New rows replace stored ones of the same key; of rows that share one, any. A table that was saved whole is changed by key from now on."""
        table, version = self.keyed(name, key), self.version(name)
        if version is not None:
            table.upsert(self.load(name))
        table.upsert(df.dropDuplicates(key))
        if version is not None:
            for old in ("_current", version):
                path, fs = _hadoop_path(self.spark, f"{self.root}/{name}/{old}")
                fs.delete(path, True)
        return self.load(name)

    def changes(self, fingerprints: DataFrame, names: list[str], version: int, key: str = "doc_id") -> DataFrame:
        """(key, change) of every document that is there or in the manifest. Unless all entities are stored, every document is new; a manifest of
        another version, one that can't be read, and one with other columns count as none."""
        old = None
        try:
            if all(self.has(n) for n in names) and (old := self.load("manifest")) is not None:
                old = materialize(old.where(F.col("version") == version).select(key, "fingerprint"), "manifest")
        except Exception:
            old = None
        return compared(fingerprints, old, key)

    def fresh(self, fingerprints: DataFrame, names: list[str], version: int, key: str = "doc_id") -> bool:
        """True if nothing has changed."""
        return self.changes(fingerprints, names, version, key).where("change <> 'same'").isEmpty()


def compared(now: DataFrame, old: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """(key, change): new, changed, same or deleted, by the fingerprints that two manifests (key, fingerprint) have."""
    now = now.select(key, F.col("fingerprint").alias("__now"))
    if old is None:
        return now.select(key, F.lit("new").alias("change"))
    both = now.join(old.select(key, F.col("fingerprint").alias("__old")), key, "full_outer")
    change = F.when(F.col("__old").isNull(), "new").when(F.col("__now").isNull(), "deleted").when(F.col("__old") == F.col("__now"), "same").otherwise("changed")
    return both.select(key, change.alias("change"))


def entries_of(answered: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows to keep from (doc_id, question, embedding, answer, doc_ids, plan)."""
    return answered.select("doc_id", "question", normalize_question(F.col("question")).alias("question_norm"), F.col("embedding").cast("array<double>").alias("question_embedding"), "answer", "doc_ids", "plan", (F.unix_micros(F.current_timestamp()) / 1e6 if now is None else now).alias("ts"), F.lit("fresh").alias("source"))


def read_entries(spark: SparkSession, path: str, doc_id: int = 0) -> DataFrame:
    """Kept answers from JSON lines, as far as they have the required fields; ``plan`` may be an object, and lines that name no document
    belong to ``doc_id``."""
    rows = spark.read.text(path).select(F.from_json("value", ENTRY).alias("e"), F.get_json_object("value", "$.plan").alias("p"))
    return usable(rows.select("e.*", "p").withColumns({"plan": F.coalesce("p", "plan"), "doc_id": F.coalesce("doc_id", F.lit(doc_id))}).drop("p"))


def usable(entries: DataFrame) -> DataFrame:
    """Rows with the required fields, others defaulted."""
    return entries.where("question is not null and question_norm is not null and answer is not null").withColumns({"question_embedding": F.coalesce("question_embedding", F.array().cast("array<double>")), "ts": F.coalesce("ts", F.lit(0.0)), "source": F.coalesce("source", F.lit("fresh")), "doc_ids": F.coalesce("doc_ids", F.array().cast("array<string>")), "plan": F.coalesce("plan", F.lit("{}"))})


def numbered(entries: DataFrame) -> DataFrame:
    """Kept answers as the cache asks them: (entry_id, doc_id, question, embedding, answer), ids in order of time."""
    rows = usable(entries)
    return rows.select(F.struct("ts", "question_norm", F.xxhash64("answer").alias("h")).alias("entry_id"), "doc_id", "question", F.col("question_embedding").alias("embedding"), "answer")


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    """One text a row, into one file each partition."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def log_run(spark: SparkSession, path: str, timings: dict[str, float]) -> None:
    spark.createDataFrame([(json.dumps(timings, sort_keys=True),)], "value string").write.mode("append").text(path)
