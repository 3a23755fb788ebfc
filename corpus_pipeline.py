"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as Parquet in the
shared folder and reads it again as the next one's input. All stages but the last return the columns of documents, whatever
others there are and whatever their names; the last one returns its own. Stages read ``doc_id``, ``text`` and, if it is there,
``n_chars``. An empty table stays empty. Long texts are read whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from loomspan.llm.common import table
from loomspan.plans.shared import materialize


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text that is left."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The model learns from the labels outside the held-out fold. Null and empty texts have no
    evidence and stay, as do rows without an id that score less; equal texts are judged alike, so repeated rows share their fate."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; documents of which nothing is left go too. Null and empty texts and rows without an id
    stay as they are. Of equal windows the one of the smallest (id, line) stays; rows of one id count as one document."""
    return _recounted(line_dedup.dedup(docs, counts=None, drop_emptied=True))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays: five-word shingles, similarity 0.8. Null and empty texts and rows without an
    id are in no group and stay; rows that repeat an id stay or go together."""
    return near_dedup.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go; documents that are half or more such passages go whole. Null and empty texts stay as they are; rows
    are judged each, repeated ids and missing ones too; of items of equal text each counts."""
    return _recounted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its sequence and its place in it. Null and empty texts are the end id alone; every row is packed, repeated
    and missing ids too; ties go by hash, id and piece."""
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", cut_benchmark),
    ("packing", pack_sequences),
]

#: Learnt weights, min-hashes and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
