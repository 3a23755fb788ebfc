"""A feed of questions: each micro-batch is answered as a set and appended, and kept answers serve the next batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "question_id long, doc_id long, slot int, question string, asked_at timestamp"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of questions as they arrive, each question id once within an hour."""
    return spark.readStream.schema(QUESTION).json(path).withWatermark("asked_at", "1 hour").dropDuplicatesWithinWatermark(["question_id"])


def answered(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Starts the query. A batch that is run again after a failure overwrites its own folder, so no answer is doubled."""

    def each(batch: DataFrame, number: int) -> None:
        answer(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def asked_by_hour(stream: DataFrame) -> DataFrame:
    """(window, doc_id, n): questions an hour, late ones up to the watermark."""
    return stream.groupBy(F.window("asked_at", "1 hour"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
