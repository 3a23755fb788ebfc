"""Answers kept from earlier questions: exact by normalised text, else the most similar question beyond a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import vectors as V
from loomspan.functions.text import normalize_question
from loomspan.operators.retrieval import top_k

THRESHOLD = 0.92


def exact(questions: DataFrame, entries: DataFrame, by: str | None = None) -> DataFrame:
    """(question_id, entry_id): the first entry of the same normalised question, of all entries or of those of the question's own document,
    the column ``by``. ``entries`` (entry_id, question); ids are in order."""
    keys = [by] if by else []
    firsts = entries.groupBy(*keys, normalize_question(F.col("question")).alias("norm")).agg(F.min("entry_id").alias("entry_id"))
    return questions.select("question_id", *keys, normalize_question(F.col("question")).alias("norm")).join(firsts, [*keys, "norm"]).select("question_id", "entry_id")


def semantic(questions: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, others: bool = False, by: str | None = None) -> DataFrame:
    """(question_id, entry_id, similarity): the entry of greatest cosine, ties to the first, if it reaches the threshold. ``others``: an entry
    of the question's own id doesn't count, for questions that are entries themselves. ``by``: as in ``exact``, an equi-join."""
    if by is None:
        rows = top_k(entries.select("entry_id", "embedding"), questions.select("question_id", "embedding"), 1 + others, id_col="entry_id")
    else:
        v, w = V.doubles(F.col("v")), V.doubles(F.col("w"))
        pairs = entries.select(by, "entry_id", F.col("embedding").alias("v")).join(questions.select(by, "question_id", F.col("embedding").alias("w")), by)
        order = Window.partitionBy("question_id").orderBy(F.desc("sim"), "entry_id")
        rows = pairs.select("question_id", "entry_id", F.greatest(F.lit(0.0), V.cosine(v, w)).alias("sim")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 1 + others)
    rows = rows.where(F.col("sim") >= threshold)
    if others:
        turn = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
        rows = rows.where("entry_id <> question_id").withColumn("turn", turn).where("turn = 1")
    return rows.select("question_id", "entry_id", F.col("sim").alias("similarity"))


def lookup(questions: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, others: bool = False, by: str | None = None) -> DataFrame:
    """(question_id, entry_id, similarity, how): how is exact, semantic or miss, for every question. A question without a vector, as when its
    embedding failed, is only looked up exactly."""
    hit = exact(questions, entries, by).withColumns({"similarity": F.lit(1.0), "how": F.lit("exact")})
    rest = questions.where(F.size("embedding") > 0).join(hit.select("question_id"), "question_id", "left_anti")
    near = semantic(rest, entries.where(F.size("embedding") > 0), threshold, others, by).withColumn("how", F.lit("semantic"))
    found = hit.unionByName(near)
    return questions.select("question_id").join(found, "question_id", "left").withColumn("how", F.coalesce("how", F.lit("miss")))


def metrics(found: DataFrame) -> DataFrame:
    """Counts by kind and the mean similarity of semantic hits, 0 without any."""
    return found.agg(F.count_if(F.col("how") == "exact").alias("exact_hits"), F.count_if(F.col("how") == "semantic").alias("semantic_hits"), F.count_if(F.col("how") == "miss").alias("misses"), F.coalesce(F.avg(F.when(F.col("how") == "semantic", F.col("similarity"))), F.lit(0.0)).alias("mean_similarity"))
