"""Question and answer files. Texts come one row a file; lines are numbered within the row, so files of any number need one
exchange at most, by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.functions.spans import matches

# What starts a question or an answer.
MARKDOWN = r"(?im)^##[ \t]*{}[ \t]+(\d+)[ \t]*$"
NUMBERED = r"^\s*(\d+)[\).]\s+(.*\S)\s*$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, byte-order marks dropped."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("text"))


def is_markdown(text: Column, word: str = "Question") -> Column:
    return text.rlike(MARKDOWN.format(word).replace("^##", "^[ \\t]*##"))


def markdown_blocks(docs: DataFrame, word: str = "Question", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, slot, idx, text): what stands between a header of the word and the next, stripped."""
    heads = matches(F.col(text_col), MARKDOWN.format(word), 1)
    rows = docs.select(id_col, text_col, heads.alias("h")).select(id_col, text_col, "h", F.posexplode("h").alias("i", "x"))
    end = F.coalesce(F.get("h", F.col("i") + 1)["start"], F.length(text_col))
    return rows.select(id_col, (F.col("i") + 1).alias("slot"), F.col("x.g1").cast("int").alias("idx"), T.strip(T.between(F.col(text_col), F.col("x.end"), end)).alias("text"))


def numbered_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, slot, idx, text): a line "N. text" or "N) text" starts an item, later lines that aren't blank continue it; what stands before the first is ignored."""
    lines = docs.select(id_col, F.posexplode(F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n")).alias("at", "line"))
    order = Window.partitionBy(id_col).orderBy("at")
    starts = lines.withColumn("start", F.col("line").rlike(NUMBERED)).withColumn("slot", F.sum(F.col("start").cast("int")).over(order))
    kept = starts.where((F.col("slot") > 0) & ~T.blank(F.col("line")))
    shown = F.when(F.col("start"), F.regexp_extract("line", NUMBERED, 2)).otherwise(F.col("line"))
    groups = kept.groupBy(id_col, F.col("slot").cast("int").alias("slot")).agg(F.max(F.when(F.col("start"), F.regexp_extract("line", NUMBERED, 1).cast("int"))).alias("idx"), F.array_sort(F.collect_list(F.struct("at", shown.alias("line")))).alias("l"))
    return groups.select(id_col, "slot", "idx", T.strip(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def load(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, slot, idx, text, fmt) of question texts, each in the mode its headers show."""
    md = is_markdown(F.col(text_col))
    a = markdown_blocks(docs.where(md), "Question", id_col, text_col).withColumn("fmt", F.lit("markdown"))
    return a.unionByName(numbered_items(docs.where(~md), id_col, text_col).withColumn("fmt", F.lit("numbered")))


def required(questions: DataFrame) -> DataFrame:
    """The same rows; an empty table is an error."""
    n = questions.agg(F.count(F.lit(1)).alias("n")).select(F.assert_true(F.col("n") > 0, F.lit("no questions found")).alias("ok"))
    n.collect()
    return questions


def baseline(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, slot, block): a numbered placeholder for each line that isn't blank."""
    solid = F.filter(F.split(F.col(text_col), "\r?\n"), lambda x: ~T.blank(x))
    return docs.select(id_col, F.posexplode(solid).alias("i", "line")).select(id_col, (F.col("i") + 1).alias("slot"), F.concat((F.col("i") + 1).cast("string"), F.lit(". no answer")).alias("block"))
