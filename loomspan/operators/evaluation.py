"""Metrics of ingest, retrieval and answers, evaluation items, and validation of answer files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import services as S
from loomspan.operators.providers import filled
from loomspan.plans.shared import materialize

#: Dangling labels that a report shows.
SHOWN = 20
# Fixed value: what shows that an answer names its place.
GROUNDING = r"§\d|Figure \d|fig:|eq:"


def floor_rank_of(sizes: DataFrame, column: str, p: float) -> DataFrame:
    """(value): the element at floor(p * (n - 1)) of a column's sorted values; 0 without any. Counts of values lie sorted in range partitions;
    a total a partition tells which one holds the rank, and only that one is looked through."""
    spark = sizes.sparkSession
    counts = sizes.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a value stays in its partition
    spread = materialize(counts.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()), "counts")
    totals = spread.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row a partition
    rank = int(p * (sum(r["n"] for r in totals) - 1))
    before, part = 0, -1
    for r in totals:
        part = r["part"]
        if before + r["n"] > rank:
            break
        before += r["n"]
    run = spread.where(F.col("part") == part).withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("value")))
    return run.where(F.col("upto") > rank - before).agg(F.coalesce(F.min("value"), F.lit(0)).alias("value"))


def coverage(parsed: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_sections, n_covered, coverage): share of the sections other than 0 that have a body chunk."""
    own = parsed.select(id_col, F.explode(F.transform("sections", lambda s: s["number"])).alias("section_number")).where("section_number <> '0'")
    have = chunks.where("kind = 'body'").select(id_col, "section_number").distinct().withColumn("hit", F.lit(1))
    return own.join(have, [id_col, "section_number"], "left").groupBy(id_col).agg(F.count(F.lit(1)).alias("n_sections"), F.countDistinct(F.when(F.col("hit") == 1, F.col("section_number"))).alias("n_covered")).withColumn("coverage", F.round(F.col("n_covered") / F.greatest(F.lit(1), F.col("n_sections")), 3))


def chunk_sizes(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_chunks, p50, p95) of body chunks' lengths: the averaging median, cut to a whole number, and the floor rank. What meets by id is
    one count a length, not one row a chunk."""
    counts = chunks.where("kind = 'body'").groupBy(id_col, F.length("text").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(id_col)
    run = counts.withColumns({"upto": F.sum("n").over(own.orderBy("size")), "total": F.sum("n").over(own)})
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("size")))
    low, high = at(F.floor((F.col("total") - 1) / 2)), at(F.floor(F.col("total") / 2))
    return run.groupBy(id_col).agg(F.first("total").alias("n_chunks"), F.floor((low + high) / 2).cast("int").alias("p50"), at(F.floor((F.col("total") - 1) * 0.95)).cast("int").alias("p95"))


def dangling(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, undefined, unreferenced): the labels, sorted, that are referred to but name nothing, and those that nothing refers to. Both
    sides are in a document's row, so there is no join; a report shows the first ``SHOWN``."""
    label = lambda c: F.transform(c, lambda x: x["label"])
    less = lambda a, b: F.array_sort(F.array_except(label(a), label(b)))
    return parsed.select(id_col, less("referenced", "targets").alias("undefined"), less("targets", "referenced").alias("unreferenced"))


def resolution_rate(figures: DataFrame) -> DataFrame:
    return figures.agg(F.round(F.count("resolved_path") / F.greatest(F.lit(1), F.count(F.lit(1))), 3).alias("figure_resolution_rate"))


def recall_at(items: DataFrame, retrieved: DataFrame, k: int = 5) -> DataFrame:
    """One row: shares of items whose target section, or figure label, is among the first k rows. ``items`` (question_id, target_section, target_figure)."""
    top = retrieved.where(F.col("ord") <= k)
    hits = items.join(top, "question_id", "left").groupBy("question_id", "target_section", "target_figure").agg(F.max(F.coalesce(F.col("section_number") == F.col("target_section"), F.lit(False))).alias("s"), F.max(F.coalesce(F.array_contains("figure_refs", F.col("target_figure")), F.lit(False))).alias("f"))
    share = lambda hit, target: F.round(F.count_if(F.col(hit) & F.col(target).isNotNull()) / F.greatest(F.lit(1), F.count(target)), 3)
    return hits.agg(share("s", "target_section").alias("section_recall"), share("f", "target_figure").alias("figure_hit_rate"), F.count("target_section").alias("n_factual"), F.count("target_figure").alias("n_figure"))


def self_check(answers: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """One row over answer bodies: refusals, grounding marks, length; ``judged`` (relevance, specificity, consistency) adds means, missing scores as 0."""
    body = T.strip(F.coalesce("answer", F.lit("")))
    refused = (body == "") | F.contains(F.lower(body), F.lit("no answer"))
    out = answers.agg(F.count(F.lit(1)).alias("n_answers"), F.round(F.count_if(refused) / F.greatest(F.lit(1), F.count(F.lit(1))), 3).alias("refusal_rate"), F.coalesce(F.median(F.length(body)).cast("int"), F.lit(0)).alias("answer_len_p50"), F.coalesce(F.round(F.avg(F.regexp_count(body, F.lit(GROUNDING))), 2), F.lit(0.0)).alias("grounding_density_mean"))
    if judged is None:
        return out
    mean = lambda c: F.round(F.sum(F.coalesce(c, F.lit(0))) / F.greatest(F.lit(1), F.count(F.lit(1))), 2).alias(f"judge_{c}")
    return out.crossJoin(judged.agg(*map(mean, ("relevance", "specificity", "consistency"))))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in an order fixed by the seed alone."""
    return rows.orderBy(F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(key).cast("string"))), key).limit(n)


def counts_by_kind(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def render_report(metrics: DataFrame) -> DataFrame:
    """(report): a long table (section, metric, value) as one Markdown text; a few dozen rows."""
    line = F.concat(F.lit("- **"), "metric", F.lit("**: "), "value")
    by = metrics.groupBy("section").agg(F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", line.alias("line")))), lambda x: x["line"]), "\n")).alias("part"))
    return by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "part"))), lambda x: x["part"]), "\n\n").alias("report"))


def validate(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, slot, problem): slots that only one side has, and empty answers. No row means the files fit."""
    q, a = questions.select("doc_id", "slot", F.lit(True).alias("q")), answers.select("doc_id", "slot", F.lit(True).alias("a"), "answer")
    both = q.join(a, ["doc_id", "slot"], "full")
    problem = F.when(F.col("a").isNull(), "missing answer").when(F.col("q").isNull(), "unexpected answer").when(T.blank(F.col("answer")), "empty answer")
    return both.select("doc_id", "slot", problem.alias("problem")).where("problem is not null")


# What starts a question or an answer in a file.
QUESTION_HEAD, ANSWER_HEAD, ITEM = r"(?im)^[ \t]*##\s*Question\s+\d+\s*$", r"(?im)^##\s*Answer\s+\d+\s*$", r"^\s*\d+[).]\s+\S"


def validate_files(files: DataFrame) -> DataFrame:
    """(doc_id, problem) from (doc_id, questions, answers), texts of whole files; null where an answer file fits its questions. With question
    headers there must be answer headers, and the other way round; nothing may stand before the first answer; no answer is empty;
    and there are as many as questions, which without headers are the lines that aren't blank."""
    q, a = F.coalesce("questions", F.lit("")), F.coalesce("answers", F.lit(""))
    solid = lambda text: F.filter(F.split(text, r"\r?\n"), lambda x: ~T.blank(x))
    blocks = F.split(a, ANSWER_HEAD, -1)
    bodies = F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))
    lines = solid(a)
    items = F.size(F.filter(lines, lambda x: x.rlike(ITEM)))
    md_q, md_a, n_q = q.rlike(QUESTION_HEAD), a.rlike(r"(?im)^[ \t]*##\s*Answer\s+\d+\s*$"), F.regexp_count(q, F.lit(QUESTION_HEAD))
    markdown = F.when(~T.blank(F.get(blocks, F.lit(0))), "text before the first answer").when(F.exists(bodies, T.blank), "empty answer").when(F.size(bodies) != n_q, "number of answers")
    numbered = F.when(F.size(solid(q)) == 0, "no questions").when(~F.get(lines, F.lit(0)).rlike(ITEM), "text before the first answer").when(items != F.size(solid(q)), "number of answers")
    problem = F.when(T.blank(a), "no answers").when(md_q != md_a, "formats differ").when(md_q, markdown).otherwise(numbered)
    return files.select("doc_id", problem.alias("problem"))


FACT_PROMPT = """Write one specific question of fact about this text, and its answer. JSON only: {"q": "...", "a": "..."}

Text: {text}
"""
PICTURE_PROMPT = """Write one question that one must look at this figure to answer, not only at its caption, and its answer. JSON only: {"q": "...", "a": "..."}

Caption: {caption}
Description: {description}
"""
JUDGE_PROMPT = """Judge the answer. JSON only: {"relevance": 0, "specificity": 1, "consistency": 2, "comment": "..."}, each from 0 to 2.

Map of the article:
{map}

Question: {q}
Answer: {a}
"""
ITEMS = "q string, a string, target_section string, target_figure string, kind string"
FACTS, PICTURES = 20, 5


def synthetic(chunks: DataFrame, described: DataFrame, service: S.Chat, facts: int = FACTS, pictures: int = PICTURES) -> DataFrame:
    """(q, a, target_section, target_figure, kind): questions and answers that the service makes of a sample, fixed by its seed, of body chunks and
    of described figures. Replies without a question or an answer give none."""
    body = hash_sample(chunks.where("kind = 'body'"), "chunk_id", facts, 42).select("text", "section_number")
    shown = hash_sample(described, "label", pictures, 43).select("label", "caption", "description_text")
    one = S.ask(body, filled(FACT_PROMPT, text=F.substring("text", 1, 1500)), service, S.COMPOSE_S)
    two = S.ask(shown, filled(PICTURE_PROMPT, caption=F.col("caption"), description=F.substring("description_text", 1, 1000)), service, S.COMPOSE_S)
    item = F.from_json(T.salvage_json(F.col("reply")), "q string, a string")
    none = F.lit(None).cast("string")
    rows = one.select(item.alias("i"), F.col("section_number").alias("target_section"), none.alias("target_figure"), F.lit("factual").alias("kind")).unionByName(two.select(item.alias("i"), none.alias("target_section"), F.col("label").alias("target_figure"), F.lit("figure").alias("kind")))
    return rows.select("i.q", "i.a", "target_section", "target_figure", "kind").where("q <> '' and a <> ''")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items from JSON lines; lines that can't be read, or lack a question, are skipped."""
    return spark.read.schema(ITEMS).json(path, mode="DROPMALFORMED").where("q is not null")


def judged(answers: DataFrame, service: S.Chat, map_chars: int = 6000) -> DataFrame:
    """(relevance, specificity, consistency) of (question, answer, map), one row a reply that can be read."""
    replied = S.ask(answers, filled(JUDGE_PROMPT, map=F.substring("map", 1, map_chars), q=F.col("question"), a=F.col("answer")), service, S.COMPOSE_S)
    return replied.select(F.from_json(T.salvage_json(F.col("reply")), "relevance int, specificity int, consistency int").alias("j")).where("j is not null").select("j.*")


def answers_of(files: DataFrame) -> DataFrame:
    """(doc_id, slot, answer) of answer files (doc_id, answers): blocks under headers, or numbered items without their number."""
    from loomspan.sources import questions as Q

    md = F.col("answers").rlike(ANSWER_HEAD)
    block = Q.markdown_blocks(files.where(md).withColumnRenamed("answers", "text"), "Answer")
    item = Q.numbered_items(files.where(~md).withColumnRenamed("answers", "text"))
    return block.unionByName(item).select("doc_id", "slot", F.col("text").alias("answer"))


def ingest_report(parsed: DataFrame, chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """(section, metric, value) of an ingest: coverage, chunk sizes, resolved figures and dangling labels, over all documents."""
    covered = coverage(parsed, chunks).agg(F.sum("n_sections").cast("string").alias("n_sections"), F.round(F.sum("n_covered") / F.greatest(F.lit(1), F.sum("n_sections")), 3).cast("string").alias("section_coverage"))
    sizes = chunk_sizes(chunks.withColumn("doc_id", F.lit(0))).select(F.col("p50").cast("string").alias("chunk_size_p50"), F.col("p95").cast("string").alias("chunk_size_p95"))
    total = chunks.agg(F.count(F.lit(1)).cast("string").alias("n_chunks_total"))
    loose = dangling(parsed)

    def shown(column: str, name: str) -> DataFrame:
        """The first ``SHOWN`` labels of all documents."""
        first = loose.select(F.explode(column).alias("l")).distinct().orderBy("l").limit(SHOWN)
        return first.agg(F.array_join(F.array_sort(F.collect_list("l")), ", ").alias(name))

    labels = [shown("undefined", "label_undefined_referenced"), shown("unreferenced", "label_defined_unreferenced")]
    rate = resolution_rate(figures).select(F.col("figure_resolution_rate").cast("string"))
    return _long("retrieval", [covered, sizes, total, *labels, rate])


def _long(section: str, rows: list[DataFrame]) -> DataFrame:
    """One-row tables as (section, metric, value)."""
    out = None
    for row in rows:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns]))
        part = row.select(pairs.alias("x")).select(F.lit(section).alias("section"), "x.*")
        out = part if out is None else out.unionByName(part)
    return out
