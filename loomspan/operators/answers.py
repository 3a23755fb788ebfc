"""Sources for a prompt, context packing, routing, post-processing and the format of answers."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators.scan import running
from loomspan.operators import services as S
from loomspan.operators.providers import FALLBACK_MAP_CHARS, FALLBACK_PROMPT, TRANSLATE_PROMPT

SOURCES, SOURCE_CHARS, CONTEXT_CHARS = 8, 1500, 70_000
NO_ANSWER = "no answer"
NOTE = "Note: no relevant passage was retrieved; this answer rests on general context and may be uncertain."


def format_block(idx: Column, body: Column, fmt: Column) -> Column:
    """"## Answer N" and the body, or "N. body"; a blank body is the refusal."""
    text = F.coalesce(F.nullif(T.strip(F.coalesce(body, F.lit(""))), F.lit("")), F.lit(NO_ANSWER))
    n = idx.cast("string")
    return F.when(fmt == "markdown", F.concat(F.lit("## Answer "), n, F.lit("\n"), text)).otherwise(F.concat(n, F.lit(". "), text))


def stub_block(idx: Column, fmt: Column) -> Column:
    return format_block(idx, F.lit(NO_ANSWER), fmt)


def document(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, text): a document's blocks in order of slot, parted by a blank line (markdown) or not, with a final line end."""
    listed = blocks.groupBy(by, "fmt").agg(F.array_sort(F.collect_list(F.struct("slot", "block"))).alias("b"))
    gap = F.when(F.col("fmt") == "markdown", "\n\n").otherwise("\n")
    parts = F.transform("b", lambda x: x["block"])
    return listed.select(by, F.concat(F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), lambda a, x: F.concat(a, gap, x)), F.lit("\n")).alias("text"))


def format_sources(rows: DataFrame, by: str = "question_id", order: str = "ord") -> DataFrame:
    """(by, sources): the first ``SOURCES`` texts, cut and numbered."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy(order, "chunk_id"))
    kept = rows.withColumn("n", turn).where(F.col("n") <= SOURCES)
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), T.cut(F.col("text"), SOURCE_CHARS, "..."))
    return kept.select(by, "n", line.alias("line")).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n\n").alias("sources"))


def pack_context(chunks: DataFrame, by: str = "doc_id", limit: int = CONTEXT_CHARS) -> DataFrame:
    """(by, char_start, chunk_id, block, total): a document's chunks in order of place, up to the first block beyond the limit. Chunk ids are
    the document's own, each once. Lengths alone are added up, over ranges of the order, so a document may have any number of
    chunks; then the texts of the few that fit are joined to them."""
    section = F.coalesce(F.nullif(F.col("section_path"), F.lit("")), F.nullif(F.col("section_number"), F.lit("")), F.lit("?"))
    block = F.concat(F.lit("["), F.coalesce("kind", F.lit("body")), F.lit("; "), section, F.lit("]\n"), T.strip(F.col("text")))
    rows = chunks.where(~T.blank(F.col("text"))).select(by, F.coalesce("char_start", F.lit(0)).alias("__at"), "char_start", "chunk_id", block.alias("block"))
    sizes = rows.select(by, "__at", "chunk_id", (F.length("block") + 2).alias("__n"))
    fit = running(sizes, [by], ["__at", "chunk_id"], {"total": F.col("__n")}).where(F.col("total") <= limit)
    fit = fit.select(F.col(by).alias("__by"), F.col("chunk_id").alias("__id"), "total")
    return rows.join(fit, F.col(by).eqNullSafe(F.col("__by")) & (F.col("chunk_id") == F.col("__id"))).select(by, "char_start", "chunk_id", "block", "total")


def packed(chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, context): the packed blocks of each document as one text."""
    rows = pack_context(chunks, by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("char_start", F.lit(0)).alias("a"), "chunk_id", "block"))).alias("b"))
    return rows.select(by, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def needs_vision(needs: Column, label: Column) -> Column:
    return F.coalesce(needs, F.lit(False)) & (F.coalesce(label, F.lit("")) != "")


def add_visual(rows: DataFrame, visual: DataFrame) -> DataFrame:
    """``visual`` (question_id, label, text): replaces the text of the question's description chunks of that figure; a question that
    has none gets a chunk visual:label of score 0.99 at the end."""
    v = visual.select("question_id", F.col("label").alias("__l"), F.col("text").alias("__t"))
    mine = (F.col("kind") == "figure_desc") & F.array_contains("figure_refs", F.col("__l"))
    swapped = rows.join(v, "question_id", "left")
    done = swapped.where(mine).select("question_id").distinct()
    last = rows.groupBy("question_id").agg(F.max("ord").alias("ord"))
    fresh = v.join(done, "question_id", "left_anti").join(last, "question_id", "left").select("question_id", F.concat(F.lit("visual:"), "__l").alias("chunk_id"), F.lit("figure_desc").alias("kind"), F.col("__t").alias("text"), F.array("__l").alias("figure_refs"), F.lit(0.99).alias("score"), (F.coalesce("ord", F.lit(0)) + 1).alias("ord"))
    out = swapped.withColumn("text", F.when(F.coalesce(mine, F.lit(False)), F.col("__t")).otherwise(F.col("text"))).drop("__l", "__t")
    return out.unionByName(fresh, allowMissingColumns=True)


def with_note(text: Column) -> Column:
    """The uncertainty note at the end, once."""
    bare = F.coalesce(F.nullif(T.strip(F.coalesce(text, F.lit(""))), F.lit("")), F.lit("No answer."))
    return F.when(F.contains(bare, F.lit(NOTE)), bare).otherwise(F.concat(bare, F.lit("\n\n" + NOTE)))


def postprocess(rows: DataFrame, fallback: Column, translated: Column) -> DataFrame:
    """``answer`` made final: refusals are replaced by ``fallback`` and noted, Cyrillic answers by ``translated``; adds fallback_used."""
    refused = T.is_no_answer(F.col("answer"))
    text = F.when(refused, F.coalesce(fallback, F.lit(NO_ANSWER))).otherwise(T.strip(F.col("answer")))
    out = rows.withColumns({"fallback_used": refused, "answer": text})
    out = out.withColumn("answer", F.when(~T.is_no_answer(F.col("answer")) & T.has_cyrillic(F.col("answer")), F.coalesce(F.nullif(translated, F.lit("")), F.col("answer"))).otherwise(F.col("answer")))
    return out.withColumn("answer", F.when(F.col("fallback_used"), with_note(F.col("answer"))).otherwise(F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.lit(NO_ANSWER))))


def finish(rows: DataFrame, service: S.Chat, deadline: S.Deadline | None = None, by: str = "doc_id") -> DataFrame:
    """``rows`` (by, slot, idx, question, answer, map, context) with final answers and fallback_used. A refusal is asked again with the
    article's chunks and what its document's earlier questions were answered, so a document's questions are taken in order, by one
    task; Cyrillic answers are translated. What fails or comes too late leaves the answer as it was."""
    keys = [f for f in rows.schema.fields if f.name not in ("map", "context", "answer", "fallback_used")]
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "answer string", "fallback_used boolean"])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("slot")
        answers, used, previous = [], [], []
        for r in part.to_pylist():
            answer = (r["answer"] or "").strip()
            refused = is_refusal(answer)
            if refused:
                prompt = fill(FALLBACK_PROMPT, map=(r["map"] or "")[:FALLBACK_MAP_CHARS], previous="\n\n".join(previous) or "(none)", context=r["context"] or "", question=r["question"])
                answer = S.reply(service, prompt, S.COMPOSE_S, deadline, S.FALLBACK_S) or NO_ANSWER
            if not is_refusal(answer) and any("\u0400" <= c <= "\u04ff" for c in answer):
                answer = S.reply(service, fill(TRANSLATE_PROMPT, question=r["question"], answer=answer), S.COMPOSE_S, deadline, S.TRANSLATION_S) or answer
            if refused and NOTE not in answer:
                answer = f"{answer}\n\n{NOTE}"
            previous.append(f"Question {r['idx']}: {r['question']}\nAnswer {r['idx']}: {answer}")
            answers.append(answer)
            used.append(refused)
        return part.select([f.name for f in keys]).append_column("answer", pa.array(answers, pa.string())).append_column("fallback_used", pa.array(used, pa.bool_()))

    return rows.groupBy(by).applyInArrow(run, shape)


def is_refusal(text: str) -> bool:
    """The same as ``is_no_answer``, of one text."""
    return text.strip(" .\"'`\n\t\r").lower() in ("", NO_ANSWER)


def fill(template: str, **values: str) -> str:
    """The template with its {names} replaced in one pass, so that values may hold braces."""
    return re.sub(r"\{(" + "|".join(values) + r")\}", lambda m: values[m[1]], template)
