"""Answering: cache, plan, retrieval, images, composition, a second pass and the last resort, each for all questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import answers as A
from loomspan.operators import providers, qa_cache, retrieval
from loomspan.operators import services as S
from loomspan.plans.shared import materialize
from loomspan.sources.store import Store, entries_of, numbered


@dataclass(frozen=True)
class Services:
    """Callables that answer; what is None is done by rule, or left out."""

    planner: S.Chat | None = None
    chat: S.Chat | None = None
    vision: S.Vision | None = None
    embedder: object | None = None
    size: int = 64


def _drafted(plans: DataFrame, chunks: DataFrame, maps: DataFrame, images: DataFrame | None, services: Services, limits: retrieval.Limits, second: bool, deadline: S.Deadline | None) -> DataFrame:
    """(question_id, answer, doc_ids, deferred): retrieval in each question's document, a look at its figure where the plan asks for one, and
    an answer from the sources."""
    rows = retrieval.retrieve(chunks, plans, limits, "doc_id")
    if services.vision is not None and images is not None:
        wanted = plans.where(A.needs_vision(F.col("needs_vision"), F.col("target_label"))).select("question_id", "doc_id", "question", F.col("target_label").alias("label"))
        rows = materialize(rows, "retrieved")
        rows = A.add_visual(rows, materialize(providers.look(wanted.join(images.select("doc_id", "label", "caption", "image"), ["doc_id", "label"]), services.vision, deadline), "seen"))
    else:
        rows = materialize(rows, "retrieved")
    used = rows.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"]).alias("doc_ids"))
    asked = plans.select("question_id", "doc_id", "question").join(maps, "doc_id", "left").join(A.format_sources(rows), "question_id", "left")
    answered = providers.compose(asked, services.chat, second, deadline)
    return answered.join(used, "question_id", "left").withColumns({"doc_ids": F.coalesce("doc_ids", F.array().cast("array<string>")), "deferred": F.lit(second)})


def answer(questions: DataFrame, chunks: DataFrame, sections: DataFrame, maps: DataFrame | None = None, entries: DataFrame | None = None, images: DataFrame | None = None, services: Services = Services(), limits: retrieval.Limits = retrieval.Limits(), deadline: S.Deadline | None = None) -> DataFrame:
    """(question_id, doc_id, slot, idx, question, embedding, answer, how, deferred, fallback_used, doc_ids, plan) for every row of ``questions``
    (question_id, doc_id, slot, idx, question). Each question asks the ``chunks`` (doc_id, chunk columns[, embedding]) of its own document.
    Cached answers, ``entries`` (entry_id, doc_id, question, embedding, answer) of the same document, come first. Of the others, those whose plan names a known section are
    answered at once; the rest are deferred: planned again if there is a planner, and asked of the whole article with a hint that says so.
    Refusals get a last try with the article's packed chunks. Past the deadline questions keep the refusal, as the stub does."""
    maps = questions.select("doc_id").distinct().withColumn("map", F.lit("")) if maps is None else maps.select("doc_id", "map")
    asked = materialize(providers.embed_distinct(questions, "question", services.embedder, services.size), "asked")
    if "embedding" not in chunks.columns:
        chunks = materialize(providers.embed(chunks, "text", services.embedder, services.size), "embedded")
    shape = ["question_id", "answer", "how", "deferred", "doc_ids", "plan"]
    none = F.array().cast("array<string>")
    done = None
    todo = asked
    if entries is not None:
        found = materialize(qa_cache.lookup(asked, entries, by="doc_id").where("how <> 'miss'"), "cached")
        done = found.join(entries.select("entry_id", "answer"), "entry_id").withColumns({"deferred": F.lit(False), "doc_ids": none, "plan": F.lit("{}")}).select(*shape)
        todo = asked.join(found.select("question_id"), "question_id", "left_anti")

    def planned(rows: DataFrame) -> DataFrame:
        plans = providers.plan(rows.select(*asked.columns), sections, maps, services.planner, deadline)
        return materialize(retrieval.validate_scope(plans, chunks, "doc_id"), "plans")

    def drafted(plans: DataFrame, second: bool) -> DataFrame:
        text = F.to_json(F.struct(F.col("scope").alias("section_scope"), F.col("is_figure").alias("is_figure_question"), "target_label", "needs_vision", "reasoning"))
        rows = _drafted(plans, chunks, maps, images, services, limits, second, deadline).join(plans.select("question_id", text.alias("plan")), "question_id")
        return materialize(rows.withColumn("how", F.lit("retrieved")).select(*shape), "drafted")

    first = planned(todo)
    out = drafted(first.where("not unscoped"), False)
    later = first.where("unscoped")
    if deadline is None or deadline.remaining > S.SECOND_PASS_S:
        again = planned(later) if services.planner is not None else later
        out = out.unionByName(drafted(again, True))
    if done is not None:
        out = out.unionByName(done)
    rows = asked.join(out, "question_id", "left").withColumns({"answer": F.coalesce("answer", F.lit(A.NO_ANSWER)), "how": F.coalesce("how", F.lit("stub")), "deferred": F.coalesce("deferred", F.lit(True)), "doc_ids": F.coalesce("doc_ids", none), "plan": F.coalesce("plan", F.lit("{}"))})
    if services.chat is None:
        return A.postprocess(rows, F.lit(A.NO_ANSWER), F.lit(None).cast("string"))
    # Only documents with a refusal need their chunks packed.
    refused = rows.where(A.T.is_no_answer(F.col("answer"))).select("doc_id").distinct()
    context = A.packed(chunks.join(refused, "doc_id", "left_semi"))
    return A.finish(rows.join(maps, "doc_id", "left").join(context, "doc_id", "left"), services.chat, deadline)


def keep(store: Store, answered: DataFrame, name: str = "qa") -> DataFrame:
    """Adds the answers that weren't kept before to the store; the kept table."""
    return store.append(name, entries_of(answered.where("how = 'retrieved'")))


def kept(store: Store, name: str = "qa") -> DataFrame | None:
    """Kept answers as ``answer`` takes them; None without any."""
    rows = store.load(name)
    return None if rows is None else numbered(rows)


def answer_file(questions: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) of answer files from ``questions`` (question_id, doc_id, slot, idx, fmt): a stub for every question, replaced where there
    is an answer."""
    rows = questions.withColumn("answer", F.lit(None).cast("string")) if answered is None else questions.join(answered.select("question_id", "answer"), "question_id", "left")
    return A.document(rows.select("doc_id", "slot", "fmt", A.format_block(F.col("idx"), F.col("answer"), F.col("fmt")).alias("block")))
