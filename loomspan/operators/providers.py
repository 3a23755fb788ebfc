"""Services that answer in text or vectors. Real ones are injected as callables; the defaults are deterministic and offline."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.functions import vectors as V
from loomspan.operators import services as S
from loomspan.plans.shared import materialize, release
from loomspan.sources.store import DESCRIPTION
from loomspan.sources.tables import KeyedTable

BATCH, LADDER = 32, (1500, 800, 400)
ATTEMPTS, BASE_DELAY = 3, 2.0
MAP_CHARS, FALLBACK_MAP_CHARS, CONTEXT_CHARS, SHORT_CONTEXT, BODY_CHARS = 8000, 12_000, 600, 300, 3000
# The words that make a question one about figures.
FIGURE_WORDS = ("figure", "diagram", "plot", "shows")
PLAN_PROMPT = """Plan the retrieval for a question about an article.

Map of the article:
{map}

Question: {question}

Which sections, by number, most likely hold the answer? Three at most, numbers only. Is the question about a figure, and which label of
the map is it? Must the image itself be seen, or does the kept description do, as it mostly does?
Reply with JSON only: {"section_scope": ["2", "2.1"], "is_figure_question": false, "target_label": null, "needs_vision": false, "reasoning": "one sentence"}
"""
COMPOSE_PROMPT = """Answer in English, from the sources alone. If the answer isn't in them, write exactly "no answer".

Map of the article, for orientation only:
{map}

Sources:
{sources}

Question: {question}

Be brief: up to four sentences for a fact, six for an explanation. Name a figure that matters. Mention the section of a source that you
use, as in (§2.1). Keep numbers and equations as they are. Where sources differ, prefer the more specific section.
"""
SECOND_PASS_HINT = """
The sources for this question come from the whole article, whatever the section. If they still lack the answer, write exactly "no answer".
"""
FALLBACK_PROMPT = """Answer in English. Retrieval found no answer to this question. Use what you know, the questions answered before and the article's
chunks below, and give the best short answer you can; refer to earlier questions where this one does. Write "no answer" only if there is
none at all.

Map of the article:
{map}

Answered before:
{previous}

Chunks of the article:
{context}

Question: {question}
"""
TRANSLATE_PROMPT = """Translate the answer to English. Keep formulas, numbers, references and format; add nothing, and return the translation alone.

Question: {question}

Answer:
{answer}
"""
SUMMARY_PROMPT = """Summarise this section twice, as JSON: "title_hint" in 25 words at most, for the map of the article; "dense_summary" in 80 to 100 words,
to be searched. JSON only.

{body}
"""
FIGURE_PROMPT = """Describe this figure for somebody who can't see it.
Caption: {caption}
Text before:
{before}

Text after:
{after}

Reply with JSON only: "subject" (one sentence), "axes_or_layout", "key_visual_elements" (a list), "numbers_visible" (a list), "takeaway" (one sentence).
"""
LOOK_PROMPT = """The question is: {question}
Caption of the figure: "{caption}".
Answer it in English from the figure. If it can't be seen there, write "not visible".
"""
#: What a planner's reply holds.
PLAN = "section_scope array<string>, is_figure_question boolean, target_label string, needs_vision boolean, reasoning string"


def filled(template: str, **values: Column) -> Column:
    """The template with its {names} replaced, null values by nothing."""
    parts, rest = [], template
    while True:
        at = min((k for k in (rest.find("{" + n + "}") for n in values) if k >= 0), default=-1)
        if at < 0:
            return F.concat(*parts, F.lit(rest))
        name = rest[at + 1 : rest.index("}", at)]
        parts += [F.lit(rest[:at]), F.coalesce(values[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]


def offline_vector(text: Column, size: int = 64) -> Column:
    return V.hashed_words(text, size, length_one=True)


def embed_distinct(rows: DataFrame, text_col: str, service: Callable[[list[str]], list[list[float]]] | None = None, size: int = 64) -> DataFrame:
    """The same for questions: each text once however many rows have it, and a failure leaves a question without a vector."""
    if service is None:
        return embed(rows, text_col, None, size)
    return rows.join(embed(rows.select(text_col).distinct(), text_col, service, size, strict=False), text_col, "left")


def embed(rows: DataFrame, text_col: str, service: Callable[[list[str]], list[list[float]]] | None = None, size: int = 64, too_large: Callable[[Exception], bool] = lambda e: "large" in str(e).lower(), sleep: Callable[[float], None] = time.sleep, strict: bool = True) -> DataFrame:
    """Adds ``embedding``. With a service: batches of ``BATCH``, texts cut by the ladder while it finds them too large, at last
    one by one, and a zero vector for what still is; other errors are tried again after growing delays, and then raised, or, unless
    ``strict``, the texts have no vector: an empty one, which is near to nothing."""
    if service is None:
        return rows.withColumn("embedding", offline_vector(F.col(text_col), size))

    def tried(call: Callable[[], list]) -> list:
        for k in range(ATTEMPTS):
            try:
                return call()
            except Exception as e:
                if too_large(e) or k == ATTEMPTS - 1:
                    raise
                sleep(BASE_DELAY * 2**k)
        return []

    def vectors(texts: list[str]) -> list[list[float]]:
        for limit in LADDER[:2]:
            try:
                return tried(lambda limit=limit: service([t[:limit] for t in texts]))
            except Exception as e:
                if not too_large(e):
                    raise
        out = []
        for t in texts:
            for limit in LADDER[1:]:
                try:
                    out += tried(lambda limit=limit, t=t: service([t[:limit]]))
                    break
                except Exception as e:
                    if not too_large(e):
                        raise
            else:
                out.append([0.0] * size)
        return out

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part[text_col].fillna("").tolist()
            found = []
            for k in range(0, len(texts), BATCH):
                some = texts[k : k + BATCH]
                try:
                    found += vectors(some)
                except Exception as e:
                    if strict:
                        raise
                    S.log.warning("embedding failed: %s", e)
                    found += [[] for _ in some]
            part["embedding"] = found
            yield part

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "embedding")
    return rows.drop("embedding").mapInPandas(run, f"{fields}, embedding array<double>")


def embed_kept(rows: DataFrame, text_col: str, service: Callable[[list[str]], list[list[float]]] | None, memo: KeyedTable, model: str, size: int = 64, **how) -> DataFrame:
    """As ``embed``, but a text that was embedded before isn't sent again: vectors are kept in ``memo`` (key, embedding) under a hash of the
    model and of the text as it is cut first. Equal texts of one run are sent once. Without a service there is nothing to keep."""
    if service is None:
        return embed(rows, text_col, None, size)
    cut = F.substring(F.coalesce(text_col, F.lit("")), 1, LADDER[0])
    keyed = rows.drop("embedding").withColumn("__key", F.sha2(F.concat(F.lit(f"{model}\0"), cut), 256))
    asked = keyed.groupBy(F.col("__key").alias("key")).agg(F.min(text_col).alias("text"))
    old = memo.read()
    missing = materialize(asked if old is None else asked.join(old.select("key"), "key", "left_anti"), "unseen")
    if old is None or not missing.isEmpty():
        memo.upsert(embed(missing, "text", service, size, **how).select("key", "embedding"))
        memo.compact()
    release(missing)
    return keyed.join(memo.read().withColumnRenamed("key", "__key"), "__key", "left").drop("__key")


def rule_plan(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """(question_id, scope, is_figure, target_label, needs_vision): up to three sections whose titles share most words with the
    question; figure words make it one about figures. ``sections`` (doc_id, number, title); joined by document and word."""
    words = lambda c: F.filter(F.array_distinct(F.split(T.normalize_question(c), " ")), lambda w: F.length(w) > 3)
    q = questions.select("question_id", "doc_id", F.explode(words(F.col("question"))).alias("w"))
    s = sections.select("doc_id", "number", F.explode(words(F.col("title"))).alias("w"))
    hits = q.join(s, ["doc_id", "w"]).groupBy("question_id", "number").agg(F.count(F.lit(1)).alias("n"))
    scope = hits.groupBy("question_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "number"))), 1, 3), lambda x: x["number"]).alias("scope"))
    label = F.nullif(F.regexp_extract("question", r"((?:fig|eq):[\w:-]+)", 1), F.lit(""))
    return questions.join(scope, "question_id", "left").withColumns({"is_figure": F.lower("question").rlike("|".join(FIGURE_WORDS)), "target_label": label, "needs_vision": F.lit(False)})


def parse_plan(reply: Column) -> Column:
    """The struct of a planner's JSON reply, null where there is none."""
    return F.from_json(T.salvage_json(reply), PLAN)


def plan(questions: DataFrame, sections: DataFrame, maps: DataFrame | None = None, service: S.Chat | None = None, deadline: S.Deadline | None = None) -> DataFrame:
    """(question columns, scope, is_figure, target_label, needs_vision, reasoning): by the service if there is one, from the article's map;
    a reply that can't be read is a plan without a scope. Without a service by rule."""
    if service is None:
        return rule_plan(questions, sections).withColumn("reasoning", F.lit("words shared with titles"))
    rows = questions if maps is None else questions.join(maps.select("doc_id", "map"), "doc_id", "left")
    shown = F.col("map") if maps is not None else F.lit("")
    replied = S.ask(rows, filled(PLAN_PROMPT, map=shown, question=F.col("question")), service, S.PLAN_S, deadline)
    p = F.col("p")
    return replied.withColumn("p", parse_plan(F.col("reply"))).select(*questions.columns, F.when(F.size(p["section_scope"]) > 0, p["section_scope"]).alias("scope"), F.coalesce(p["is_figure_question"], F.lit(False)).alias("is_figure"), p["target_label"].alias("target_label"), F.coalesce(p["needs_vision"], F.lit(False)).alias("needs_vision"), F.coalesce(p["reasoning"], F.lit("")).alias("reasoning"))


def compose(rows: DataFrame, service: S.Chat | None = None, second: bool = False, deadline: S.Deadline | None = None) -> DataFrame:
    """(question_id, answer) from (question_id, question, sources, map): by the service, or the sentence that shares most words."""
    sources = F.coalesce("sources", F.lit(""))
    if service is None:
        return rows.select("question_id", extractive_answer(F.col("question"), sources).alias("answer"))
    prompt = filled(COMPOSE_PROMPT + (SECOND_PASS_HINT if second else ""), map=F.substring("map", 1, MAP_CHARS), sources=F.coalesce(F.nullif(sources, F.lit("")), F.lit("(no sources)")), question=F.col("question"))
    return S.ask(rows, prompt, service, S.COMPOSE_S, deadline).select("question_id", F.coalesce(F.nullif("reply", F.lit("")), F.lit("no answer")).alias("answer"))


def look(rows: DataFrame, service: S.Vision, deadline: S.Deadline | None = None) -> DataFrame:
    """(question_id, label, text) from (question_id, question, label, caption, image): what the service sees for the question."""
    seen = S.ask_about_images(rows, filled(LOOK_PROMPT, question=F.col("question"), caption=F.col("caption")), "image", service, deadline=deadline)
    return seen.where("reply is not null").select("question_id", "label", F.concat(F.lit("Visual answer for "), "label", F.lit(": "), "reply").alias("text"))


def extractive_answer(question: Column, sources: Column) -> Column:
    """The sentence of the sources that shares most words with the question; the refusal if none shares any."""
    wanted = F.filter(F.split(T.normalize_question(question), " "), lambda w: F.length(w) > 3)
    sentences = F.filter(F.transform(F.split(sources, r"(?<=[.!?])\s+"), T.strip), lambda s: s != "")
    scored = F.transform(sentences, lambda s: F.struct(F.size(F.array_intersect(F.split(T.normalize_question(s), " "), wanted)).alias("n"), (-F.length(s)).alias("l"), s.alias("s")))
    best = F.array_max(scored)
    return F.when(F.coalesce(best["n"], F.lit(0)) > 0, best["s"]).otherwise(F.lit("no answer"))


def summaries(parsed: DataFrame, service: S.Chat | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, number, title_hint, dense_summary) of sections of over 200 characters, for documents of 1 to 60 such sections; JSON replies
    are salvaged and cut; sections whose call fails have none. Without a service there are none."""
    rows = parsed.select(id_col, F.filter(F.arrays_zip(F.col("sections").alias("s"), F.col("bodies").alias("body")), lambda x: (x["s"]["number"] != "0") & (F.length(x["body"]) > 200)).alias("long"))
    rows = rows.where((F.size("long") > 0) & (F.size("long") <= 60)).select(id_col, F.inline("long")).select(id_col, F.col("s.number").alias("number"), "body")
    if service is None:
        return rows.where("false").select(id_col, "number", F.lit("").alias("title_hint"), F.lit("").alias("dense_summary"))
    replied = S.ask(rows, filled(SUMMARY_PROMPT, body=F.substring("body", 1, BODY_CHARS)), service, S.SUMMARY_S)
    r = F.from_json(T.salvage_json(F.col("reply")), "title_hint string, dense_summary string")
    cut = lambda name, n: F.substring(T.strip(F.coalesce(F.col("r")[name], F.lit(""))), 1, n).alias(name)
    return replied.select(id_col, "number", r.alias("r")).where("r is not null").select(id_col, "number", cut("title_hint", 300), cut("dense_summary", 1000))


def describe(figures: DataFrame, images: DataFrame | None = None, service: S.Vision | None = None, id_col: str = "doc_id", deadline: S.Deadline | None = None) -> DataFrame:
    """(id, label, tex_path, section_path, caption, before, after, description, description_text, seen) from figures with their surroundings.
    ``images`` (id, label, image). What the service's JSON says; else caption and context: of figures without an image, without a
    service, past the deadline or whose call failed. Of figures of one label the last counts."""
    last = figures.groupBy(id_col, "label").agg(F.max_by(F.struct("tex_path", "section_path", "caption", "before", "after"), "char_pos").alias("r")).select(id_col, "label", "r.*")
    none = F.lit(None).cast("string")
    if images is None:
        rows = last.withColumns({"pictured": F.lit(False), "reply": none})
    else:
        images = images.select(id_col, "label", "image").dropDuplicates([id_col, "label"])
        if service is None:
            rows = last.join(images.select(id_col, "label", F.lit(True).alias("pictured")), [id_col, "label"], "left").withColumn("reply", none)
        else:
            prompt = filled(FIGURE_PROMPT, caption=F.coalesce(F.nullif("caption", F.lit("")), F.lit("(none)")), before=F.substring("before", 1, CONTEXT_CHARS), after=F.substring("after", 1, CONTEXT_CHARS))
            rows = S.ask_about_images(last.join(images, [id_col, "label"], "left").withColumn("pictured", F.col("image").isNotNull()), prompt, "image", service, deadline=deadline)
    rows = rows.withColumn("description", F.from_json(T.salvage_json(F.col("reply")), DESCRIPTION))
    short = lambda c, n: F.substring(c, 1, n)
    missing = F.concat(F.lit("Figure "), "label", F.lit(": "), "caption", F.lit(" (image not available). Context before: "), short("before", SHORT_CONTEXT), F.lit(" ... Context after: "), short("after", SHORT_CONTEXT))
    plain = F.concat(F.lit("Caption: "), "caption", F.lit(" | Context: "), *([short("before", 500), F.lit(" "), short("after", 500)] if service is None else [short("before", SHORT_CONTEXT)]))
    text = F.when(~F.coalesce("pictured", F.lit(False)), missing).when(F.col("description").isNull(), plain).otherwise(T.flatten_description(F.col("caption"), F.col("description")))
    return rows.select(id_col, "label", "tex_path", "section_path", "caption", "before", "after", "description", T.strip(text).alias("description_text"), F.col("description").isNotNull().alias("seen"))
