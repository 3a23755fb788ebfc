"""Command line: ``python -m loomspan answer|evaluate|check|baseline --data FOLDER``, for one article's folder.

``answer`` writes an answer file at once, a stub for every question, and replaces it when the answers are there: whatever fails or comes
too late, there is a valid file. Services are named as ``module:function``; without them answers are made by rule.
"""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import os
import sys

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import evaluation
from loomspan.operators import services as S
from loomspan.plans import answering
from loomspan.plans.ingest import Artifacts, ingest, read_folder
from loomspan.sources import questions as Q
from loomspan.sources.store import Store

log = S.log


def session() -> SparkSession:
    """The session that spark-submit or the settings name; else one machine."""
    builder = SparkSession.builder.appName("loomspan")
    if not SparkConf().contains("spark.master"):
        builder = builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    return builder.getOrCreate()


def service(name: str | None):
    """The function that ``module:function`` names."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, doc_id, slot, idx, question, fmt) of one file; a file without a question is an error."""
    docs = Q.read(spark, path).select(F.lit(0).cast("long").alias("doc_id"), "text")
    return Q.required(Q.load(docs)).select(F.col("slot").cast("long").alias("question_id"), "doc_id", "slot", "idx", F.col("text").alias("question"), "fmt")


def write_file(answers: DataFrame, path: str) -> None:
    """One article's answer file, first beside its place."""
    text = answers.first()["text"]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".new", path)


def services_of(args: argparse.Namespace) -> answering.Services:
    return answering.Services(service(args.planner), service(args.chat), service(args.vision), service(args.embedder))


def ingested(spark: SparkSession, args: argparse.Namespace, services: answering.Services) -> tuple[Artifacts, Store]:
    store = Store(spark, os.path.abspath(args.work))
    return ingest(read_folder(spark, os.path.abspath(args.data)), store, services.chat, services.vision), store


def embedded(art: Artifacts, store: Store, services: answering.Services, model: str | None) -> DataFrame:
    """Chunks with vectors; a text is sent to the service only if no run before has sent it."""
    return answering.providers.embed_kept(art.chunks, "text", services.embedder, store.keyed("vectors", ["key"]), model or "", services.size)


def sections_of(art: Artifacts) -> DataFrame:
    return art.structure.select("doc_id", F.inline("sections")).select("doc_id", "number", "title")


def run_answer(spark: SparkSession, args: argparse.Namespace) -> int:
    deadline = S.Deadline.after(args.seconds)
    asked = read_questions(spark, os.path.join(args.data, "questions.txt"))
    write_file(answering.answer_file(asked), args.out)
    try:
        services = services_of(args)
        art, store = ingested(spark, args, services)
        chunks = answering.materialize(embedded(art, store, services, args.embedder), "embedded")
        answered = answering.materialize(answering.answer(asked.drop("fmt"), chunks, sections_of(art), art.maps, answering.kept(store), art.images, services, deadline=deadline), "answered")
        write_file(answering.answer_file(asked, answered), args.out)
        answering.keep(store, answered)
        log.info("answered: %s", {r["how"]: r["n"] for r in answered.groupBy("how").agg(F.count(F.lit(1)).alias("n")).collect()})
    except Exception:
        log.exception("the answers are missing, the stubs stay")
        return 1
    return 0


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    services = services_of(args)
    art, store = ingested(spark, args, services)
    report = evaluation.ingest_report(art.structure, art.chunks, art.figures)
    items = os.path.join(os.path.abspath(args.work), "items")
    if args.mode in ("synthetic", "all") and (services.chat or os.path.isdir(items)):
        if not os.path.isdir(items):
            evaluation.synthetic(art.chunks, art.figures, services.chat).coalesce(1).write.json(items)
        asked = evaluation.read_items(spark, items).withColumns({"question_id": F.monotonically_increasing_id(), "doc_id": F.lit(0).cast("long")})
        asked = answering.materialize(answering.providers.embed(asked, "q", services.embedder, services.size), "items")
        plans = asked.select("question_id", "doc_id", "embedding", F.lit(None).cast("array<string>").alias("scope"), (F.col("kind") == "figure").alias("is_figure"), F.col("target_figure").alias("target_label"))
        found = answering.retrieval.retrieve(embedded(art, store, services, args.embedder), plans, by="doc_id")
        report = report.unionByName(evaluation._long("synthetic_recall", [evaluation.recall_at(asked, found)]))
        report = report.unionByName(evaluation.counts_by_kind(asked).select(F.lit("synthetic_kinds").alias("section"), F.col("kind").alias("metric"), F.col("n").cast("string").alias("value")))
    answers, questions = args.out, os.path.join(args.data, "questions.txt")
    if args.mode in ("self-check", "all") and os.path.isfile(answers) and os.path.isfile(questions):
        given = evaluation.answers_of(Q.read(spark, answers).select(F.lit(0).cast("long").alias("doc_id"), F.col("text").alias("answers")))
        scores = None
        if services.chat:
            scores = evaluation.judged(given.join(read_questions(spark, questions), ["doc_id", "slot"]).join(art.maps, "doc_id"), services.chat)
        report = report.unionByName(evaluation._long("self_check", [evaluation.self_check(given, scores)]))
    report = answering.materialize(report, "report")
    print(json.dumps([r.asDict() for r in report.collect()], ensure_ascii=False, indent=2))
    os.makedirs(args.reports, exist_ok=True)
    with open(os.path.join(args.reports, "report.md"), "w", encoding="utf-8") as f:
        f.write("# Eval Report\n\n" + (evaluation.render_report(report).first()["report"] or "") + "\n")
    return 0


def run_check(spark: SparkSession, args: argparse.Namespace) -> int:
    read = lambda path, name: Q.read(spark, path).select(F.lit(0).cast("long").alias("doc_id"), F.col("text").alias(name))
    files = read(os.path.join(args.data, "questions.txt"), "questions").join(read(args.out, "answers"), "doc_id")
    problem = evaluation.validate_files(files).first()["problem"]
    print(problem or "ok")
    return int(problem is not None)


def run_baseline(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = Q.read(spark, os.path.join(args.data, "questions.txt")).select(F.lit(0).cast("long").alias("doc_id"), "text")
    blocks = Q.required(Q.baseline(docs)).withColumn("fmt", F.lit("numbered"))
    write_file(answering.A.document(blocks), args.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    S.load_env()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s [%(levelname)s] %(message)s")
    parser = argparse.ArgumentParser(prog="loomspan")
    parser.add_argument("command", choices=["answer", "evaluate", "check", "baseline"])
    parser.add_argument("--data", default="data", help="folder with the TeX sources and questions.txt")
    parser.add_argument("--out", default="output/answers.txt")
    parser.add_argument("--work", default=".cache", help="folder of stored tables")
    parser.add_argument("--reports", default="eval/reports")
    parser.add_argument("--mode", choices=["retrieval", "synthetic", "self-check", "all"], default="all")
    parser.add_argument("--seconds", type=float, default=S.TOTAL_S)
    for name in ("planner", "chat", "vision", "embedder"):
        parser.add_argument(f"--{name}", help="module:function", default=os.environ.get(f"LOOMSPAN_{name.upper()}"))
    args = parser.parse_args(argv)
    return {"answer": run_answer, "evaluate": run_evaluate, "check": run_check, "baseline": run_baseline}[args.command](session(), args)


if __name__ == "__main__":
    sys.exit(main())
