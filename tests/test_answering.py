"""Services, the answering flow, stored entities, evaluation and the command line, with services that are plain functions."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from loomspan import __main__ as cli
from loomspan.operators import answers, evaluation, providers, retrieval
from loomspan.operators import services as S
from loomspan.plans import answering, ingest
from loomspan.sources import files, store

# ------------------------------------------------------------------ services


def test_timed_calls():
    assert S.timed(lambda x: x + 1, 5, 1) == 2
    began = time.time()
    with pytest.raises(TimeoutError):
        S.timed(time.sleep, 0.1, 5)
    assert time.time() - began < 2
    with pytest.raises(ZeroDivisionError):
        S.timed(lambda: 1 / 0, 5)


def test_deadline_and_measured():
    assert S.Deadline.after(-1).expired() and S.Deadline.after(-1).remaining == 0 and not S.Deadline.after(60).expired(10) and S.Deadline.after(60).expired(70)
    took = {}
    with pytest.raises(ValueError), S.measured("a", took):
        raise ValueError
    assert took["a"] >= 0


def test_load_env(tmp_path):
    (tmp_path / ".env").write_text("﻿# note\nexport A=1\nB = 'two words'\nC=\"x\"\nD=kept\nbroken\n=x\n")
    into = {"D": "mine"}
    assert S.load_env(str(tmp_path / ".env"), into) == 3 and into == {"A": "1", "B": "two words", "C": "x", "D": "mine"}
    assert S.load_env(str(tmp_path / "none"), into) == 0


def echo(prompt):
    if "fail" in prompt:
        raise RuntimeError("no")
    return f"  {prompt.upper()} "


def test_ask_and_deadlines(spark):
    df = spark.createDataFrame([(1, "a"), (2, "fail"), (3, None)], "id long, t string")
    got = {r["id"]: r["reply"] for r in S.ask(df, F.col("t"), echo, 5).collect()}
    assert got == {1: "A", 2: None, 3: None}
    assert {r["reply"] for r in S.ask(df, F.col("t"), echo, 5, S.Deadline.after(3)).collect()} == {None}


def test_image_messages(spark):
    def seen(message):
        return message[0]["text"] + "|" + message[1]["image_url"]["url"]

    df = spark.createDataFrame([(1, bytearray(b"\x01\x02")), (2, None)], "id long, image binary")
    got = {r["id"]: r["reply"] for r in S.ask_about_images(df, F.lit("look"), "image", seen).collect()}
    assert got == {1: "look|data:image/png;base64,AQI=", 2: None}


def test_filled_prompts(spark):
    df = spark.createDataFrame([("x {b}", None, 3)], "a string, b string, c int")
    assert df.select(providers.filled('{"k": {a}{b}} {c} {d}', a=F.col("a"), b=F.col("b"), c=F.col("c"))).first()[0] == '{"k": x {b}} 3 {d}'
    assert answers.fill("{a} {b} {c}", a="{b}", b="x") == "{b} x {c}"


def test_embedding_retries_and_zero_vector(spark):
    calls = []

    def flaky(texts):
        calls.append(1)
        if any("huge" in t for t in texts):
            raise ValueError("request too large")
        if len(calls) % 2:
            raise OSError("busy")
        return [[1.0] for _ in texts]

    df = spark.createDataFrame([(1, "ok"), (2, "huge")], "id long, text string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in providers.embed(df, "text", flaky, size=1, sleep=lambda s: None).collect()}
    assert got == {1: [1.0], 2: [0.0]}


def test_questions_without_a_vector_find_nothing(spark, article):
    def broken(texts):
        raise OSError("down")

    asked = spark.createDataFrame([(1, 1, 1, 1, "What is alpha?")], "question_id long, doc_id long, slot int, idx int, question string")
    chunks, sections = article
    r = answering.answer(asked, chunks, sections, services=answering.Services(embedder=broken, size=2)).first()
    assert r["embedding"] == [] and r["doc_ids"] == [] and r["answer"].startswith("no answer")


# ------------------------------------------------------------------ sources and stored entities


def test_tex_root_and_paths(spark):
    rows = [(1, "a/x.tex"), (1, "a/b/y.tex"), (1, "p/tex_source/q/z.tex"), (1, "p/tex_source/pic.png"), (2, "a/x.tex"), (2, "a/y.tex"), (2, "m.txt"), (3, "z.tex")]
    df = spark.createDataFrame([(i, p, b"") for i, p in rows], "doc_id long, path string, content binary")
    roots = files.tex_root(df)
    assert {r["doc_id"]: r["root"] for r in roots.collect()} == {1: "p/tex_source", 2: "", 3: ""}
    got = sorted((r["doc_id"], r["path"]) for r in files.under_root(df, roots).collect())
    assert got == [(1, "pic.png"), (1, "q/z.tex"), (2, "a/x.tex"), (2, "a/y.tex"), (2, "m.txt"), (3, "z.tex")]


def test_listing_and_decoding(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.tex").write_bytes(b"\xef\xbb\xbfe\xcc\x81\xff")
    (tmp_path / "b.txt").write_text("x")
    rows = files.listing(spark, str(tmp_path), "*.tex").select("path", files.decode("content").alias("t")).collect()
    assert len(rows) == 1 and rows[0]["path"].endswith("sub/a.tex") and rows[0]["t"] == "é�"


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    assert not s.has("t") and s.load("t") is None and not s.non_empty("t")
    s.save("t", one)
    s.save("t", s.load("t").withColumn("v", F.lit("b")))  # read from what it replaces
    assert [tuple(r) for r in s.load("t").collect()] == [(1, "b")] and s.non_empty("t")
    s.upsert("t", spark.createDataFrame([(1, "c"), (2, "d")], "k long, v string"), ["k"])
    assert sorted(tuple(r) for r in s.load("t").collect()) == [(1, "c"), (2, "d")]
    s.append("t", spark.createDataFrame([(3, "e")], "k long, v string"))
    assert s.load("t").count() == 3
    with pytest.raises(Exception):  # noqa: B017  whatever Spark raises
        s.save("t", s.load("t").select(F.raise_error(F.lit("broken"))))
    assert s.load("t").count() == 3
    assert len([x for x in os.listdir(tmp_path / "s/t") if x.startswith("v-")]) <= 2


def test_manifest_that_cannot_be_read_is_none(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    prints = spark.createDataFrame([(1, "ab")], "doc_id long, fingerprint string")
    s.save("manifest", spark.createDataFrame([("x",)], "other string"))
    assert not s.fresh(prints, [], 1)
    s.save("manifest", prints.withColumn("version", F.lit(1)))
    assert s.fresh(prints, [], 1) and not s.fresh(prints, [], 2) and not s.fresh(prints, ["more"], 1) and not s.fresh(prints.where("false"), [], 1)


def test_cache_reader_defaults(spark, tmp_path):
    lines = [{"question": "Q?", "question_norm": "q", "answer": "a", "plan": {"x": 1}}, {"question": "no norm", "answer": "b"}, {"question": "R", "question_norm": "r", "answer": "c", "question_embedding": [1.0], "doc_ids": ["d"], "ts": 2.0, "source": "s", "doc_id": 4}]
    (tmp_path / "qa.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    rows = {r["question"]: r for r in store.read_entries(spark, str(tmp_path / "qa.jsonl")).collect()}
    assert set(rows) == {"Q?", "R"} and rows["Q?"]["plan"] == '{"x":1}' and rows["Q?"]["source"] == "fresh" and rows["Q?"]["ts"] == 0.0 and rows["Q?"]["doc_id"] == 0
    assert (rows["R"]["doc_ids"], rows["R"]["question_embedding"], rows["R"]["doc_id"]) == (["d"], [1.0], 4)


# ------------------------------------------------------------------ retrieval


def test_retrieval_streams_as_it_ranks_in_one(spark):
    """Many chunks in many batches and blocks of questions give the rows that a plain sort gives."""
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 8))
    v[100:120] = v[7]  # ties
    rows = [(f"c{k:04}", "body", str(k % 5), str(k % 5), False, [], [], v[k].tolist() if k != 11 else [1.0]) for k in range(600)]
    chunks = spark.createDataFrame(rows, "chunk_id string, kind string, section_number string, section_top string, has_figure boolean, figure_refs array<string>, equation_refs array<string>, embedding array<double>").repartition(2)
    q = np.vstack([v[7], v[3], np.zeros(8), rng.normal(size=8)])
    plans = spark.createDataFrame([(k, q[k].tolist(), ["2"] if k == 3 else None, False, None) for k in range(4)], "question_id long, embedding array<double>, scope array<string>, is_figure boolean, target_label string")
    before, retrieval.QUESTION_BLOCK = retrieval.QUESTION_BLOCK, 2
    try:
        got = sorted((r["question_id"], r["rank"], r["chunk_id"], round(r["sim"], 9)) for r in retrieval.top_k(chunks, plans, 15, "scoped").collect())
    finally:
        retrieval.QUESTION_BLOCK = before
    want = []
    for k in range(4):
        own = [(max(0.0, float(v[j] @ q[k] / np.linalg.norm(v[j]) / np.linalg.norm(q[k]))) if q[k].any() and j != 11 else 0.0, rows[j][0]) for j in range(600) if k != 3 or j % 5 == 2]
        for rank, (sim, name) in enumerate(sorted(own, key=lambda x: (-round(x[0], 12), x[1]))[:15], 1):
            want.append((k, rank, name, round(sim, 9)))
    assert got == sorted(want)


# ------------------------------------------------------------------ answers


def planner(prompt):
    if "Cyrillic" in prompt or "earlier" in prompt:
        return "no plan"
    if "picture" in prompt:
        return '```json\n{"section_scope": ["1"], "is_figure_question": true, "target_label": "f", "needs_vision": true, "reasoning": "r"}\n```'
    return '{"section_scope": ["§1", "9"]}'


def chat(prompt):
    if "Translate" in prompt:
        return "It is translated."
    if "Retrieval found no answer" in prompt:
        return "Guessed after " + ("an answer." if "Answer 1: " in prompt else "nothing.")
    if "Cyrillic" in prompt:
        return "Это ответ." if "whole article" in prompt else "first pass"
    if "earlier" in prompt:
        return "No answer."
    return "Seen: " + ("red" if "Visual answer for f: it is red" in prompt else "plain")


@pytest.fixture(scope="module")
def article(spark):
    text = "\\section{Alpha}\\label{s}Words about alpha things. \\begin{figure}\\includegraphics{p}\\caption{Cap}\\label{f}\\end{figure}\\section{Beta}Words about beta."
    from loomspan.operators import chunks as C
    from loomspan.operators import structure

    p = structure.parse(spark.createDataFrame([(1, text), (2, "\\section{Alpha}Other words.")], "doc_id long, text string"), parts=C.PARTS)
    chunks = C.all_chunks(p).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    sections = p.select("doc_id", F.inline("sections")).select("doc_id", "number", "title")
    return chunks, sections


def ask_all(spark, article, **more):
    questions = [(1, 1, 1, 1, "What is alpha?"), (2, 1, 2, 2, "Show the picture"), (3, 1, 3, 3, "Say it in Cyrillic"), (4, 1, 4, 4, "What did you say earlier?"), (5, 2, 1, 1, "What is alpha?")]
    df = spark.createDataFrame(questions, "question_id long, doc_id long, slot int, idx int, question string")
    images = spark.createDataFrame([(1, "f", "Cap", bytearray(b"png"))], "doc_id long, label string, caption string, image binary")
    chunks, sections = article
    services = answering.Services(planner, chat, lambda message: "it is red", lambda texts: [[1.0, 0.0] for _ in texts], 2)
    return df, {r["question_id"]: r for r in answering.answer(df, chunks, sections, images=images, services=services, **more).collect()}


def test_answers_go_all_the_way(spark, article):
    _, got = ask_all(spark, article)
    assert got[1]["answer"] == "Seen: plain" and not got[1]["deferred"] and json.loads(got[1]["plan"])["section_scope"] == ["1"] and got[1]["doc_ids"]
    assert got[2]["answer"] == "Seen: red" and "visual:f" in got[2]["doc_ids"]
    assert got[3]["answer"] == "It is translated." and got[3]["deferred"]
    assert got[4]["answer"] == f"Guessed after an answer.\n\n{answers.NOTE}" and got[4]["fallback_used"]
    assert all(not c.startswith("body:2") for c in got[5]["doc_ids"]) and got[5]["answer"] == "Seen: plain"


def test_past_the_deadline_questions_keep_the_refusal(spark, article):
    _, got = ask_all(spark, article, deadline=S.Deadline.after(1))
    assert {r["answer"] for r in got.values()} == {f"no answer\n\n{answers.NOTE}"} and got[3]["how"] == "stub"


def test_answers_are_kept_and_found_again(spark, article, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert answering.kept(s) is None
    asked, _ = ask_all(spark, article)
    chunks, sections = article
    first = answering.materialize(answering.answer(asked, chunks, sections), "first")
    answering.keep(s, first)
    second = answering.answer(asked.withColumn("question", F.concat(F.lit(" "), F.upper("question"))), chunks, sections, entries=answering.kept(s))
    was = {r["question_id"]: r["answer"] for r in first.collect()}
    assert {(r["how"], r["answer"] == was[r["question_id"]]) for r in second.collect()} == {("exact", True)}
    answering.keep(s, second)
    assert s.load("qa").count() == first.count()


def test_answer_files_have_stubs(spark):
    asked = spark.createDataFrame([(1, 1, 1, 4, "markdown"), (2, 1, 2, 7, "markdown"), (3, 2, 1, 1, "numbered")], "question_id long, doc_id long, slot int, idx int, fmt string")
    done = spark.createDataFrame([(2, "yes")], "question_id long, answer string")
    got = {r["doc_id"]: r["text"] for r in answering.answer_file(asked, done).collect()}
    assert got == {1: "## Answer 4\nno answer\n\n## Answer 7\nyes\n", 2: "1. no answer\n"}
    assert answering.answer_file(asked).count() == 2


# ------------------------------------------------------------------ ingest with services


def test_summaries_and_descriptions(spark):
    from loomspan.operators import structure

    text = "\\section{A}" + "word " * 60 + "\\section{B}short\\begin{figure}\\includegraphics{p}\\caption{C}\\label{f}\\end{figure}"
    p = structure.parse(spark.createDataFrame([(1, text)], "doc_id long, text string"), parts=(*structure.WHOLE, "bodies", "surroundings"))
    got = providers.summaries(p, lambda prompt: '{"title_hint": "h", "dense_summary": " d "}').collect()
    assert [(r["number"], r["title_hint"], r["dense_summary"]) for r in got] == [("1", "h", "d")] and providers.summaries(p).count() == 0
    raw = p.select("doc_id", F.inline(F.arrays_zip(F.col("figures").alias("f"), F.col("surroundings").alias("s")))).select("doc_id", "f.label", "f.tex_path", "f.caption", "f.char_pos", F.col("f.section_title").alias("section_path"), "s.*")
    images = spark.createDataFrame([(1, "f", bytearray(b"x"))], "doc_id long, label string, image binary")
    say = lambda reply: providers.describe(raw, images, lambda m: reply).first()
    assert say('{"subject": "s", "numbers_visible": ["1"]}')["description_text"] == "Caption: C | subject: s | numbers_visible: 1" and say("{}") is not None
    assert say("nothing")["description_text"].startswith("Caption: C | Context: ") and not say("nothing")["seen"]
    assert "image not available" in providers.describe(raw).first()["description_text"] and raw.first()["section_path"] == "2 B"


def test_ingest_builds_images_and_glossary(spark, tmp_path):
    tex = "\\documentclass{a}\\newcommand{\\x}{model}\\begin{document}\\section{A}The \\x. \\begin{figure}\\includegraphics{p}\\caption{C}\\label{f}\\end{figure}\\end{document}"
    df = spark.createDataFrame([(1, "main.tex", bytearray(tex.encode())), (1, "p.png", bytearray(b"img"))], "doc_id long, path string, content binary")
    art = ingest.ingest(df, store.Store(spark, str(tmp_path / "s")), vision=lambda m: '{"subject": "seen"}')
    assert art.images.first()["kind"] == "image/png" and "seen" in art.figures.first()["description_text"] and art.figures.first()["resolved_path"] == "p.png"
    assert "## Defined Macros\n- `\\x` → `model`" in art.maps.first()["map"] and {"structure_s", "ingest_s"} <= set(art.timings)


# ------------------------------------------------------------------ evaluation


def test_validate_files(spark):
    md, plain = "## Question 1\nA\n## Question 2\nB\n", "one\n\ntwo\n"
    rows = [
        (1, md, "## Answer 1\nx\n## Answer 2\ny", None), (2, md, "1. x\n2. y", "formats differ"), (3, md, "hi\n## Answer 1\nx\n## Answer 2\ny", "text before the first answer"), (4, md, "## Answer 1\n\n## Answer 2\ny", "empty answer"),
        (5, md, "## Answer 1\nx", "number of answers"), (6, plain, "1. x\nmore 2.1\n2) y", None), (7, plain, "intro\n1. x\n2. y", "text before the first answer"), (8, plain, "1. x", "number of answers"),
        (9, plain, " \n", "no answers"), (10, plain, "## Answer 1\nx", "formats differ"), (11, None, "1. x", "no questions"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, questions string, answers string")
    assert {r["doc_id"]: r["problem"] for r in evaluation.validate_files(df).collect()} == {r[0]: r[3] for r in rows}


def test_synthetic_items_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(f"body:{k}", "body", f"text {k}", str(k)) for k in range(30)], "chunk_id string, kind string, text string, section_number string")
    shown = spark.createDataFrame([("f", "cap", "desc"), ("g", "skip", "desc")], "label string, caption string, description_text string")

    def make(prompt):
        return "nothing" if "skip" in prompt else json.dumps({"q": prompt.split("Text: ")[-1].strip()[:20] if "Text: " in prompt else "pic", "a": "x"})

    items = evaluation.synthetic(chunks, shown, make)
    items.write.json(str(tmp_path / "items"))
    (tmp_path / "items/part-x.json").write_text('{"q": broken\n{"a": "no q"}\n')
    got = evaluation.read_items(spark, str(tmp_path / "items")).collect()
    assert sum(r["kind"] == "factual" for r in got) == 20 and [r["target_figure"] for r in got if r["kind"] == "figure"] == ["f"]
    assert all(r["q"] == f"text {r['target_section']}" for r in got if r["kind"] == "factual")


def test_self_check_with_judge(spark):
    df = spark.createDataFrame([(1, "1. See §2 and fig:a.\n2. no answer"), (2, "## Answer 1\nText\n")], "doc_id long, answers string")
    given = evaluation.answers_of(df)
    assert sorted((r["doc_id"], r["slot"], r["answer"]) for r in given.collect()) == [(1, 1, "See §2 and fig:a."), (1, 2, "no answer"), (2, 1, "Text")]
    scores = evaluation.judged(given.withColumns({"question": F.lit("q"), "map": F.lit("m")}), lambda p: '{"relevance": 2, "specificity": 1}' if "Text" in p else "?")
    r = evaluation.self_check(given, scores).first()
    assert (r["n_answers"], r["refusal_rate"], r["grounding_density_mean"], r["judge_relevance"], r["judge_consistency"]) == (3, 0.333, 0.67, 2.0, 0.0)


def test_sizes_and_ranks(spark):
    values = [5, 1, 1, 9, 7, 7, 7, 2]
    df = spark.createDataFrame([(k % 2, "body", "x" * v, v) for k, v in enumerate(values)], "doc_id long, kind string, text string, v int")
    for p in (0.0, 0.5, 0.95, 1.0):
        assert evaluation.floor_rank_of(df, "v", p).first()["value"] == sorted(values)[int(p * 7)]
    assert evaluation.floor_rank_of(df.where("false"), "v", 0.5).first()["value"] == 0
    got = {r["doc_id"]: (r["n_chunks"], r["p50"], r["p95"]) for r in evaluation.chunk_sizes(df).collect()}
    assert got == {0: (4, 6, 7), 1: (4, 4, 7)}
    assert evaluation.resolution_rate(spark.createDataFrame([("a",), (None,), (None,)], "resolved_path string")).first()[0] == 0.333


# ------------------------------------------------------------------ command line and stream


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    data = tmp_path / "data"
    (data / "tex source").mkdir(parents=True)
    (data / "tex source/main.tex").write_text("\\documentclass{a}\\begin{document}\\section{Alpha}Alpha things matter here.\\section{Beta}Beta too.\\end{document}")
    (data / "questions.txt").write_text("## Question 1\nWhich things matter here.\n\n## Question 2\nAnd beta?\n")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "session", lambda: spark)
    out = str(tmp_path / "out/answers.txt")
    run = lambda *a: cli.main([a[0], "--data", str(data), "--out", out, "--work", str(tmp_path / "work"), *a[1:]])
    assert run("answer") == 0
    text = open(out).read()
    assert text.startswith("## Answer 1\n") and "\n\n## Answer 2\n" in text and "Alpha things matter here." in text
    assert run("check") == 0 and run("answer") == 0
    assert run("evaluate") == 0 and "section_coverage" in capsys.readouterr().out and os.path.isfile("eval/reports/report.md")
    assert run("baseline") == 0 and open(out).read().startswith("1. ")
    assert run("check") == 1
    (data / "tex source/main.tex").unlink()
    assert run("answer", "--work", str(tmp_path / "other")) == 1 and open(out).read() == "## Answer 1\nno answer\n\n## Answer 2\nno answer\n"


def test_questions_asked_by_hour(spark, tmp_path):
    from loomspan.streaming import feed

    (tmp_path / "in").mkdir()
    rows = [{"question_id": k, "doc_id": 1, "slot": 1, "question": "q", "asked_at": f"2024-01-01T0{k}:10:00Z"} for k in (0, 0, 1, 3)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = feed.asked_by_hour(feed.questions(spark, str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [r["n"] for r in spark.table("hours").orderBy("window").collect()] == [1, 1, 1]
