"""Hand-written fixtures: expectations derived by hand from the rules."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.functions import vectors as V
from loomspan.operators import answers, chunks, latex, providers, qa_cache, retrieval, structure
from loomspan.plans import ingest
from loomspan.sources import files, questions
from loomspan.sources.store import Store


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()[0]


def parse(spark, text):
    return structure.parse(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def test_comments(spark):
    assert one(spark, "50\\% a % b\r\nc%\n", latex.strip_comments) == "50\\% a \nc"


def test_iffalse_and_bibliography(spark):
    assert one(spark, "a\\iffalse x\n\\fi b", latex.remove_iffalse) == "a b"
    assert one(spark, "a\\begin{thebibliography}\nx\\end{thebibliography}b", latex.remove_bibliography) == "ab"


@pytest.mark.parametrize(("text", "want"), [("\\textbf{a \\ref{x}}", "a \\ref{x}"), ("\\frac{a}{b}", "a{b}"), ("\\citep{k} \\cite{k}", "k \\cite{k}"), ("\\section*{A}", "\\section*{A}")])
def test_wrappers(spark, text, want):
    assert one(spark, text, latex.strip_wrappers) == want


def test_blank_lines():
    got = latex.collapse_blank_lines(pd.Series(["a \n\n\n\n\nb\n\\begin{align}\n\n\n\n\\end{align}", None]))
    assert got[0] == "a\n\n\nb\n\\begin{align}\n\n\n\n\\end{align}" and got[1] is None


def test_macros_last_and_first(spark):
    body = "x" * 20_000
    df = spark.createDataFrame([(1, "\\newcommand{\\a}{one}\\renewcommand{\\a}{two}\\newcommand{\\b}{" + body + "}")], "doc_id long, text string")
    got = {r["name"]: r for r in latex.glossary(latex.macros(df)).collect()}
    assert (got["a"]["last"], got["a"]["first_plain"], got["b"]["last"]) == ("two", "one", body)


def test_inputs_cycles_and_repeats(spark):
    rows = [(1, "main.tex", "A\\input{sub/b}\\input{sub/b}C\\include{none}"), (1, "sub/b.tex", "[\\input{c}\\input{main}]"), (1, "sub/c.tex", "c")]
    got = latex.expand_inputs(spark.createDataFrame(rows, "doc_id long, path string, text string"), spark.createDataFrame([(1, "main.tex")], "doc_id long, entry string"))
    assert got.first()["text"] == "A[c]C"


def test_section_numbers_collide_and_spans_stop_at_children(spark):
    r = parse(spark, "pre\\subsection{A}x\\section{B}\\label{s:b}y\\paragraph{C}z")
    s = r["sections"]
    assert [(x["number"], x["title"], x["parent_number"], x["label"]) for x in s] == [("1", "A", None, None), ("1", "B", None, "s:b"), ("1.1", "C", None, None)]
    assert s[0]["char_start"] == 3 and [x["char_end"] for x in s][:2] == [x["char_start"] for x in s][1:] and s[-1]["char_end"] == len(r["text"])


def test_label_window_is_cut_at_an_environment(spark):
    r = parse(spark, "\\section{A}\\begin{equation}\\label{e}x\\end{equation}")
    assert r["sections"][0]["label"] is None and r["equations"][0]["label"] == "e"


def test_no_heading(spark):
    assert [(x["number"], x["title"], x["char_end"]) for x in parse(spark, "abc")["sections"]] == [("0", "(document)", 3)]


@pytest.mark.parametrize(("gap", "want"), [(3999, 1), (4000, 2)])
def test_stray_figures(spark, gap, want):
    env = "\\begin{figure}\\includegraphics{a}\\caption{x {y} z}\\end{figure}"
    r = parse(spark, env + "-" * (gap - len(env)) + "\\includegraphics{b}")
    assert len(r["figures"]) == want and r["figures"][0]["caption"] == "x {y} z" and r["figures"][0]["label"] == "fig:auto-1"


def test_one_equation_an_environment(spark):
    r = parse(spark, "\\begin{align*}a\\label{p}\\\\b\\label{q}\\end{align*}\\begin{gather}c\\end{gather}")
    assert [e["label"] for e in r["equations"]] == ["p", "eq:auto-1"]


def test_references_first_seen_once(spark):
    r = structure.referenced_by(structure.parse(spark.createDataFrame([(1, "\\section{A}\\ref{a}\\ref{a}\\section{B}\\ref{a}\\ref{b,c}")], "doc_id long, text string")))
    assert {x["label"]: x["sections"] for x in r.collect()} == {"a": ["1", "2"], "b,c": ["2"]}


def test_keywords_and_authors(spark):
    assert one(spark, "n=3 \\texttt{foo} \\verb|b r| 7 1.5 42% x9", structure.keywords) == ["n=3", "foo", "b r", "1.5", "42%"]
    assert one(spark, "Ann\\thanks{x} B, \\and \\textbf{Carl}\nDee", structure.authors) == ["Ann B", "Carl", "Dee"]


def test_splitter_covers_and_bounds():
    text = "\\section{A}\n" + "".join(f"w{i} " for i in range(900)) + "\n\n" + "".join(f"{i:05d}" for i in range(700))
    pieces = chunks.split_text(text)
    assert all(len(p) <= chunks.SIZE for p in pieces) and all(p in text for p in pieces)
    at = 0
    for p in pieces:
        k = text.find(p)
        assert 0 <= k <= at
        at = max(at, k + len(p))
    assert at == len(text)


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], []), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0, 1.0]


def chunk_rows(spark, sims):
    rows = [(f"c{i}", "body", s, s.split(".")[0], False, [], [], [x, (1 - x * x) ** 0.5]) for i, (s, x) in enumerate(sims)]
    return spark.createDataFrame(rows, "chunk_id string, kind string, section_number string, section_top string, has_figure boolean, figure_refs array<string>, equation_refs array<string>, embedding array<double>")


@pytest.mark.parametrize(("sims", "fallback", "n"), [([("1", 0.46), ("1.1", 0.47), ("1.2", 0.48), ("1.3", 0.44)], False, 3), ([("1", 0.46), ("1.1", 0.47), ("1.1", 0.5), ("2", 0.9)], True, 3)])
def test_retrieve_threshold_dedup_fallback(spark, sims, fallback, n):
    plan = spark.createDataFrame([(1, [1.0, 0.0], ["1"], False, None)], "question_id long, embedding array<double>, scope array<string>, is_figure boolean, target_label string")
    got = retrieval.retrieve(chunk_rows(spark, sims), plan).collect()
    assert len(got) == n and {r["fallback_used"] for r in got} == {fallback}


def test_cache_exact_before_semantic(spark):
    entries = spark.createDataFrame([(1, "What, is it?", [1.0, 0.0]), (2, "what is it", [0.0, 1.0])], "entry_id long, question string, embedding array<double>")
    asked = spark.createDataFrame([(1, " WHAT is it ", [0.0, 1.0]), (2, "other", [0.1, 1.0]), (3, "third", [1.0, 1.0])], "question_id long, question string, embedding array<double>")
    got = {r["question_id"]: (r["entry_id"], r["how"]) for r in qa_cache.lookup(asked, entries).collect()}
    assert got == {1: (1, "exact"), 2: (2, "semantic"), 3: (None, "miss")}


@pytest.mark.parametrize(("reply", "want"), [('```json\n{"title_hint": "a"}\n```', '{"title_hint": "a"}'), ('{"a": 1', None), (None, None)])
def test_json_salvage(spark, reply, want):
    assert spark.createDataFrame([(reply,)], "text string").select(T.salvage_json(F.col("text"))).first()[0] == want


def test_refusal_script_note(spark):
    assert one(spark, ' "No Answer." ', T.is_no_answer) and one(spark, "", T.is_no_answer) and not one(spark, "yes", T.is_no_answer)
    assert one(spark, "это", T.has_cyrillic)
    noted = one(spark, "x", answers.with_note)
    assert one(spark, noted, answers.with_note) == noted


def test_question_modes(spark):
    df = spark.createDataFrame([(1, "## Question 2\nA\nB\n## question 5\nC"), (2, "x\n1. A\n\nmore\n2) B\n2.1 no")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["slot"], r["idx"], r["text"], r["fmt"]) for r in questions.load(df).collect())
    assert got == [(1, 1, 2, "A\nB", "markdown"), (1, 2, 5, "C", "markdown"), (2, 1, 1, "A\nmore", "numbered"), (2, 2, 2, "B\n2.1 no", "numbered")]


def test_fingerprint_bytes(spark):
    import hashlib

    df = spark.createDataFrame([(1, "b.tex", b"\xff"), (1, "a.tex", b"x")], "doc_id long, path string, content binary")
    assert files.fingerprint(df).first()["fingerprint"] == hashlib.sha256(b"v1\0a.tex\0x\0b.tex\0\xff\0").hexdigest()[:16]


def test_embedding_ladder(spark):
    def service(texts):
        if any(len(t) > 500 for t in texts):
            raise ValueError("too large")
        return [[float(len(t)), 0.0] for t in texts]

    df = spark.createDataFrame([(1, "a" * 3000), (2, "b")], "id long, text string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in providers.embed(df, "text", service, size=2, sleep=lambda s: None).collect()}
    assert got == {1: [400.0, 0.0], 2: [1.0, 0.0]}


def test_ingest_and_reuse(spark, tmp_path):
    tex = "\\documentclass{a}\\title{T}\\newcommand{\\x}{model}\\begin{document}\\section{A}\\label{s}The \\x{} works. % no\n\\input{b}\\end{document}"
    rows = [(1, "main.tex", tex.encode()), (1, "b.tex", b"\\subsection{B}See \\ref{s}. \\begin{figure}\\includegraphics{p}\\caption{C}\\label{f}\\end{figure}"), (1, "p.png", b"")]
    df = spark.createDataFrame(rows, "doc_id long, path string, content binary")
    store = Store(spark, str(tmp_path / "store"))
    first = ingest.ingest(df, store)
    kinds = {r["kind"]: r["n"] for r in first.chunks.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"body": 2, "caption": 1, "figure_desc": 1} and not first.reused
    assert first.figures.first()["resolved_path"] == "p.png" and "The model works." in first.structure.first()["text"].replace("{}", "")
    assert "**1.1 B**" in first.maps.first()["map"]
    assert ingest.ingest(df, store).reused


def test_stream_answers_each_question_once(spark, tmp_path):
    import json

    from loomspan.streaming import feed

    (tmp_path / "in").mkdir()
    row = {"question_id": 1, "doc_id": 1, "slot": 1, "question": "q", "asked_at": "2024-01-01T00:00:00Z"}
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(r) for r in (row, row, row | {"question_id": 2})))
    stream = feed.questions(spark, str(tmp_path / "in"))
    feed.answered(stream, lambda b: b.select("question_id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["question_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
