"""Ingest of what has changed, articles in folders, and vectors that are kept."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import providers
from loomspan.plans import ingest
from loomspan.sources import files as files_
from loomspan.sources import store

FILES = "doc_id long, path string, content binary"


def article(i, words="Words", figure=True):
    shown = "\\begin{figure}\\includegraphics{p}\\caption{Cap}\\label{f}\\end{figure}" if figure else ""
    tex = f"\\documentclass{{a}}\\newcommand{{\\x}}{{model}}\\begin{{document}}\\section{{Part {i}}}\\label{{s}}{words} of article {i}.{shown}\\section{{End}}Done.\\end{{document}}"
    return [(i, "main.tex", bytearray(tex.encode())), (i, "p.png", bytearray(b"img"))]


def frame(spark, *articles):
    return spark.createDataFrame([r for a in articles for r in a], FILES)


def stored(s):
    return {n: sorted(map(str, s.load(n).collect())) for n in ingest.ENTITIES}


@pytest.fixture
def parsed(monkeypatch):
    """Ids of the documents that each run reads."""
    seen, real = [], ingest.sources

    def counting(files):
        seen.append(sorted(r[0] for r in files.select("doc_id").distinct().collect()))
        return real(files)

    monkeypatch.setattr(ingest, "sources", counting)
    return seen


def test_only_changed_documents_are_parsed(spark, tmp_path, parsed):
    s = store.Store(spark, f"file://{tmp_path}/s")
    one = frame(spark, article(1), article(2), article(3), article(4))
    art = ingest.ingest(one, s)
    assert art.counts == {"new": 4} and not art.reused and parsed == [[1, 2, 3, 4]]
    art = ingest.ingest(one, s)
    assert art.reused and art.counts == {"same": 4} and len(parsed) == 1
    # 2 changes, 3 goes, 5 comes; 1 and 4 stay
    two = frame(spark, article(1), article(2, "Other words", figure=False), article(4), article(5))
    art = ingest.ingest(two, s)
    assert art.counts == {"same": 2, "changed": 1, "new": 1, "deleted": 1} and parsed[1:] == [[2, 5]]
    whole = store.Store(spark, f"file://{tmp_path}/whole")
    ingest.ingest(two, whole)
    assert stored(s) == stored(whole)
    assert {r["doc_id"] for r in art.figures.select("doc_id").collect()} == {1, 4, 5}
    # nothing but deletions
    three = frame(spark, article(4))
    assert ingest.ingest(three, s).counts == {"same": 1, "deleted": 3} and {r["doc_id"] for r in s.load("chunks").collect()} == {4}


def test_a_broken_run_is_taken_up_again(spark, tmp_path, parsed, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/s")
    ingest.ingest(frame(spark, article(1), article(2)), s)
    monkeypatch.setattr(ingest.digest, "article_map", lambda *a: 1 / 0)
    two = frame(spark, article(1, "New"), article(2))
    with pytest.raises(ZeroDivisionError):
        ingest.ingest(two, s)
    monkeypatch.undo()
    assert ingest.ingest(two, s).counts == {"same": 1, "changed": 1}
    whole = store.Store(spark, f"file://{tmp_path}/whole")
    ingest.ingest(two, whole)
    assert stored(s) == stored(whole)


def test_the_print_of_one_file_needs_no_group(spark):
    df = spark.createDataFrame([(1, "main.tex", bytearray(b"abc")), (2, "ü/x.tex", bytearray("é\x00".encode())), (3, "a", bytearray(b""))], FILES)
    want = {r["doc_id"]: r["fingerprint"] for r in files_.fingerprint(df).collect()}
    assert {r[0]: r[1] for r in df.select("doc_id", files_.fingerprint_of_one(F.col("path"), F.col("content"))).collect()} == want


def test_many_articles_from_folders(spark, tmp_path):
    for name, inner in (("alpha", "tex source/"), ("beta", "deep/er/"), ("gamma", "")):
        for _, path, content in article(len(name)):
            f = tmp_path / "in" / name / inner / path
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_bytes(content)
    (tmp_path / "in/none").mkdir()
    (tmp_path / "in/none/readme.txt").write_text("no TeX here")
    (tmp_path / "in/loose.tex").write_text("not in an article")
    rows = ingest.read_articles(spark, str(tmp_path / "in"))
    got = {(r["article"], r["path"]) for r in rows.collect()}
    # of folders with as many .tex files below them the shallower is the root
    assert got == {(a, f) for a, f in (("alpha", ""), ("beta", "deep/er/"), ("gamma", "")) for f in (f + "main.tex", f + "p.png")}
    art = ingest.ingest(rows.drop("article"), store.Store(spark, f"file://{tmp_path}/s"))
    assert art.counts == {"new": 3} and art.structure.count() == 3 and art.figures.where("resolved_path like '%p.png'").count() == 3


def test_a_text_is_sent_to_the_service_once(spark, tmp_path):
    log = tmp_path / "log"
    log.touch()

    def service(texts, log=str(log)):
        with open(log, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    memo = store.Store(spark, f"file://{tmp_path}/s").keyed("vectors", ["key"])
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "c" * 1500 + "x"), (6, "c" * 1500 + "y")], "i long, text string")
    sent = lambda: sorted(log.read_text().split("\n")[:-1])
    run = lambda df, model="m": {r["i"]: r["embedding"] for r in providers.embed_kept(df, "text", service, memo, model).collect()}
    got = run(rows)
    assert got == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0], 4: [0.0, 1.0], 5: [1500.0, 1.0], 6: [1500.0, 1.0]}
    assert sent() == sorted(["a", "bb", "", "c" * 1500])
    assert run(rows) == got and len(sent()) == 4  # the second run asks for nothing
    assert run(rows.withColumn("text", F.when(F.col("i") == 2, "dd").otherwise(F.col("text"))))[2] == [2.0, 1.0] and len(sent()) == 5 and "dd" in sent()
    assert len(run(rows, "other")) == 6 and len(sent()) == 9  # another model has other vectors
    assert providers.embed_kept(rows, "text", None, memo, "m").count() == 6
