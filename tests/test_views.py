"""Small views of stored entities."""

from pyspark.sql import functions as F

from loomspan.operators import answers, chunks, evaluation, structure


def test_section_view_and_stubs(spark):
    p = structure.parse(spark.createDataFrame([(1, "\\section{A}\\label{s}x\\subsection{B}y"), (2, "")], "doc_id long, text string"), parts=("sections",))
    rows = [tuple(r) for r in structure.debug_view(p).where("doc_id = 1").orderBy("section_number").collect()]
    assert rows == [(1, "1", "A", 1, "s", False), (1, "1.1", "B", 2, None, False)]
    df = spark.createDataFrame([(3, "markdown"), (4, "numbered")], "idx int, fmt string")
    stub, block = answers.stub_block(F.col("idx"), F.col("fmt")), answers.format_block(F.col("idx"), F.lit("no answer"), F.col("fmt"))
    assert [r[0] == r[1] and "no answer" in r[0] for r in df.select(stub, block).collect()] == [True, True]
    c = spark.createDataFrame([(["a", "b"], [], None)], "label_refs array<string>, figure_refs array<string>, equation_refs array<string>")
    r = chunks.exported(c).first()
    assert r["label_refs"] == "|a|b|" and not r["figure_refs"] and not r["equation_refs"]


def test_report_shows_the_first_labels_of_all_documents(spark):
    texts = [(i, "\\section{S}" + "".join(f"\\ref{{u{i:03d}{k}}}\\ref{{same}}" for k in range(3)) + f"\\begin{{equation}}\\label{{e{i:03d}}}x\\end{{equation}}") for i in range(30)]
    p = structure.parse(spark.createDataFrame(texts, "doc_id long, text string"), parts=(*chunks.PARTS, "referenced", "targets"))
    figures = spark.createDataFrame([("a",)], "resolved_path string")
    got = {r["metric"]: r["value"] for r in evaluation.ingest_report(p, chunks.all_chunks(p), figures).collect()}
    n = evaluation.SHOWN
    assert got["label_undefined_referenced"] == ", ".join(sorted({"same", *(f"u{i:03d}{k}" for i in range(30) for k in range(3))})[:n])
    assert got["label_defined_unreferenced"] == ", ".join(sorted(f"e{i:03d}" for i in range(30))[:n])
