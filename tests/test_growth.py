"""What makes work grow faster than it must is seen in the plans."""

from pyspark.sql import DataFrame

from loomspan import queries as core
from loomspan.operators import structure

DATA = "/root/testdata/sf0.001"


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_groups_of_files_are_streamed(spark):
    for name in ("expand_inputs", "fingerprint_docs"):
        assert "FlatMapGroupsInPandas" not in _plan(core.QUERIES[name](spark, DATA))


def test_texts_are_parsed_once(spark):
    assert "MapInArrow" not in _plan(core.QUERIES["chunk_union"](spark, DATA))


def test_only_documents_that_are_asked_are_parsed(spark, monkeypatch):
    seen, parse = [], structure.parse
    monkeypatch.setattr(structure, "parse", lambda texts, **more: seen.append(_plan(texts)) or parse(texts, **more))
    core.QUERIES["answer_two_pass"](spark, DATA)
    assert len(seen) == 1 and "% 20" in seen[0]


def test_blank_lines_go_in_bounded_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    core.QUERIES["collapse_blank_lines"](spark, DATA)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
