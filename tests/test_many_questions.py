"""More questions than one block holds meet the rows in a grid."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomspan import queries as core
from loomspan.operators import retrieval

DATA = "/root/testdata/sf0.001"


def _same_in_blocks(spark, monkeypatch, name):
    whole = sorted(map(tuple, core.QUERIES[name](spark, DATA).collect()))
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 3)
    assert sorted(map(tuple, core.QUERIES[name](spark, DATA).collect())) == whole
    return whole


def test_questions_that_are_entries_of_the_same_table(spark, monkeypatch):
    assert _same_in_blocks(spark, monkeypatch, "qa_semantic_lookup")


def test_metrics_of_questions_that_are_entries_of_the_same_table(spark, monkeypatch):
    assert len(_same_in_blocks(spark, monkeypatch, "qa_cache_metrics")) == 1


def test_a_group_lets_through_no_more_than_is_asked_for(spark):
    """Each batch of a group brings a nearer row; only the nearest of the whole group go on."""
    chunks = spark.range(2000).select(F.format_string("c%04d", "id").alias("chunk_id"), F.array(F.lit(1.0), 1 / (F.col("id") + 1)).alias("embedding")).coalesce(1)
    plans = spark.range(3).select(F.col("id").alias("question_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    rows = retrieval.nearest(chunks, plans, {"k": (4, "all")}, block=1).collect()
    assert sorted((r["question_id"], r["chunk_id"]) for r in rows) == [(q, f"c{i}") for q in range(3) for i in range(1996, 2000)]


def test_visits_of_cells_are_never_broadcast(spark):
    """A question's vector stands in each of its visits: small in files, large in the driver's memory. Only the sizes of cells are broadcast."""
    shape = "chunk_id long, embedding array<double>, cell int"
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0)], shape)
    visits = spark.createDataFrame([(1, [1.0, 0.0], 0)], "question_id long, embedding array<double>, cell int")
    plan = retrieval.grid(rows, visits, {"k": (1, "all")}, ["cell"], few=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 2


def test_rows_that_leave_the_grid_do_not_grow_with_the_chunks(spark):
    """However many blocks the chunks would fill: 100 blocks of 20 chunks here."""
    chunks = spark.range(2000).select(F.format_string("c%04d", "id").alias("chunk_id"), F.array(F.lit(1.0), 1 / (F.col("id") + 1)).alias("embedding"))
    plans = spark.range(24).select(F.col("id").alias("question_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    rows = retrieval.grid(chunks, plans, {"k": (1, "all")}, [], block=1, numbers=40).collect()
    assert len(rows) <= 24 * retrieval.CHUNK_BLOCKS
    assert {r["question_id"] for r in rows if r["chunk_id"] == "c1999"} == set(range(24))


def test_a_group_holds_only_the_best_of_what_has_streamed_past(monkeypatch):
    monkeypatch.setattr(retrieval, "GROUP_ROWS", 50)
    one = retrieval._Group({"k": (4, "all")}, ["chunk_id", "embedding"], "chunk_id")
    one.asked.append(pa.RecordBatch.from_pydict({"question_id": [0, 1, 2], "embedding": [[1.0, 0.0]] * 3}))
    held = []
    for i in range(0, 6000, 100):  # each batch brings nearer rows
        ids = range(i, i + 100)
        one.add(pa.RecordBatch.from_pydict({"chunk_id": [f"c{k:04d}" for k in ids], "embedding": [[1.0, 1 / (k + 1)] for k in ids]}))
        held.append(one.rows)
    assert max(held) <= 2 * 50 + 12
    shape = pa.schema([("chunk_id", pa.string()), ("question_id", pa.int64()), ("sim", pa.float64()), ("in_k", pa.bool_())])
    rows = pa.Table.from_batches(one.best(shape)).to_pylist()
    assert sorted((r["question_id"], r["chunk_id"]) for r in rows) == [(q, f"c{k}") for q in range(3) for k in range(5996, 6000)]
