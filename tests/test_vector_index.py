"""The index and the grid against a scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import retrieval, vector_index
from loomspan.sources.store import Store

SHAPE = "chunk_id string, kind string, section_number string, section_top string, has_figure boolean, figure_refs array<string>, equation_refs array<string>, embedding array<double>"
PLAN = "question_id long, embedding array<double>, scope array<string>, is_figure boolean, target_label string"


def chunk(i, v, number="1.1"):
    return (f"c{i:05d}", ("body", "caption", "equation")[i % 3], number, number.split(".")[0], i % 2 == 0, [f"f{i % 7}"], [f"e{i % 5}"], None if v is None else [float(x) for x in v])


@pytest.fixture(scope="module")
def clustered(spark):
    """Forty narrow directions, one that a third of all rows shares, and rows that no centre bounds."""
    r = np.random.default_rng(3)
    middles = r.normal(size=(40, 16))
    rows = [chunk(i, middles[i % 40] * r.uniform(0.5, 2) + 0.02 * r.normal(size=16), f"{i % 40}.{i % 3}") for i in range(1600)]
    rows += [chunk(1600 + i, middles[0]) for i in range(800)]
    rows += [chunk(2400, None), chunk(2401, []), chunk(2402, [0.0] * 16), chunk(2403, [1.0, 2.0]), chunk(2404, -middles[1])]
    asked = [(i, [float(x) for x in middles[i % 40] + 0.02 * r.normal(size=16)], [f"{i % 40}.{i % 3}", str((i + 1) % 40)] if i % 4 else None, i % 5 == 0, "f1") for i in range(60)]
    asked += [(60, [float(x) for x in middles[0]], [], False, None), (61, [0.0] * 16, None, False, None), (62, [2.0, 1.0], ["1"], False, None), (63, [float(x) for x in middles[3]], ["3", "3.0"], True, "f2")]
    return spark.createDataFrame(rows, SHAPE).repartition(5), spark.createDataFrame(asked, PLAN)


def best(chunks, asked, k):
    """By brute force."""
    rows, out = chunks.select("chunk_id", "embedding").collect(), {}
    for q in asked.collect():
        found = []
        for c in rows:
            a, b = np.array(q["embedding"]), np.array(c["embedding"] if c["embedding"] is not None else [])
            ok = len(a) == len(b) and len(a) and a.any() and b.any()
            found.append((-max(0.0, round(float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), 12)) if ok else 0.0, c["chunk_id"]))
        out[q["question_id"]] = [i for _, i in sorted(found)[:k]]
    return out


def ids(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["question_id"], r["rank"])):
        out.setdefault(r["question_id"], []).append(r["chunk_id"])
    return out


def test_index_finds_what_a_scan_finds_and_skips_cells(spark, clustered, tmp_path):
    chunks, asked = clustered
    index = vector_index.build(chunks, f"file://{tmp_path}/index")
    assert index.rows.count() == chunks.count() and index.cells.agg(F.sum("n")).first()[0] == chunks.count()
    found, visits = vector_index.search(index, asked.drop("is_figure"), 7)
    assert ids(found.collect()) == best(chunks, asked, 7)
    cells = index.cells.count()
    close = visits.where("question_id < 60").count()
    assert cells > 20 and close < 0.35 * 60 * cells  # a question reads a few cells of those near it
    assert visits.distinct().count() == visits.count()
    # a question with nothing near it has to look everywhere that a zero could be
    assert visits.where("question_id = 61").count() >= 1


def test_index_filters_before_it_ranks(spark, clustered, tmp_path):
    chunks, asked = clustered
    index = vector_index.build(chunks, f"file://{tmp_path}/index", cells=12)
    found, _ = vector_index.search(index, asked, 5)
    got = ids(found.collect())
    shown, flat = chunks.where(retrieval.figure_kinds()), asked.where("not is_figure")
    assert {q: got[q] for q in got if q % 5 == 0 and q < 60 or q == 63} == best(shown, asked.where("is_figure"), 5)
    assert {q: got[q] for q in got if not (q % 5 == 0 and q < 60 or q == 63)} == best(chunks, flat, 5)


def test_retrieval_on_the_index_equals_a_scan(spark, clustered, tmp_path):
    chunks, asked = clustered
    limits = retrieval.Limits(least=0.2)
    key = ("question_id", "chunk_id", "ord", "fallback_used")
    index = vector_index.build(chunks, f"file://{tmp_path}/index")
    want = sorted(retrieval.retrieve(chunks, asked, limits).select(*key).collect())
    assert sorted(vector_index.retrieve(index, asked, limits).select(*key).collect()) == want
    assert want


def test_scoped_questions_meet_their_sections_alone(spark, clustered):
    chunks, asked = clustered
    some = asked.where("size(scope) > 0")
    met = retrieval.scoped(chunks, some, 10_000)  # all that meet
    pairs = some.select("question_id", F.explode(F.array_distinct("scope")).alias("i")).join(chunks.select("chunk_id", F.explode(F.array_distinct(F.array("section_number", "section_top"))).alias("i")), "i").select("question_id", "chunk_id").distinct()
    figures = some.where("is_figure").select("question_id").join(pairs, "question_id").join(chunks.where(~retrieval.figure_kinds()).select("chunk_id"), "chunk_id")
    assert met.count() == pairs.count() - figures.count()
    assert met.count() < 0.2 * chunks.count() * some.count()


@pytest.mark.parametrize(("block", "numbers"), [(5, 1_000_000), (1000, 2000), (7, 3000)])
def test_grid_of_any_blocks_equals_the_broadcast(spark, clustered, block, numbers):
    chunks, asked = clustered
    passes = retrieval.passes_of(retrieval.Limits())
    want = retrieval.chosen(retrieval.nearest(chunks, asked, passes), asked).select("question_id", "chunk_id", "ord").collect()
    got = retrieval.chosen(retrieval.grid(chunks, asked, passes, [], block=block, numbers=numbers), asked).select("question_id", "chunk_id", "ord").collect()
    assert sorted(got) == sorted(want)
    over = retrieval.nearest(chunks, asked, passes, block=10)  # more questions than are broadcast
    assert sorted(retrieval.chosen(over, asked).select("question_id", "chunk_id", "ord").collect()) == sorted(want)


def test_index_follows_changed_chunks(spark, clustered, tmp_path):
    chunks, asked = clustered
    index = vector_index.build(chunks, f"file://{tmp_path}/a")
    r = np.random.default_rng(9)
    fresh = spark.createDataFrame([chunk(i, r.normal(size=16)) for i in (3, 5, 9000, 9001)], SHAPE)
    gone = spark.createDataFrame([("c00007",), ("nothing",)], "chunk_id string")
    now = vector_index.refreshed(index, fresh, f"file://{tmp_path}/b", gone)
    want = chunks.where(~F.col("chunk_id").isin("c00003", "c00005", "c00007")).unionByName(fresh)
    found, _ = vector_index.search(now, asked.drop("is_figure"), 4)
    assert now.rows.count() == want.count() == chunks.count() + 1
    assert ids(found.collect()) == best(want, asked, 4)


def test_an_index_is_kept_in_the_store(spark, clustered, tmp_path):
    chunks, asked = clustered
    s = Store(spark, f"file://{tmp_path}/s")
    assert vector_index.kept(s) is None
    some, flat = chunks.where("chunk_id < 'c00300'"), asked.where("question_id < 10").drop("is_figure")
    vector_index.keep(s, some)
    vector_index.keep(s, chunks.where("chunk_id between 'c00250' and 'c00400'"), gone=spark.createDataFrame([("c00001",)], "chunk_id string"))
    found, _ = vector_index.search(vector_index.kept(s), flat, 3)
    assert ids(found.collect()) == best(chunks.where("chunk_id <= 'c00400' and chunk_id <> 'c00001'"), flat, 3)
    assert len([x for x in (tmp_path / "s/index").iterdir() if x.name.startswith("v-")]) == 1


def test_index_of_nothing(spark, clustered, tmp_path):
    chunks, asked = clustered
    index = vector_index.build(chunks.limit(0), f"file://{tmp_path}/none")
    found, visits = vector_index.search(index, asked, 3)
    assert found.count() == 0 and visits.count() == 0
    one = vector_index.build(chunks.where("chunk_id in ('c00001', 'c02400')"), f"file://{tmp_path}/one")
    found, _ = vector_index.search(one, asked.drop("is_figure"), 3)
    assert found.count() == 2 * asked.count()
