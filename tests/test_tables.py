"""Keyed tables: changes, versions, racing writers and merged buckets."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from loomspan.sources.tables import KeyedTable, Outrun

SHAPE = "k long, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=4)


def test_changes_replace_whole_keys(spark, table):
    assert table.read() is None and table.snapshot().version == 0
    assert table.upsert(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n"), (None, None)], SHAPE)) == 1
    table.upsert(spark.createDataFrame([(1, "z"), (3, "d")], SHAPE), spark.createDataFrame([(2,)], "k int"))
    assert rows(table.read()) == rows(spark.createDataFrame([(1, "z"), (3, "d"), (None, "n"), (None, None)], SHAPE))
    table.upsert(spark.createDataFrame([(None, "m")], SHAPE))
    table.upsert(None, spark.createDataFrame([(3,), (99,)], "k long"))
    table.upsert(spark.createDataFrame([(2, "again")], SHAPE))
    assert rows(table.read()) == rows(spark.createDataFrame([(1, "z"), (None, "m"), (2, "again")], SHAPE))
    # a reader of an earlier version still sees that
    assert rows(table.read(1)) == rows(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n"), (None, None)], SHAPE))


def test_the_log_knows_the_keys(spark, table, tmp_path):
    table.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    other = KeyedTable(spark, f"file://{tmp_path}/t", buckets=3)  # as a reader that knows nothing
    other.upsert(spark.createDataFrame([(5, "new")], SHAPE))
    other.append(spark.createDataFrame([(5, "more"), (6, "more")], SHAPE))
    got = rows(other.read())
    assert got == rows(table.read()) and len(got) == 102 and (5, "old") not in got and {(5, "new"), (5, "more"), (6, "old"), (6, "more")} <= set(got)


def test_rows_are_cast_to_the_first_shape_and_nothing_changes_nothing(spark, table):
    table.upsert(spark.createDataFrame([], SHAPE))
    assert table.read().schema.simpleString() == "struct<k:bigint,v:string>" and table.read().count() == 0
    table.upsert(spark.createDataFrame([("x", 7)], "v string, k int"))
    v = table.snapshot().version
    assert table.upsert(spark.createDataFrame([], SHAPE)) == v and rows(table.read()) == [(7, "x")]


def test_only_touched_buckets_are_written_and_merged(spark, table, tmp_path):
    table.upsert(spark.range(400).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    one = spark.createDataFrame([(5, "new")], SHAPE)
    table.upsert(one)
    last = table.snapshot().segments[-1]
    assert len(last.rows) == len(last.gone) == 1
    for _ in range(3):
        table.upsert(one)
    before = {s.path: s for s in table.snapshot().segments}
    assert table.compact(many=4) == last.rows
    now = table.snapshot().segments
    assert len(now) == 2 and sorted(now[0].rows) == sorted(set(before[now[0].path].rows) - set(last.rows)) and now[1].rows == last.rows and now[1].gone == []
    assert table.read().count() == 400 and table.read().where("v = 'new'").count() == 1
    assert table.compact(many=4) == []
    assert table.vacuum(keep=1) == 0  # all are young
    assert table.vacuum(keep=1, age_s=-5) == 4 and len(os.listdir(tmp_path / "t/data")) == 2
    assert table.read().count() == 400


def test_racing_writers_both_land(spark, table):
    table.upsert(spark.range(20).select(F.col("id").alias("k"), F.lit("start").alias("v")))
    frames = [spark.createDataFrame([(w * 100 + i, f"w{w}") for i in range(5)] + [(0, f"w{w}")], SHAPE) for w in range(1, 5)]
    failed = []

    def write(df):
        try:
            table.upsert(df)
        except Exception as e:  # shown by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(f,)) for f in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and table.versions() == [1, 2, 3, 4, 5]
    got = rows(table.read())
    assert len(got) == 20 + 20 and sum(k == 0 for k, _ in got) == 1  # of the shared key the last one's


def test_a_taken_version_is_added_to_without_writing_rows_again(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([(1, "a")], SHAPE))
    commit, beaten = KeyedTable._commit, []

    def late(self, now):
        if not beaten:
            beaten.append(now.version)
            KeyedTable(spark, self.root, ["k"], 4).upsert(spark.createDataFrame([(2, "other"), (3, "other")], SHAPE))
        return commit(self, now)

    monkeypatch.setattr(KeyedTable, "_commit", late)
    assert table.upsert(spark.createDataFrame([(2, "ours")], SHAPE)) == 3
    assert rows(table.read()) == [(1, "a"), (2, "ours"), (3, "other")] and len(table._names("data")) == 3
    monkeypatch.setattr(KeyedTable, "_commit", lambda self, now: False)
    with pytest.raises(Outrun):
        table.upsert(spark.createDataFrame([(9, "x")], SHAPE), attempts=2)
    monkeypatch.undo()
    assert rows(table.read()) == [(1, "a"), (2, "ours"), (3, "other")]


def test_a_merge_keeps_what_others_add_meanwhile(spark, table, monkeypatch):
    for v in "abc":
        table.upsert(spark.createDataFrame([(1, v)], SHAPE))
    live = KeyedTable._live
    added = []

    def slow(self, now, buckets=None):
        if buckets is not None and not added:
            added.append(1)
            KeyedTable(spark, self.root, ["k"], 4).upsert(spark.createDataFrame([(1, "late")], SHAPE))
        return live(self, now, buckets)

    monkeypatch.setattr(KeyedTable, "_live", slow)
    assert table.compact(many=1)
    assert rows(table.read()) == [(1, "late")] and len(table.snapshot().segments) == 2


def test_a_broken_change_leaves_the_table(spark, table):
    table.upsert(spark.createDataFrame([(1, "a")], SHAPE))
    with pytest.raises(Exception):  # noqa: B017  whatever Spark raises
        table.upsert(spark.range(3).select(F.col("id").alias("k"), F.raise_error(F.lit("broken")).cast("string").alias("v")))
    assert rows(table.read()) == [(1, "a")] and table.versions() == [1]
