"""Overlap joins, running values and as-of joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import intervals, scan

SPAN = "k string, char_start long, char_end long, n int"


def spans(seed, n, far=4000):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randrange(-50, far)
        out.append((r.choice(["hot", "hot", "a", "b", None]), a, a + r.choice([0, 1, 2, 5, 30, 31, 32, 250, 3000, -4]), i))
    return [*out, ("a", None, 5, n), ("a", 5, None, n + 1), ("a", 10, 20, n + 2), ("a", 10, 20, n + 2), ("long", -(2**40), 2**40, n + 3), ("long", 7, 8, n + 4)]


def pairs(left, right):
    return sorted((a[3], b[3]) for a in left for b in right if a[0] is not None and a[0] == b[0] and None not in (a[1], a[2], b[1], b[2]) and max(a[1], b[1]) < min(a[2], b[2]))


@pytest.mark.parametrize("block", [10_000, 25])
def test_overlaps_equal_all_pairs(spark, block):
    a, b = spans(1, 300), spans(2, 200)
    found = intervals.overlaps(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), ["k"], block=block)
    assert sorted((r[0], r[1]) for r in found.select("left.n", "right.n").collect()) == pairs(a, b)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlaps_without_keys_and_with_nothing(spark):
    a, b = spans(3, 80), spans(4, 60)
    a, b = [("x", *r[1:]) for r in a], [("x", *r[1:]) for r in b]
    df, other = spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN)
    assert sorted((r[0], r[1]) for r in intervals.overlaps(df, other, []).select("left.n", "right.n").collect()) == pairs(a, b)
    assert intervals.overlaps(df.limit(0), other, ["k"]).count() == 0 and intervals.overlaps(df, other.limit(0), ["k"]).count() == 0


def test_short_intervals_do_not_meet_in_wide_bins(spark):
    """Two thousand short intervals a side and one long one: what the join puts together grows with the pairs, not with their product."""
    short = spark.range(2000).select(F.lit("k").alias("k"), (F.col("id") * 10).alias("char_start"), (F.col("id") * 10 + 4).alias("char_end"), F.col("id").cast("int").alias("n"))
    long = spark.createDataFrame([("k", 0, 20_000, -1)], SPAN)
    both = short.unionByName(long)
    found = intervals.overlaps(both, short.withColumn("char_start", F.col("char_start") + 2), ["k"])
    assert found.count() == 4000
    homes = intervals._level(F.col("char_end") - F.col("char_start"), 4.0)
    assert sorted(r[0] for r in both.select(homes).distinct().collect()) == [0, 5]


def clicks(seed, n, keys):
    r = random.Random(seed)
    return [(r.choice(keys), r.choice([None, *range(40)]), r.choice([None, 1, 2, 3]), r.choice([None, "x", "y", "z"]), i) for i in range(n)]


@pytest.mark.parametrize(("keys", "ranges"), [(["one"], 7), (["one", None], 5), ([*"abcdefghij", None], 4), (["one", *map(str, range(50))], 16)])
def test_running_values_with_any_split(spark, keys, ranges):
    rows = clicks(5, 400, keys)
    df = spark.createDataFrame(rows, "k string, t int, v int, w string, n int").repartition(3)
    got = scan.running(df, ["k"], ["t", "n"], {"total": F.col("v"), "many": F.lit(1)}, {"seen": F.col("w")}, ranges)
    want = []
    for key in set(keys):
        total = many = 0
        seen = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[4])):
            total, many, seen = total + (r[2] or 0), many + 1, r[3] if r[3] is not None else seen
            want.append((*r, total, many, seen))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert scan.running(df.limit(0), ["k"], ["t"], {"total": F.col("v")}).count() == 0


def test_a_key_of_all_rows_is_scanned_in_ranges(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    out = scan.running(df, ["k"], ["t"], {"n": F.lit(1)}, ranges=8)
    assert out.agg(F.sum((F.col("n") != F.col("t") + 1).cast("int"))).first()[0] == 0
    sizes = [r["count"] for r in spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/loomspan/ranges-*").where("k = 'hot'").groupBy("__range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5000


def test_equal_rows_follow_each_other(spark):
    df = spark.createDataFrame([("a", 1)] * 500, "k string, t int").repartition(4)
    got = scan.running(df, ["k"], ["t"], {"n": F.lit(1)}, ranges=5)
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 501))


@pytest.mark.parametrize("ranges", [1, 6])
def test_as_of_equals_brute_force(spark, ranges):
    r = random.Random(8)
    left = [(i, r.choice(["hot", "hot", "a", None]), r.choice([None, *range(30)])) for i in range(200)]
    right = [(r.choice(["hot", "hot", "a", "b", None]), r.choice([None, *range(0, 30, 3)]), s, r.choice([None, "u", "v"])) for s in range(60)]
    a, b = spark.createDataFrame(left, "id int, k string, at int"), spark.createDataFrame(right, "k string, since int, seq int, state string")
    got = scan.as_of(a, b, ["k"], "at", "since", ["state", "seq"], ["seq"], ranges)
    want = []
    for i, k, t in left:
        own = [x for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and x[1] <= t]
        best = max(own, key=lambda x: (x[1], x[2]), default=(None,) * 4)
        want.append((i, k, t, best[3], best[2]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
