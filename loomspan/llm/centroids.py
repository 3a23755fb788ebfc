"""Centroid clustering in whole numbers, each vector's nearest centroid found by annulus search.

Centroids are sorted by norm. A vector first meets the few whose norms are next to its own; the smallest of these distances
bounds how far off its nearest centroid can be, and by the triangle inequality only centroids whose norms differ from the
vector's by that bound at most can be as near. They are one stretch of the sorted norms, found by binary search, both ends
included, and are compared exactly, so ties at the boundary are seen (Hamerly and Drake's annular rule).

Components are integers, sums and quotients exact, so neither order nor partitioning changes a result. A round is one scan
that sends a row a centroid and component from each task; nothing is kept for a vector between rounds. Only centroids, ``k`` times
``dims`` numbers, go to the driver and out to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import bounded_batches, named, table
from loomspan.plans.shared import materialize, release

#: Components beyond this count as this: sums stay within 38 digits.
LARGEST = 2**62
#: Pairs of vector and centroid in one array operation.
PAIRS = 16_384
LONGEST = 2**63 - 1
_LOW = 31


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """(id, v): vectors of exactly ``dims`` components, none null, NaN or infinite; each component x becomes floor(scale * x). Others and null
    vectors are left out; repeated rows stay, null ids too."""
    x = named(vector_col).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))))
    return vectors.where((F.size(x) == dims) & ~odd).select(named(id_col).alias("id"), v.alias("v"))


def seeds(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors of smallest sha256 of salt and id; null ids last, ties by the vector. Fewer if there are fewer."""
    first = rows.select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k)
    return [list(r["v"]) for r in first.collect()]


class Annuli:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: list[list[int]]):
        k = len(centroids)
        norms = np.array([isqrt(sum(x * x for x in c) << 20) / 1024 for c in centroids])
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.exact = norms[self.number], [centroids[j] for j in self.number]
        # Below this squared distances fit into 64 bits; larger components are compared in Python's integers.
        self.limit = isqrt(2**60 // len(centroids[0]))
        self.plain = all(abs(x) < self.limit for c in centroids for x in c)
        self.matrix = np.array(self.exact, np.int64) if self.plain else None
        self.probes = min(k, isqrt(k) + 1)

    def stretch(self, norm: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to which place norms are within ``bound`` of ``norm``. Widened by more than roundings can be, so the boundary is in."""
        bound = bound + 1e-9 * (norm + self.norms[-1]) + 0.01
        return np.searchsorted(self.norms, norm - bound, "left"), np.searchsorted(self.norms, norm + bound, "right")

    def _least(self, v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest squared distance to centroids lo to hi, and the smallest number that has it; none may be empty."""
        many = hi - lo
        ends = np.cumsum(many)
        best, who = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
        row = 0
        while row < len(v):  # some rows at a time, all their candidates
            stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS, "right")))
            n = many[row:stop]
            starts = np.cumsum(n) - n
            at = np.repeat(lo[row:stop] - starts, n) + np.arange(n.sum())
            gap = np.repeat(v[row:stop], n, axis=0) - self.matrix[at]
            d = np.einsum("ij,ij->i", gap, gap)
            best[row:stop] = np.minimum.reduceat(d, starts)
            who[row:stop] = np.minimum.reduceat(np.where(d == np.repeat(best[row:stop], n), self.number[at], len(self.number)), starts)
            row = stop
        return best, who

    def _one(self, v: list[int]) -> tuple[int, int]:
        """The same for one vector of large components."""
        far = lambda j: sum((a - b) ** 2 for a, b in zip(v, self.exact[j], strict=True))
        norm = np.array([isqrt(sum(x * x for x in v) << 20) / 1024])
        near = int(np.clip(np.searchsorted(self.norms, norm[0]) - self.probes // 2, 0, len(self.norms) - self.probes))
        bound = min(far(j) for j in range(near, near + self.probes))
        lo, hi = self.stretch(norm, np.array([float(isqrt(bound) + 1)]))
        d, number = min((far(j), int(self.number[j])) for j in range(int(lo[0]), int(hi[0])))
        return number, min(d, LONGEST)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each row its centroid, by number, and the squared distance; and how many pairs were compared."""
        who, dist = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
        plain = np.flatnonzero((np.abs(v) < self.limit).all(axis=1)) if self.plain else np.empty(0, np.int64)
        if len(plain) < len(v):
            for r in np.setdiff1d(np.arange(len(v)), plain).tolist():
                who[r], dist[r] = self._one(v[r].tolist())
        if not len(plain):
            return who, dist, len(v) * len(self.norms)
        own = v if len(plain) == len(v) else v[plain]
        norm = np.sqrt(np.einsum("ij,ij->i", own, own).astype(np.float64))
        lo = np.clip(np.searchsorted(self.norms, norm) - self.probes // 2, 0, len(self.norms) - self.probes)
        bound, _ = self._least(own, lo, lo + self.probes)
        lo, hi = self.stretch(norm, np.sqrt(bound.astype(np.float64)))
        dist[plain], who[plain] = self._least(own, lo, hi)
        return who, dist, int((hi - lo).sum()) + self.probes * len(own)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _totals(rows: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Of each non-empty centroid the number of its vectors and the sums of their components."""
    k, dims = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(centroids)
        n, high, low = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _vectors(batch.column(0), dims)
            who, _, _ = search.nearest(v)
            order = np.argsort(who, kind="stable")
            there, first = np.unique(who[order], return_index=True)
            n[there] += np.diff(np.append(first, len(v)))
            high[there] += np.add.reduceat((v >> _LOW)[order], first, axis=0)
            low[there] += np.add.reduceat((v & (2**_LOW - 1))[order], first, axis=0)
        some = np.flatnonzero(n)
        number, place = np.repeat(some, dims).astype(np.int32), np.tile(np.arange(dims, dtype=np.int32), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(place), pa.array(n[number]), pa.array(high[number, place]), pa.array(low[number, place])], names=["c", "i", "n", "high", "low"])

    parts = rows.select("v").mapInArrow(run, "c int, i int, n long, high long, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("c", "i").agg(F.sum("n").alias("n"), total("high"), total("low")).collect():  # bound: k times dims
        out.setdefault(r["c"], (r["n"], [0] * dims))[1][r["i"]] = (int(r["high"]) << _LOW) + int(r["low"])
    return out


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of every row: the nearest centroid, of equally near ones the smallest number, and the squared distance, at most
    the largest long."""
    bounded_batches(rows.sparkSession)
    dims = len(centroids[0]) if centroids else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(centroids) if centroids else None
        for batch in batches:
            if batch.num_rows:
                who, dist, _ = search.nearest(_vectors(batch.column(1), dims))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(dist)], names=["id", "cluster", "distance"])

    return rows.select("id", "v").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")


def fit(rows: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:") -> list[list[int]]:
    """Centroids of ``rows`` (id, v) after so many rounds; an empty one stays where it is. No rows, no centroids."""
    bounded_batches(rows.sparkSession)
    centroids = seeds(rows, k, salt)
    for _ in range(rounds if centroids else 0):
        for c, (n, sums) in _totals(rows, centroids).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def _long(total: Column) -> Column:
    return F.least(total, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 1024, salt: str = "3:") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance, cluster_inertia, inertia) of every vector that ``whole`` keeps, and the final centroids. Repeated rows count
    and are returned each; null ids come back as null and start no centroid before others; vectors of other lengths, with nulls or
    without end are left out; an empty table gives no row. Only the two named columns are read, so others can't clash."""
    rows = materialize(whole(vectors, id_col, vector_col, dims, scale), "whole-vectors")
    centroids = fit(rows, k, rounds, salt)
    last = materialize(assigned(rows, centroids), "assigned")
    release(rows)
    distance = F.sum(F.col("distance").cast("decimal(38,0)"))
    every = F.sum("s").over(Window.partitionBy(F.lit(0)))
    sums = last.groupBy("cluster").agg(distance.alias("s")).select("cluster", _long(F.col("s")).alias("cluster_inertia"), _long(every).alias("inertia"))
    out = last.join(F.broadcast(sums), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia")  # bound: k rows
    return out, centroids


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector of ``embeddings``."""
    out, centroids = clusters(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return out.withColumn("centroid_sha256", F.element_at(F.array(*map(F.lit, digests or [""])), F.col("cluster") + 1))


def op12_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:") -> str:
    """All pairs, round after round."""
    near = "select r.id, r.rid, r.v, min(struct_pack(d := list_sum(list_transform(list_zip(r.v, o.v), lambda z: (z[1] - z[2])::hugeint * (z[1] - z[2]))), c := o.c)) as m from kept r, {0} o group by all"
    parts = [
        f"fit as (select vec_id as id, embedding as e from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})",
        f"kept as materialized (select id, row_number() over () as rid, list_transform(e, lambda x: cast(floor(cast(x as double) * {scale}) as bigint)) as v from fit)",
        f"o0 as materialized (select cast(row_number() over (order by h nulls last, v) - 1 as integer) as c, v from (select sha256('{salt}' || id) as h, v from kept order by h nulls last, v limit {k}))",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} as materialized ({near.format(f'o{r}')})",
            f"s{r} as (select m.c as c, i, sum(v[i]) as s, count(*) as n from a{r}, range(1, {dims + 1}) t(i) group by all)",
            f"u{r} as (select c, list(cast((s - (s % n + n) % n) // n as bigint) order by i) as v from s{r} group by c)",
            f"o{r + 1} as materialized (select c, coalesce(u{r}.v, o{r}.v) as v from o{r} left join u{r} using (c))",
        ]
    parts.append(f"last as materialized ({near.format(f'o{rounds}')})")
    total = "cast(sum(m.d) over ({}) as bigint)"
    return f"with {', '.join(parts)} select id as vec_id, m.c as cluster, cast(m.d as bigint) as distance, {total.format('partition by m.c')} as cluster_inertia, {total.format('')} as inertia, sha256(array_to_string(o.v, ',')) as centroid_sha256 from last join o{rounds} o on o.c = m.c"
