"""An exact index of vectors: cells with a centre and a radius, skipped by the triangle inequality of angles.

Centres come from k-means over a bounded sample; every row is put into the cell of the nearest centre, whatever the sample held. A cell's
radius is the largest angle between its centre and one of its vectors, so no vector of it has a greater cosine with a question
than the angle to the centre less the radius allows. Search is two rounds of equi-joins by cell. In the first a question visits the
most promising cells that together hold enough rows, which gives it a k-th best; in the second it visits every other cell whose
bound reaches that. What is found is what a scan finds, ties included: centres only decide how much is skipped.

Rows whose vector is empty, zero or of another length than the centres are in the cell ``LOOSE``, which every question visits.
The index is two tables: rows, in folders by cell, so a scan of some cells reads only their files, and cells, one row each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions import vectors as V
from loomspan.operators import retrieval as R
from loomspan.plans.shared import bounded_batches, materialize, release
from loomspan.sources.store import Store

#: Rows that centres are fitted on, about, and the most centres: with vectors of a thousand numbers they are 8 MB.
SAMPLE, MOST_CELLS = 50_000, 1024
#: Rows in one file of a cell, about.
FILE_ROWS = 200_000
#: The cell of rows that no centre bounds.
LOOSE = -1
#: What roundings may change in a cosine.
ROUNDING = 1e-9


@dataclass
class Index:
    """``rows``: chunk columns, cell, angle. ``cells``: cell, centre, radius, n, n_figures."""

    rows: DataFrame
    cells: DataFrame

    def bounds(self) -> Bounds:
        """The cells as a matrix; at most ``MOST_CELLS`` and the loose one."""
        return Bounds(self.cells.orderBy("cell").toArrow())


class Bounds:
    """Which cells a question has to visit."""

    def __init__(self, cells: pa.Table):
        self.number = cells["cell"].to_numpy()
        self.radius = cells["radius"].to_numpy()
        self.many = {False: cells["n"].to_numpy(), True: cells["n_figures"].to_numpy()}
        centres = cells["centre"].to_pylist()
        dims = max(map(len, centres), default=0)
        self.centres = np.array([c if len(c) == dims else [0.0] * dims for c in centres]).reshape(len(centres), dims)

    def of(self, vectors: pa.Array) -> np.ndarray:
        """(vectors, cells): the greatest cosine, 0 at least, that a vector of the cell can have with the question's."""
        out = np.zeros((len(vectors), len(self.number)))
        for rows, q, norm in R._units(vectors):
            if q.shape[1] == self.centres.shape[1]:
                angle = np.arccos(np.clip(q @ self.centres.T / norm[:, None], -1, 1)) - self.radius
                out[rows] = np.maximum(np.cos(np.clip(angle, 0, np.pi)) + ROUNDING, 0.0)
        out[:, self.number == LOOSE] = 1.0  # of other vectors nothing but a loose row can be near
        return out

    def first(self, bounds: np.ndarray, k: int, figures: np.ndarray) -> np.ndarray:
        """(questions, cells): the fewest cells, best bounds first, that hold k rows; and the loose one."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        held = np.where(figures[:, None], self.many[True], self.many[False])
        held = np.take_along_axis(held, order, axis=1)
        chosen = np.zeros(bounds.shape, bool)
        np.put_along_axis(chosen, order, np.cumsum(held, axis=1) - held < k, axis=1)
        chosen[:, self.number == LOOSE] = True
        return chosen


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> list[list[float]]:
    """Unit vectors of the centres, by default about as many as the square root of the rows; of the vectors of the most frequent length."""
    unit = vectors.select(V.doubles(F.col("embedding")).alias("v")).where(F.coalesce(V.norm(F.col("v")), F.lit(0.0)) > 0).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    sizes = unit.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return []
    cells = min(MOST_CELLS, cells or isqrt(sizes["n"]) + 2)
    chosen = unit.where(F.size("v") == sizes["d"]).sample(min(1.0, sample / sizes["n"]), seed).select(V.unit(F.col("v")).alias("v"))
    few = chosen.distinct().limit(cells + 1).collect()
    if len(few) <= cells:  # each is a centre
        return [list(r["v"]) for r in few]
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="v").fit(chosen.select(array_to_vector("v").alias("v")).repartition(8))
    centres = np.array(model.clusterCenters())
    norms = np.sqrt((centres * centres).sum(axis=1))
    return (centres[norms > 0] / norms[norms > 0, None]).tolist()


def placed(chunks: DataFrame, centres: list[list[float]]) -> DataFrame:
    """``chunks`` with cell and angle: the nearest centre and the angle to it."""
    bounded_batches(chunks.sparkSession)
    at, matrix = chunks.columns.index("embedding"), np.array(centres)
    dims = matrix.shape[1] if centres else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.full(batch.num_rows, LOOSE, np.int32), np.full(batch.num_rows, np.pi)
            for rows, v, norm in R._units(batch.column(at)):
                if v.shape[1] == dims:
                    cosines = (v @ matrix.T) / norm[:, None]
                    cell[rows] = cosines.argmax(axis=1)
                    angle[rows] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    shape = T.StructType([*(T.StructField(f.name, f.dataType) for f in chunks.schema.fields), T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return chunks.mapInArrow(run, shape)


def catalogue(rows: DataFrame, centres: list[list[float]]) -> DataFrame:
    """A row for each cell that holds any; ``n_figures`` counts the rows that answer questions about figures."""
    figures = R.figure_kinds() if {"kind", "has_figure"} <= set(rows.columns) else F.lit(True)
    counts = rows.groupBy("cell").agg((F.max("angle") + ROUNDING).alias("radius"), F.count("*").alias("n"), F.count_if(figures).alias("n_figures"))
    known = rows.sparkSession.createDataFrame([*enumerate(centres), (LOOSE, [])], "cell int, centre array<double>")
    return known.join(counts, "cell")


def _write(rows: DataFrame, centres: list[list[float]], path: str) -> None:
    """A cell of many rows is some files, dealt by hash, so no task writes it alone; a small one is one file."""
    rows = materialize(rows, "placed")
    cells = materialize(catalogue(rows, centres), "cells")
    parts = cells.select("cell", F.ceil(F.col("n") / FILE_ROWS).alias("__parts"))  # bound: a row a cell
    dealt = rows.join(F.broadcast(parts), "cell").repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.col("__parts"))).drop("__parts")
    dealt.write.partitionBy("cell").parquet(f"{path}/rows")
    cells.coalesce(1).write.parquet(f"{path}/cells")
    release(rows, cells)


def build(chunks: DataFrame, path: str, cells: int | None = None) -> Index:
    """Writes the index of ``chunks`` (chunk_id, embedding, other columns) under ``path``, which is new. Every row is in it, repeated ids too."""
    centres = fit(chunks, cells)
    _write(placed(chunks, centres), centres, path)
    return open_index(chunks.sparkSession, path, chunks)


def load(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    shape = T.StructType([*(T.StructField(f.name, f.dataType) for f in like.schema.fields), T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    return spark.read.schema(shape).parquet(f"{path}/rows")


def open_index(spark: SparkSession, path: str, like: DataFrame | None = None) -> Index:
    """The index that ``build`` has written."""
    rows = spark.read.parquet(f"{path}/rows") if like is None else load(spark, path, like)
    return Index(rows, spark.read.parquet(f"{path}/cells"))


def _visits(asked: DataFrame, bounds: Bounds, k: int, again: bool) -> DataFrame:
    """``asked`` once for each cell to visit: at first the fewest that hold k rows, again the others whose bound reaches ``least``."""
    payload = asked.sparkSession.sparkContext.broadcast(bounds)
    names = asked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = payload.value
        for batch in (b.slice(i, R.CHUNK_BLOCK) for b in batches for i in range(0, b.num_rows, R.CHUNK_BLOCK)):
            of = dict(zip(names, batch.columns, strict=True))
            limits = cells.of(of["embedding"])
            chosen = cells.first(limits, k, of["is_figure"].to_numpy(zero_copy_only=False).astype(bool))
            if again:
                chosen = ~chosen & (limits >= of["least"].to_numpy(zero_copy_only=False)[:, None] - ROUNDING)
            row, cell = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(cells.number[cell], pa.int32())], names=[*names, "cell"])

    return asked.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in asked.schema.fields), T.StructField("cell", T.IntegerType())]))


def search(index: Index, asked: DataFrame, k: int, id_col: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(chunk columns, question_id, sim): the k nearest rows of each question of ``asked`` (question_id, embedding[, is_figure]) by cosine, 0 at
    least, ties by id; a question about a figure only finds rows that show one. Second, the visits made: (question_id, cell)."""
    asked = asked if "is_figure" in asked.columns else asked.withColumn("is_figure", F.lit(False))
    asked = asked.select("question_id", "embedding", F.coalesce("is_figure", F.lit(False)).alias("is_figure"))
    bounds = index.bounds()
    rows = index.rows.drop("angle")
    order = Window.partitionBy("question_id").orderBy(*R._nearest_first(id_col))
    # A question makes many visits, so a small table of questions is spread before.
    spread = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "question_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    passes = {"k": (k, "figures" if {"kind", "has_figure"} <= set(rows.columns) else "all")}

    def met(visits: DataFrame) -> DataFrame:
        """Only the files of visited cells are read."""
        cells = [r["cell"] for r in visits.select("cell").distinct().collect()]  # bound: one a cell
        return R.grid(rows.where(F.col("cell").isin(cells)), visits, passes, ["cell"], id_col, few=True)

    early = materialize(_visits(spread(asked), bounds, k, False), "visits")
    first = materialize(best(met(early).drop("in_k", "cell")), "first-found")
    known = first.groupBy("question_id").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(0.0).alias("least"))
    rest = asked.join(known, "question_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    late = materialize(_visits(spread(rest), bounds, k, True), "visits")
    out = best(first.drop("rank").unionByName(met(late).drop("in_k", "cell")))
    return out, early.select("question_id", "cell").unionByName(late.select("question_id", "cell"))


def retrieve(index: Index, plans: DataFrame, limits: R.Limits = R.Limits()) -> DataFrame:
    """``retrieval.retrieve`` on an index: global passes through its cells, scoped ones through postings by section, so a question with a
    scope meets that scope's chunks alone."""
    plans = plans.withColumn("is_figure", F.coalesce("is_figure", F.lit(False)))
    chunks = index.rows.drop("cell", "angle")
    some = F.size(F.coalesce("scope", F.array().cast("array<string>"))) > 0
    marked = lambda df, s, g, p: df.withColumns({"in_s": s, "in_g": g, "in_p": p})
    # One search for both global passes: a question about a figure asks again for any kind.
    again = plans.where("is_figure").select("question_id", "embedding", F.lit(False).alias("is_figure"), F.lit(True).alias("free"))
    asked = plans.select("question_id", "embedding", "is_figure", F.lit(False).alias("free")).unionByName(again)
    whole, _ = search(index, asked.select(F.struct("question_id", "free").alias("question_id"), "embedding", "is_figure"), limits.fetch)
    kinds = plans.select("question_id", (~some).alias("__unscoped"), (~F.col("is_figure")).alias("__plain"))
    whole = whole.drop("rank").withColumns({"__again": F.col("question_id.free"), "question_id": F.col("question_id.question_id")}).join(kinds, "question_id")
    first = ~F.col("__again")
    whole = marked(whole, first & F.col("__unscoped"), first, ~first | F.col("__plain")).drop("__again", "__unscoped", "__plain")
    in_scope = R.scoped(chunks, plans.where(some), limits.fetch)
    found = whole.unionByName(marked(in_scope, F.lit(True), F.lit(False), F.lit(False)))
    same = [c for c in found.columns if not c.startswith("in_")]
    merged = found.groupBy("question_id", "chunk_id").agg(*(F.first(c).alias(c) for c in same if c not in ("question_id", "chunk_id")), *(F.bool_or(c).alias(c) for c in ("in_s", "in_g", "in_p")))
    return R.chosen(merged, plans, limits)


def refreshed(index: Index, fresh: DataFrame, path: str, gone: DataFrame | None = None) -> Index:
    """A new index under ``path``: rows of ``index`` whose chunk_id isn't among ``fresh`` or ``gone``, and ``fresh``; centres stay, radii follow."""
    spark = fresh.sparkSession
    centres = [r["centre"] for r in index.cells.where(F.col("cell") != LOOSE).orderBy("cell").collect()]
    out = fresh.select("chunk_id") if gone is None else fresh.select("chunk_id").unionByName(gone.select("chunk_id"))
    stay = index.rows.drop("cell", "angle").join(out, "chunk_id", "left_anti").select(*fresh.columns)
    _write(placed(stay.unionByName(fresh), centres), centres, path)
    return open_index(spark, path, fresh)


def keep(store: Store, chunks: DataFrame, name: str = "index", gone: DataFrame | None = None) -> Index:
    """The index that is kept under this name with ``chunks`` in place of those of their ids, and without those of ``gone``; the first call builds
    it. Readers see the index before or after."""
    old, before = kept(store, name), store.version(name)
    version = f"v-{uuid.uuid4().hex}"
    path = f"{store.root}/{name}/{version}"
    out = build(chunks, path) if old is None else refreshed(old, chunks, path, gone)
    store.publish(name, version, before)
    return out


def kept(store: Store, name: str = "index") -> Index | None:
    """The kept index; None without any."""
    version = store.version(name)
    return None if version is None else open_index(store.spark, f"{store.root}/{name}/{version}")
