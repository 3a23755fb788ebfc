"""Filtered vector top-k, re-ranking, grouped deduplication, fallback and bonus: set at a time over all questions.

``chunks`` (chunk_id, kind, section_number, section_top, has_figure, figure_refs, equation_refs, embedding[, text]);
``plans`` (question_id, embedding, scope array<string> or null, is_figure, target_label). Up to ``QUESTION_BLOCK`` questions are
broadcast as one matrix, and chunks stream past it in Arrow batches, a matrix product each. More questions, and questions that share a
key with their chunks (a document, a cell of an index, a section), meet them in a grid: the rows of a key are split into blocks on
both sides, and each pair of blocks is one group, whose questions are held while its chunks stream past. Either way a row goes on
only if it can be among the best of a pass so far, so what is exchanged is some rows a question and task, never all pairs. Ranking, deduplication, fallback and bonus are windows over
that one exchange by question.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomspan.plans.shared import bounded_batches

#: Questions in one block: what is broadcast at most, and what one group of the grid holds.
QUESTION_BLOCK = 2000
#: Pairs whose cosines are summed in one step.
PAIR_BLOCK = 32_768
#: Numbers in the vectors of one group's chunks, at least: 8 MB.
BLOCK_NUMBERS = 1_000_000
#: Blocks that a key's chunks may always be dealt to, however many blocks its questions have.
CHUNK_BLOCKS = 4
#: Rows that a group holds before it looks which of them are still among the best, and rows in one batch of what it returns.
GROUP_ROWS, BATCH_ROWS = 100_000, 10_000
#: Chunks in one matrix product: with as many questions some MB.
CHUNK_BLOCK = 256
#: What the order of a sum may change in a cosine; rows so near to the last place are scored again one by one.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Limits:
    """Sizes and thresholds of retrieval."""

    top: int = 6
    fetch: int = 24
    bonus: int = 2
    least: float = 0.45
    min_scoped: int = 3


def validate_scope(plans: DataFrame, chunks: DataFrame, by: str | None = None) -> DataFrame:
    """Scopes restricted to the numbers that chunks have, of all documents or of the question's own, the column ``by``; exploded and
    semi-joined, so known numbers may be of any count; adds ``unscoped``. An item loses the section sign and the characters of
    "Section " before it."""
    keys = [by] if by else []
    known = chunks.select(*keys, F.explode(F.array("section_number", "section_top")).alias("s")).where("s <> ''").distinct()
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("item"), "^§+", ""), "^[Section ]+", ""))
    items = plans.select("question_id", *keys, F.posexplode("scope").alias("at", "item")).select("question_id", *keys, "at", bare.alias("s")).join(known, [*keys, "s"], "left_semi")
    kept = items.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("k")).select("question_id", F.transform("k", lambda x: x["s"]).alias("scope"))
    return plans.drop("scope").join(kept, "question_id", "left").withColumn("unscoped", F.col("scope").isNull())


def in_scope(scope: Column, number: Column, top: Column) -> Column:
    return F.coalesce(F.array_contains(scope, number) | F.array_contains(scope, top), F.lit(False))


#: Kinds that answer a question about a figure, if they have one.
FIGURE_KINDS = ("caption", "figure_desc", "body")


def figure_kinds() -> Column:
    return F.col("kind").isin(*FIGURE_KINDS) & F.col("has_figure")


def predicate(scope: Column, is_figure: Column) -> Column:
    """Scope on number or top section, figures on kind and flag; what isn't asked for isn't filtered."""
    scoped = scope.isNull() | (F.size(scope) == 0) | in_scope(scope, F.col("section_number"), F.col("section_top"))
    return scoped & (~is_figure | figure_kinds())


def bonus(scope: Column, is_figure: Column, target: Column) -> Column:
    label = F.coalesce(F.array_contains("figure_refs", target) | F.array_contains("equation_refs", target), F.lit(False))
    number, top = F.coalesce(F.array_contains(scope, F.col("section_number")), F.lit(False)), F.coalesce(F.array_contains(scope, F.col("section_top")), F.lit(False))
    when = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    return when(number, 0.05) + when(top, 0.03) + when(is_figure & F.col("kind").isin("caption", "figure_desc"), 0.05) + when(label, 0.1)


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all vectors, where each begins, and how long it is; missing values count as 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.nan_to_num(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    return flat, np.cumsum(lengths) - lengths, lengths


def _units(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of vector: which rows have it, their vectors, and their norms. Empty and zero vectors are in none."""
    flat, first, lengths = _matrix(vectors)
    out = []
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        v = flat[first[rows][:, None] + np.arange(d)]
        norm = np.sqrt((v * v).sum(axis=1))
        some = norm > 0
        out.append((rows[some], v[some], norm[some]))
    return out


class _Questions:
    """A block of questions: unit vectors by length, and for each pass which chunks it admits."""

    def __init__(self, rows: pa.Table, passes: dict[str, tuple[int, str]]):
        self.ids, self.passes, self.n = rows["question_id"], passes, rows.num_rows
        self.units = _units(rows["embedding"])
        self.turned = [np.ascontiguousarray((v / norm[:, None]).T) for _, v, norm in self.units]
        scopes = rows["scope"].to_pylist() if "scope" in rows.column_names else [None] * self.n
        self.is_figure = np.array([bool(x) for x in rows["is_figure"].to_pylist()] if "is_figure" in rows.column_names else [False] * self.n, bool)
        self.unscoped = np.array([not x for x in scopes], bool)
        #: What as many other rows as are asked for reach already.
        self.least = rows["least"].to_numpy() if "least" in rows.column_names else np.full(self.n, -1.0)
        self.asked: dict[str, list[int]] = {}
        for k, scope in enumerate(scopes):
            for item in set(scope or ()):
                self.asked.setdefault(item, []).append(k)

    def _in_scope(self, column: pa.Array) -> np.ndarray:
        code = column.dictionary_encode()
        table = np.zeros((len(code.dictionary) + 1, self.n), bool)
        for k, item in enumerate(code.dictionary.to_pylist()):
            table[k, self.asked.get(item, [])] = True
        return table[code.indices.fill_null(len(code.dictionary)).to_numpy(zero_copy_only=False)]

    def admitted(self, batch: pa.RecordBatch, kind: str) -> np.ndarray | None:
        """(chunks, questions) flags; None if all are admitted."""
        if kind == "all":
            return None
        of = lambda name: batch.column(batch.schema.get_field_index(name))
        pictured = np.array([k in FIGURE_KINDS and bool(h) for k, h in zip(of("kind").to_pylist(), of("has_figure").to_pylist(), strict=True)], bool)
        out = ~self.is_figure | pictured[:, None]
        if kind == "scoped":
            out &= self.unscoped | self._in_scope(of("section_number")) | self._in_scope(of("section_top"))
        return out


class _Search:
    """Batches of chunks go past a block of questions; what comes out can be among the best of a pass so far."""

    def __init__(self, questions: _Questions, columns: list[str], id_col: str):
        self.questions, self.id_col, self.vector_at = questions, id_col, columns.index("embedding")
        self.best = {name: np.tile(questions.least, (k, 1)) for name, (k, _) in questions.passes.items()}
        #: What a chunk has to reach, a pass and question.
        self.reached = {name: questions.least.copy() for name in questions.passes}

    def _cosines(self, own: list, n: int) -> np.ndarray:
        """(chunks, questions), 0 at least; the last digits depend on a row's place."""
        out = np.zeros((n, self.questions.n))
        for rows, v, norm in own:
            for (asked, q, _), turned in zip(self.questions.units, self.questions.turned, strict=True):
                if v.shape[1] != q.shape[1]:
                    continue
                if out.shape == (len(rows), len(asked)):
                    np.matmul(v / norm[:, None], turned, out=out)
                    return np.maximum(out, 0.0, out=out)
                out[np.ix_(rows, asked)] = np.maximum((v / norm[:, None]) @ turned, 0.0)
        return out

    def past(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """The rows found in each batch, and the place of each row's question."""
        questions = self.questions
        for batch in (b.slice(k, CHUNK_BLOCK) for b in batches for k in range(0, b.num_rows, CHUNK_BLOCK)):
            n = batch.num_rows
            if not n or not questions.n:
                continue
            own = _units(batch.column(self.vector_at))
            sims, bars, some, hit = self._cosines(own, n), {}, {}, np.zeros(questions.n, bool)
            for name, (k, kind) in questions.passes.items():
                mask, best, reached = questions.admitted(batch, kind), self.best[name], self.reached[name]
                some[name] = sims if mask is None else np.where(mask, sims, -1.0)
                top = some[name].max(axis=0)
                # Only questions with a nearer row in this batch get a new k-th best.
                nearer = np.flatnonzero(top > reached)
                if len(nearer):
                    merged = np.concatenate((best[:, nearer], some[name][:, nearer]))
                    best[:, nearer] = np.partition(merged, len(merged) - k, axis=0)[len(merged) - k :]
                    reached[nearer] = best[:, nearer].min(axis=0)
                bars[name] = np.maximum(reached - ROUNDING, 0.0)
                hit |= top >= bars[name]
            at = np.flatnonzero(hit)
            flags = {name: some[name][:, at] >= bar[at] for name, bar in bars.items()}
            row, col = np.nonzero(np.logical_or.reduce(list(flags.values())))
            if not len(row):
                continue
            asked = at[col]
            exact = _exact(own, questions.units, row, asked, sims[row, asked])
            # Ties may be any number of rows; no more than are asked for go on, by id.
            order = np.lexsort((_places(batch.column(batch.schema.get_field_index(self.id_col)))[row], -exact, asked))
            marks, first = _foremost({name: f[row, col] for name, f in flags.items()}, order, asked, questions.passes)
            row, asked, exact = row[first], asked[first], exact[first]
            kept = batch.take(pa.array(row)).drop_columns([batch.schema.names[self.vector_at]])
            ids = questions.ids.take(pa.array(asked)).combine_chunks()
            marks = [pa.array(m[first]) for m in marks.values()]
            yield pa.RecordBatch.from_arrays([*kept.columns, ids, pa.array(exact), *marks], names=[*kept.schema.names, "question_id", "sim", *(f"in_{p}" for p in flags)]), asked


class _Group:
    """One group of the grid as its rows stream by, questions first: of the chunks only what can be among the best so far is held."""

    def __init__(self, passes: dict[str, tuple[int, str]], columns: list[str], id_col: str):
        self.passes, self.columns, self.id_col = passes, columns, id_col
        self.asked: list[pa.RecordBatch] = []
        self.search: _Search | None = None
        self.found: list[pa.RecordBatch] = []
        self.places: list[np.ndarray] = []
        self.rows, self.bound = 0, GROUP_ROWS

    def add(self, chunks: pa.RecordBatch) -> None:
        if not self.asked:
            return
        self.search = self.search or _Search(_Questions(pa.Table.from_batches(self.asked), self.passes), self.columns, self.id_col)
        for rows, asked in self.search.past([chunks]):
            self.found.append(rows)
            self.places.append(asked)
            self.rows += len(asked)
            if self.rows > self.bound:
                self._prune()
                self.bound = self.rows + max(self.rows, GROUP_ROWS)

    def _prune(self) -> None:
        """Of what the batches let through, what is among the best of all of them."""
        found, asked = pa.Table.from_batches(self.found), np.concatenate(self.places)
        order = np.lexsort((_places(found[self.id_col].combine_chunks()), -found["sim"].to_numpy(), asked))
        flags, some = _foremost({name: found[f"in_{name}"].to_numpy() for name in self.passes}, order, asked, self.passes)
        for name, flag in flags.items():
            found = found.set_column(found.schema.get_field_index(f"in_{name}"), f"in_{name}", pa.array(flag))
        self.found, self.places = found.filter(pa.array(some)).combine_chunks().to_batches(), [asked[some]]
        self.rows = int(some.sum())

    def best(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self._prune()
            whole = pa.Table.from_batches(self.found)
            yield from pa.Table.from_arrays(whole.columns, names=schema.names).cast(schema).to_batches(max_chunksize=BATCH_ROWS)


def _runs(columns: list[pa.Array]) -> list[tuple[int, int]]:
    """(first row, rows) of the stretches over which no column changes."""
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        new |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False) if n > 1 else False
    first = [0, *(np.flatnonzero(new) + 1).tolist()]
    return [(i, j - i) for i, j in zip(first, [*first[1:], n], strict=True)]


def _foremost(flags: dict[str, np.ndarray], order: np.ndarray, asked: np.ndarray, passes: dict[str, tuple[int, str]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Flags that only the first rows of each question and pass keep, as many as it asks for, and which rows keep any. ``order`` sorts by question, then
    nearest first."""
    out, some = {}, np.zeros(len(asked), bool)
    for name, (k, _) in passes.items():
        mine = order[flags[name][order]]
        starts = np.flatnonzero(np.diff(asked[mine], prepend=-1))
        place = np.arange(len(mine)) - np.repeat(starts, np.diff(np.append(starts, len(mine))))
        out[name] = np.zeros(len(asked), bool)
        out[name][mine[place < k]] = True
        some |= out[name]
    return out, some


def _places(ids: pa.Array) -> np.ndarray:
    """Of each id its place in ascending order."""
    columns = dict(zip(map(str, range(ids.type.num_fields)), ids.flatten(), strict=True)) if pa.types.is_struct(ids.type) else {"0": ids}
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(pa.table(columns), sort_keys=[(c, "ascending") for c in columns], null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return out


def _exact(own: list, units: list, row: np.ndarray, asked: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Cosines of pairs. A product's sums depend on a row's place in the matrix; here each is summed alike, so equal vectors tie. Those that are
    not above 0 stay 0."""
    exact = np.zeros(len(row))
    for rows, v, norm in own:
        for mine, q, q_norm in units:
            if v.shape[1] != q.shape[1]:
                continue
            a, b = np.minimum(np.searchsorted(rows, row), len(rows) - 1), np.minimum(np.searchsorted(mine, asked), len(mine) - 1)
            hits = np.flatnonzero((near > 0) & (rows[a] == row) & (mine[b] == asked)) if len(rows) and len(mine) else []
            for k in range(0, len(hits), PAIR_BLOCK):
                hit = hits[k : k + PAIR_BLOCK]
                exact[hit] = np.maximum((v[a[hit]] * q[b[hit]]).sum(axis=1) / (norm[a[hit]] * q_norm[b[hit]]), 0.0)
    return exact


def _shape(chunks: DataFrame, plans: DataFrame, passes: dict[str, tuple[int, str]]) -> T.StructType:
    fields = [T.StructField(f.name, f.dataType) for f in chunks.schema.fields if f.name != "embedding"]
    return T.StructType([*fields, T.StructField("question_id", plans.schema["question_id"].dataType), T.StructField("sim", T.DoubleType()), *(T.StructField(f"in_{p}", T.BooleanType()) for p in passes)])


def nearest(chunks: DataFrame, plans: DataFrame, passes: dict[str, tuple[int, str]], id_col: str = "chunk_id", block: int | None = None) -> DataFrame:
    """(chunk columns without the vector, question_id, sim, in_<pass>): for every question at least its nearest chunks of each pass, by
    cosine, 0 at least. ``passes``: name to (how many, which chunks: all, figures or scoped). At most ``block`` questions are
    broadcast; more of them meet the chunks block by block."""
    plans = plans.select(*(c for c in ("question_id", "embedding", "scope", "is_figure") if c in plans.columns))
    block = block or QUESTION_BLOCK
    rows = plans.limit(block + 1).toArrow()
    if rows.num_rows > block:
        return grid(chunks, plans, passes, [], id_col, block)
    columns = chunks.columns
    payload = chunks.sparkSession.sparkContext.broadcast(_Questions(rows, passes))
    return chunks.mapInArrow(lambda batches: (b for b, _ in _Search(payload.value, columns, id_col).past(batches)), _shape(chunks, plans, passes))


def grid(chunks: DataFrame, plans: DataFrame, passes: dict[str, tuple[int, str]], keys: list[str], id_col: str = "chunk_id", block: int = QUESTION_BLOCK, numbers: int = BLOCK_NUMBERS, few: bool = False) -> DataFrame:
    """What ``nearest`` gives, for questions and chunks of equal ``keys``; without keys, all of them. A key's questions are dealt by hash to blocks
    of about ``block``, its chunks to blocks of ``numbers`` components or more: there are no more of these than it takes to give every core
    work, so what leaves the grid is some rows a question however many chunks there are. A group is a block of each; its questions are held
    and its chunks stream past, so its memory doesn't grow with them. Chunks go along once for each block of their key's questions, and
    only if it has any. ``few``: there are so few keys that their sizes are broadcast; left to itself Spark may broadcast questions, whose
    repeated vectors are small in files but not in memory."""
    spark = chunks.sparkSession
    bounded_batches(spark)
    shape, columns = _shape(chunks, plans, passes), chunks.columns
    wanted = 2 * spark.sparkContext.defaultParallelism
    asked_blocks = None if keys else max(1, -(-plans.count() // block))
    left, right = (chunks, plans) if keys else (chunks.withColumn("__all", F.lit(0)), plans.withColumn("__all", F.lit(0)))
    few, keys = few or not keys, keys or ["__all"]
    blocks = lambda n, most: F.greatest(F.ceil(n / most), F.lit(1)).cast("int")
    asked = right.groupBy(*keys).agg(blocks(F.count("*"), block).alias("__b"))
    held = left.join(asked.select(*keys), keys, "left_semi").groupBy(*keys).agg(blocks(F.sum(F.coalesce(F.size("embedding"), F.lit(0))), numbers).alias("__a"))
    enough = F.greatest(F.ceil(wanted / F.col("__b")), F.lit(CHUNK_BLOCKS)).cast("int")
    sizes = asked.join(held, keys).select(*keys, "__b", F.least("__a", enough).alias("__a"))
    known = F.broadcast if few else lambda df: df
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(known(sizes), keys).withColumn("__i", of(id_col, "__a")).withColumn("__j", every("__b"))
    right = right.join(known(sizes.toDF(*keys, "__m", "__n")), keys).withColumn("__j", of("question_id", "__m")).withColumn("__i", every("__n"))
    # Questions come first in their group.
    group, asking = [*keys, "__i", "__j"], plans.columns
    left = left.select(*group, F.lit(1).alias("__side"), F.struct(*columns).alias("__c"))
    right = right.select(*group, F.lit(0).alias("__side"), F.struct(*asking).alias("__q"))
    both = right.unionByName(left, allowMissingColumns=True)
    if asked_blocks:  # each group is a task of its own
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), asked_blocks * max(CHUNK_BLOCKS, -(-wanted // asked_blocks)))
        both = both.repartitionById(parts, F.pmod(F.col("__i") * asked_blocks + F.col("__j"), F.lit(parts)))
    else:
        both = both.repartition(*group)
    names, schema, n = both.columns, to_arrow_schema(shape), len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one = None, _Group(passes, columns, id_col)
        for batch in batches:
            of = dict(zip(names, batch.columns, strict=True))
            for first, many in _runs([of[c] for c in (*group, "__side")]) if batch.num_rows else []:
                now = [of[c][first].as_py() for c in group]
                if now != key:
                    yield from one.best(schema)
                    key, one = now, _Group(passes, columns, id_col)
                chunk = of["__side"][first].as_py() == 1
                own = pa.RecordBatch.from_arrays(of["__c" if chunk else "__q"].slice(first, many).flatten(), names=columns if chunk else asking)
                one.add(own) if chunk else one.asked.append(own)
        yield from one.best(schema)

    return both.sortWithinPartitions(*group, "__side").mapInArrow(run, shape)


def within(chunks: DataFrame, plans: DataFrame, passes: dict[str, tuple[int, str]], by: str) -> DataFrame:
    """What ``nearest`` gives, for questions that ask their own document alone."""
    asked = plans.select(*(c for c in (by, "question_id", "embedding", "scope", "is_figure") if c in plans.columns))
    return grid(chunks, asked, passes, [by])


def scoped(chunks: DataFrame, plans: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """What ``nearest`` gives for the pass ``s`` and questions with a scope, by an inverted index: a chunk is posted under its section and its
    top section, a question asks for the items of its scope, and only rows that share one meet. A chunk found by two items is one row."""
    keys = keys or []
    posted = chunks.withColumn("__item", F.explode(F.array_distinct(F.array("section_number", "section_top")))).where("__item is not null")
    asked = plans.select(*keys, "question_id", "embedding", "is_figure", F.explode(F.array_distinct("scope")).alias("__item"))
    found = grid(posted, asked, {"s": (k, "figures")}, [*keys, "__item"]).drop("__item")
    return found.dropDuplicates(["question_id", "chunk_id", *keys])


def _nearest_first(id_col: str = "chunk_id") -> list[Column]:
    return [F.desc("sim"), F.col(id_col)]


def top_k(chunks: DataFrame, plans: DataFrame, k: int, which: str = "all", id_col: str = "chunk_id") -> DataFrame:
    """The k nearest chunks of each question, filtered before ranking; ties by chunk id. Columns of the question follow the chunk's."""
    rows = nearest(chunks, plans, {"k": (k, which)}, id_col).drop("in_k")
    order = Window.partitionBy("question_id").orderBy(*_nearest_first(id_col))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(plans.drop("embedding"), "question_id")


def best_per_group(rows: DataFrame, limit: int) -> DataFrame:
    """In score order, the first of each (section number, kind), and of those the first ``limit``; adds ``ord``."""
    by = [F.desc("score"), F.desc("sim"), F.col("chunk_id")]
    first = Window.partitionBy("question_id", F.coalesce("section_number", F.lit("")), F.coalesce("kind", F.lit(""))).orderBy(*by)
    every = Window.partitionBy("question_id").orderBy(*by)
    return rows.withColumn("__f", F.row_number().over(first)).where("__f = 1").withColumn("ord", F.row_number().over(every)).where(F.col("ord") <= limit).drop("__f")


def retrieve(chunks: DataFrame, plans: DataFrame, limits: Limits = Limits(), by: str | None = None) -> DataFrame:
    """At most top + bonus chunks a question, of all chunks or those of its own document, the column ``by`` of both tables:
    (question_id, chunk columns, sim, score, ord, fallback_used)."""
    passes = passes_of(limits)
    return chosen(nearest(chunks, plans, passes) if by is None else within(chunks, plans, passes, by), plans, limits)


def passes_of(limits: Limits) -> dict[str, tuple[int, str]]:
    """Scoped, global and free of filters."""
    return {"s": (limits.fetch, "scoped"), "g": (limits.fetch, "figures"), "p": (limits.fetch // 2, "all")}


def chosen(found: DataFrame, plans: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What ``retrieve`` gives, of the rows ``found`` by its passes. The scoped pass fetches,
    thresholds, re-ranks and dedups; with fewer than ``min_scoped`` left it gives way to the global pass; otherwise the best
    chunks without any filter follow, as far as they aren't there yet. All of it is windows on rows that met by question once."""
    passes = passes_of(limits)
    nearest_first, by_score = _nearest_first(), [F.desc("score"), F.desc("sim"), F.col("chunk_id")]

    def place(name: str, by: list[Column], *more: Column) -> Column:
        """The place of a flagged row among those flagged: a running count, so passes of one order share one sort."""
        return F.count_if(f"in_{name}").over(Window.partitionBy("question_id", *more).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)).cast("int")

    rows = found.withColumns({f"ord_{name}": place(name, nearest_first) for name in passes})
    rows = rows.withColumns({f"in_{name}": F.col(f"in_{name}") & (F.col(f"ord_{name}") <= k) & (F.col("sim") >= limits.least) for name, (k, _) in passes.items()})
    # What is left is some rows a question; only now they get what the question asks for.
    rows = rows.where("in_s or in_g or in_p").join(plans.select("question_id", "scope", "is_figure", "target_label"), "question_id")
    rows = rows.withColumn("score", F.col("sim") + bonus(F.col("scope"), F.col("is_figure"), F.col("target_label")))
    group = [F.coalesce("section_number", F.lit("")), F.coalesce("kind", F.lit(""))]
    limit = {"s": limits.top, "g": limits.top + limits.bonus}
    rows = rows.withColumns({f"ord_{name}": place(name, by_score, *group) for name in limit})
    rows = rows.withColumns({f"in_{name}": F.col(f"in_{name}") & (F.col(f"ord_{name}") == 1) for name in limit})
    rows = rows.withColumns({f"ord_{name}": place(name, by_score) for name in limit})
    rows = rows.withColumns({f"in_{name}": F.col(f"in_{name}") & (F.col(f"ord_{name}") <= n) for name, n in limit.items()})
    rows = rows.withColumn("enough", F.count_if("in_s").over(Window.partitionBy("question_id")) >= limits.min_scoped)
    fresh = F.col("in_p") & F.col("enough") & ~F.col("in_s")
    rows = rows.withColumn("in_p", fresh).withColumn("ord_p", place("p", nearest_first))
    rows = rows.withColumn("in_p", F.col("in_p") & (F.col("ord_p") <= limits.bonus))
    rows = rows.where((F.col("enough") & (F.col("in_s") | F.col("in_p"))) | (~F.col("enough") & F.col("in_g")))
    turn = F.when(~F.col("enough"), F.col("ord_g")).when(F.col("in_s"), F.col("ord_s")).otherwise(F.col("ord_p") + limits.top)
    score = F.when(F.col("in_p"), F.col("sim")).otherwise(F.col("score"))
    out = rows.withColumns({"ord": turn, "score": score, "fallback_used": ~F.col("enough")})
    return out.drop("enough", *(f"{a}_{b}" for b in passes for a in ("in", "ord")))
