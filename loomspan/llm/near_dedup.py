"""MinHash near-dedup with an LSH forest.

Each distinct shingle set gets ``TREES`` sequences of ``DEPTH`` min-hashes. A tree is the global sorted order of its
sequences, range-partitioned, so neighbours have the longest common prefixes. Candidates are neighbours in an order, and a set
with the first one of its region, all of whose sequences share a prefix. How long that prefix is adapts to the region: where few
sets share the shortest one, ``depth_for`` values, it is that; where a run of sets is denser than ``DENSE``, it is as many values more
as bring the set among the first of its run. Candidates are confirmed on full shingle sets and united to components.

Regions (equal first ``depth_for`` values in a tree) that still hold several components after that get one more step, so that
no candidate is capped away: what lies outside a region's largest component is the query set, compared with the whole region in
blocks of bounded rows and shingles; signatures and full sets are compared within the block, and only links leave it.

Sets that are equal (128 bits of hash of the whole set) are one node from the start, whatever the number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import bounded_batches, named, small_side
from loomspan.llm.graph import components, forest, united
from loomspan.plans.shared import materialize, release

SHINGLE, SIMILARITY = 5, 0.8
TREES, DEPTH = 16, 8
#: Chance that a pair at the similarity shares the depth in no tree.
MISS = 1e-5
#: Distance in a tree's order up to which neighbours are candidates at first, and sets in a region before it is taken deeper.
REACH, DENSE = 2, 32
#: Most rows, and most shingles of all its rows, in one side of a block of the last step: bounds a task's time and memory.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def depth_for(similarity: float, trees: int = TREES) -> int:
    """Most values that a prefix may need so that a pair at ``similarity`` is missed with a chance of ``MISS`` at most."""
    depth = 1
    while depth < DEPTH and (1 - similarity ** (depth + 1)) ** trees <= MISS:
        depth += 1
    return depth


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; a shorter sequence of words counts as one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter([digest(w) for w in words], np.uint64, n)
    k = min(n, size)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out += h[j : n - k + 1 + j] * _ODD[j % 64] + np.uint64(j // 64)
        if k > 64:
            out *= _ODD[0]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> bytes:
    """``TREES * DEPTH`` min-hashes as big-endian 32-bit numbers, so that bytes sort as numbers do."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        x = np.multiply.outer(_A, hashes[i : i + 2048])
        x += _B[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, n, key, sig): size, 128-bit hash and min-hashes of each row's set; key and sig are null for empty sets."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_set(text, shingle)
                n.append(len(hashes))
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                sigs.append(signature(hashes) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n", "key", "sig"])

    return docs.select(named(id_col), named(text_col)).mapInArrow(run, f"id {kind}, n long, key binary, sig binary")


def _ordered(rows: DataFrame, partitions: int) -> DataFrame:
    """The trees' orders: (tree, path, id) sorted over range partitions. The id is part of the order, so a
    region of any size is spread over partitions."""
    spread = rows.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    # substring() of a column: the start depends on the tree
    paths = spread.select("tree", F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("path"), "id")
    return paths.repartitionByRange(partitions, "tree", "path", "id").sortWithinPartitions("tree", "path", "id")


def _neighbours(order: DataFrame, kind: str, depth: int, far: int) -> DataFrame:
    """(a, b, lcp, tree, path): a < b of rows up to ``far`` apart in one tree and partition that share ``depth`` values, and of a row and the
    first of its region; and, with null b and lcp, the first and last ``far`` rows of each partition, which have neighbours in others."""

    def pairs(x: np.ndarray, y: np.ndarray, lcp: np.ndarray, of: pa.DataType) -> pa.RecordBatch:
        swap = x > y
        columns = [pa.array(np.where(swap, y, x), of), pa.array(np.where(swap, x, y), of), pa.array(lcp.astype(np.int32))]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.binary())], names=["a", "b", "lcp", "tree", "path"])

    def border(t: np.ndarray, p: np.ndarray, i: np.ndarray, of: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(i, of), pa.nulls(len(i), of), pa.nulls(len(i), pa.int32()), pa.array(t, pa.int32()), pa.array([x.astype(">u4").tobytes() for x in p], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "lcp", "tree", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = path = ids = None
        begun, of = 0, None
        # Of the run of rows that share the first d values: its first id, and how many rows it has had.
        depths = range(depth, DEPTH + 1)
        first_id, had = dict.fromkeys(depths), dict.fromkeys(depths, 0)
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False)
            p = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u4").reshape(-1, DEPTH).astype(np.uint32)
            i = batch.column(2).to_numpy(zero_copy_only=False)
            fresh, of = len(t), batch.schema.field(2).type
            if not fresh:
                continue
            if begun < far:
                yield border(t[: far - begun], p[: far - begun], i[: far - begun], of)
                begun += fresh
            shared = np.zeros(fresh, np.int64)  # values shared with the row before
            if tree is not None and tree[-1] == t[0]:
                shared[0] = np.cumprod(path[-1] == p[0]).sum()
            shared[1:] = np.where(t[1:] == t[:-1], np.cumprod(p[1:] == p[:-1], axis=1).sum(axis=1), 0)
            hub, lcp = np.zeros(fresh, i.dtype), np.zeros(fresh, np.int64)
            for d in reversed(depths):
                begins = shared < d
                head = np.maximum.accumulate(np.where(begins, np.arange(fresh), -1))  # -1: the run came with the batch before
                place = np.where(head >= 0, np.arange(fresh) - head, had[d] + np.arange(fresh))
                near = (place < DENSE) if d < DEPTH else np.ones(fresh, bool)
                owner = np.where(head >= 0, i[np.maximum(head, 0)], i[0] if first_id[d] is None else first_id[d])
                hub[near], lcp[near] = owner[near], np.where(place[near] > 0, d, 0)
                first_id[d], had[d] = owner[-1], int(place[-1]) + 1
            good = (lcp > 0) & (hub != i)
            if good.any():
                yield pairs(hub[good], i[good], lcp[good], of)
            if tree is not None:
                t, p, i = np.concatenate((tree, t)), np.concatenate((path, p)), np.concatenate((ids, i))
            for w in range(1, min(far, len(t) - 1) + 1):
                second = np.arange(max(len(t) - fresh, w), len(t))  # pairs of carried rows are done
                first = second - w
                same = p[first] == p[second]
                good = (t[first] == t[second]) & same[:, :depth].all(axis=1) & (i[first] != i[second])
                if good.any():
                    yield pairs(i[first[good]], i[second[good]], np.cumprod(same[good], axis=1).sum(axis=1), of)
            tree, path, ids = t[-far:], p[-far:], i[-far:]
        if tree is not None:
            yield border(tree, path, ids, of)

    return order.mapInArrow(run, f"a {kind}, b {kind}, lcp int, tree int, path binary")


def _candidates(order: DataFrame, kind: str, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b, weight): neighbours of the whole order, those across a border of partitions too; and the tables they are read from.
    A pair may come twice."""
    found = materialize(_neighbours(order, kind, depth, REACH).groupBy("a", "b", "tree", "path").agg(F.sum("lcp").alias("weight")), "neighbours")
    # bound: 2 * REACH rows a partition
    rows = found.where("b is null").select("tree", "path", F.col("a").alias("id")).repartition(1).sortWithinPartitions("tree", "path", "id")
    over = _neighbours(rows, kind, depth, REACH).where("b is not null").groupBy("a", "b").agg(F.sum("lcp").alias("weight"))
    over = materialize(over, "neighbours")
    return found.where("b is not null").select("a", "b", "weight").unionByName(over), [found, over]


def _agreement(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """Pairs whose signatures agree in ``least`` values at least."""
    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint32).reshape(-1, TREES * DEPTH) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose full sets reach the similarity, as edges (u, v). 100 * intersection >= 100 * similarity * union in whole numbers."""
    per_mille = round(1000 * similarity)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                total = np.concatenate((x, y))
                total.sort(kind="stable")
                shared = int((total[1:] == total[:-1]).sum())
                good.append(1000 * shared >= per_mille * (len(total) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_())).rename_columns(["u", "v"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"u {kind}, v {kind}")


def _sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, hashes) of the members; of rows that repeat an id those whose set is the member's."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            same = [xxhash.xxh3_128_digest(x.tobytes()) == key for x, key in zip(sets, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "hashes"]).filter(pa.array(same, pa.bool_()))

    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).join(members.select("id", "key"), "id")
    return rows.select("id", "text", "key").mapInArrow(run, f"id {kind}, hashes binary")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``: the smallest id reachable over pairs of sets that reach
    ``similarity``. Words are split at ASCII white space after lower-casing A-Z. Null texts and texts without words have an
    empty set and are linked with nothing, as are rows with a null id (whose component is null). Rows that repeat an id
    count as one document: each of their texts is compared, and what is linked with one of them is linked with all. Long texts are read whole;
    only the two named columns are read, so no other name clashes; an empty table gives no row. ``similarity`` counts to three decimals."""
    spark = docs.sparkSession
    bounded_batches(spark)
    depth = depth_for(similarity)
    own = materialize(signatures(docs, id_col, text_col, shingle), "signatures")
    kind = own.schema["id"].dataType.simpleString()
    full = own.where("n > 0 and id is not null")
    if not full.groupBy("id").agg((F.min("key") != F.max("key")).alias("several")).where("several").isEmpty():
        return _link_sets(own, docs, id_col, text_col, shingle, similarity)
    nodes = materialize(full.groupBy("key").agg(F.min("id").alias("rep")), "nodes")
    reps = own.where("sig is not null").join(nodes.select(F.col("rep").alias("id")), "id", "left_semi")
    reps = reps.groupBy("id").agg(F.max(F.struct("n", "key", "sig")).alias("x"), F.count(F.lit(1)).alias("times")).select("id", "x.*", "times")
    reps = materialize(reps, "reps")
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Signature agreement of a pair at the similarity is binomial; six standard deviations below it nothing is lost.
    m = TREES * DEPTH
    least = int(m * similarity - 6 * (m * similarity * (1 - similarity)) ** 0.5)

    found, tables = _candidates(_ordered(reps, partitions), kind, depth)
    roots = None if found.isEmpty() else _roots(found, docs, reps, id_col, text_col, shingle, similarity, depth, least)
    release(reps, *tables)
    if roots is None:
        by_key = nodes.select("key", F.col("rep").alias("component_id"))
    else:
        by_key = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("key", F.coalesce("root", "rep").alias("component_id"))
    linked = full.select("id", "n", "key").join(by_key, "key").select("id", F.col("n").alias("n_shingles"), "component_id")
    alone = own.where("n = 0 or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def _link_sets(own: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """``link`` for a table in which an id has several sets: sets are linked under numbers of their own, and the components of sets that share an
    id are united."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_sets = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in own_sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0)], names=["key", "text"])

    texts = docs.where(named(id_col).isNotNull()).select(named(text_col).alias("text")).mapInArrow(run, "key binary, text string")
    sets = materialize(texts.where("key is not null").dropDuplicates(["key"]).select(F.monotonically_increasing_id().alias("node"), "key", "text"), "set-texts")
    linked = link(sets, "node", "text", shingle, similarity).select(F.col("id").alias("node"), F.col("component_id").alias("c"))
    full = own.where("n > 0 and id is not null")
    at = full.select("id", "key").distinct().join(sets.select("key", "node"), "key").join(linked, "node").select("id", "c").distinct()
    at = materialize(at, "set-components")
    release(sets)
    top = components(at.join(at.groupBy("id").agg(F.min("c").alias("u")), "id").where("c <> u").select("u", F.col("c").alias("v")))
    at = at.join(top.withColumnRenamed("node", "c"), "c", "left").select("id", F.coalesce("root", "c").alias("root")).distinct()
    by_id = at.join(at.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("id", "component_id")
    rows = full.select("id", F.col("n").alias("n_shingles")).join(by_id, "id")
    alone = own.where("n = 0 or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return rows.unionByName(alone)


def _roots(found: DataFrame, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, depth: int, least: int) -> DataFrame:
    """(node, root) of the components over all links that share a region, from the candidates ``found``."""
    members = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).distinct()
    members = materialize(members.join(reps, "id"), "members")
    sets = _sets(docs, members, id_col, text_col, shingle)
    # Rows that repeat an id have one set; without such rows there is nothing to exchange for it.
    sets = materialize(sets if members.where("times > 1").isEmpty() else sets.dropDuplicates(["id"]), "sets")
    # One likely edge for each node first, to a smaller one: most other candidates then lie within a component.
    best = found.groupBy("b").agg(F.max_by("a", F.struct("weight", "a")).alias("a")).select("a", "b")
    roots = forest(_confirmed(best, sets, similarity).select(F.col("v").alias("node"), F.col("u").alias("parent")))

    def add(fresh: DataFrame) -> None:
        nonlocal roots
        fresh = materialize(fresh, "links")
        if not fresh.isEmpty():
            roots = united(roots, fresh)
        release(fresh)

    add(_confirmed(_across(found, roots, least, reps), sets, similarity))
    regions = _open_regions(members, roots, depth)
    if not regions.isEmpty():
        add(_block_links(regions, members, sets, similarity, least, depth))
    release(regions, members, sets)
    return roots


def _open_regions(members: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(tree, region, id, n, c, k) of the regions with several components and more members than the neighbours' distance covers."""
    at = members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "sig", F.coalesce("root", "id").alias("c"))
    spread = at.select("id", "n", "c", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    spread = spread.select("tree", F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * depth})").alias("region"), "id", "n", "c")
    wide = spread.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c0"), F.max("c").alias("c1")).where(f"k > {REACH + 1} and c0 <> c1").select("tree", "region", "k")
    # Written first: a join whose sides are both read from exchanges can be split where a region is hot.
    wide = materialize(wide, "wide")
    out = materialize(spread.join(wide, ["tree", "region"]), "regions")
    release(wide)
    return out


def _block_links(regions: DataFrame, members: DataFrame, sets: DataFrame, similarity: float, least: int, depth: int) -> DataFrame:
    """Links (u, v) between the query set of each region, what lies outside its largest component, and the whole region."""
    per = regions.groupBy("tree", "region", "c").agg(F.count(F.lit(1)).alias("of_c"), F.sum("n").alias("n_c"))
    main = per.groupBy("tree", "region").agg(F.max(F.struct("of_c", "c", "n_c")).alias("m"), F.sum("of_c").alias("rows"), F.sum("n_c").alias("n"))
    blocks = lambda rows, n: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")
    main = main.select("tree", "region", F.col("m.c").alias("main"), blocks(F.col("rows") - F.col("m.of_c"), F.col("n") - F.col("m.n_c")).alias("nq"), blocks(F.col("rows"), F.col("n")).alias("nm"))
    main = materialize(main, "main")
    rows = regions.drop("k", "n").join(main, ["tree", "region"])
    turn = F.xxhash64("id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = rows.select("tree", "region", "id", "c", F.lit(False).alias("asks"), F.pmod(turn, "nm").cast("int").alias("mb"), each("nq").alias("qb"))
    query = rows.where("c <> main").select("tree", "region", "id", "c", F.lit(True).alias("asks"), F.pmod(turn, "nq").cast("int").alias("qb"), each("nm").alias("mb"))
    # signature and set in one row, so that a block's rows are joined once
    block = whole.unionByName(query).join(members.select("id", "sig").join(sets, "id"), "id").select("tree", "region", "mb", "qb", "id", "c", "asks", "sig", "hashes")
    per_mille = round(1000 * similarity)
    kind = regions.schema["id"].dataType.simpleString()

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        tree = part["tree"][0].as_py()
        ids, comp, asks = (part[k].to_numpy() for k in ("id", "c", "asks"))
        sig = np.frombuffer(b"".join(part["sig"].to_pylist()), dtype=np.uint32).reshape(-1, TREES, DEPTH)
        own = [np.frombuffer(x, np.uint64) for x in part["hashes"].to_pylist()]
        size = np.array([len(x) for x in own])
        flat = sig.reshape(len(sig), -1)
        base = np.flatnonzero(~asks)
        group = {c: c for c in set(comp.tolist())}

        def top(c):
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c

        u, v = [], []
        for q in np.flatnonzero(asks).tolist():
            other = base[(comp[base] != comp[q]) & (ids[base] != ids[q])]
            if not len(other):
                continue
            # the sizes and signatures must allow it, and the first tree that has both in one region does the work
            fits = 1000 * np.minimum(size[other], size[q]) >= per_mille * np.maximum(size[other], size[q])
            other = other[fits]
            agree = (flat[other] == flat[q]).sum(axis=1)
            first = ~(sig[other, :tree, :depth] == sig[q, :tree, :depth]).all(axis=2).any(axis=1)
            good = first & (agree >= least)
            other, agree = other[good], agree[good]
            for m in other[np.argsort(-agree, kind="stable")].tolist():
                if top(comp[q].item()) == top(comp[m].item()):
                    continue
                total = np.concatenate((own[q], own[m]))
                total.sort(kind="stable")
                shared = int((total[1:] == total[:-1]).sum())
                if 1000 * shared >= per_mille * (len(total) - shared):
                    u.append(ids[q])
                    v.append(ids[m])
                    group[top(comp[q].item())] = top(comp[m].item())
        of = part.schema.field("id").type
        return pa.table({"u": pa.array(u, of), "v": pa.array(v, of)})

    return block.groupBy("tree", "region", "mb", "qb").applyInArrow(run, f"u {kind}, v {kind}")


def _across(found: DataFrame, roots: DataFrame, least: int, reps: DataFrame) -> DataFrame:
    """Candidates between components, as far as signatures allow the similarity."""
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    open_ = found.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    return _agreement(open_, reps, least)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns whatever their names, with one document of each component: the one with the smallest id, all of its rows if
    they repeat it. Rows with a null id stay."""
    found = link(docs, id_col, text_col, shingle, similarity)
    gone = materialize(found.where("component_id <> id").select("id").distinct(), "gone")
    gone = small_side(gone, F.lit(1))
    return docs.join(gone, docs[id_col] == gone["id"], "left_anti")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document: three-word shingles, similarity 0.85."""
    from loomspan.llm.common import table

    found = link(table(spark, sf_dir, "documents"), shingle=3, similarity=0.85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


OP3_SQL = r"""
with recursive doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingle as (
  select distinct doc_id, s from (
    select doc_id, array_to_string(w[i:i + 2], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from doc where len(w) >= 3)
    union all select doc_id, array_to_string(w, ' ') from doc where len(w) between 1 and 2)),
size as (select doc_id, count(*) as n from shingle group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
edge as (select a, b from link union all select b, a from link),
reach as (select doc_id, doc_id as far from documents union select r.doc_id, e.b from reach r join edge e on e.a = r.far),
least as (select doc_id, min(far) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from least left join size using (doc_id)
"""
