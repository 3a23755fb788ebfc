"""Removal of repeated byte strings by suffix arrays, built with the difference-cover algorithm in parallel blocks.

A string of ``LENGTH`` bytes is assigned to a block by its minimizer, the smallest hash of its ``GRAM``-byte substrings:
equal strings have the same one, so each block can be decided alone, whatever documents its strings come from.
Minimizers that only one document has are dropped first, which leaves the regions that may repeat at all. In each block the
suffixes are sorted by the difference cover modulo 3: triples of sampled suffixes are sorted and named, names recursed on
until they stand for ``LENGTH`` bytes, the remaining suffixes merged in, and neighbours' prefixes compared.

No step gathers what a frequent passage has in all documents. A task that sees a minimizer in two documents answers them itself
and only notes that it is shared, so the task that unites a minimizer gets a number a flush, not one a document. Equal
contexts within a group of documents travel once. Blocks that still hold more than ``SPLIT_STARTS`` string starts, as around a
passage with other neighbours each time, are parted by the whole string: each string goes alone to a part by its hash, and
parts are sorted like blocks. Numbers travel as packed arrays, one row for each pair of groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import IntegralType

from loomspan.llm.common import bounded_batches, named
from loomspan.plans.shared import materialize, release

LENGTH, GRAM = 50, 20
#: Bytes of text in a group of documents, for each block, and hashed at a time: bounds of a task's memory, and small enough
#: for a processor's caches. A document of more is hashed alone.
GROUP_BYTES, BLOCK_BYTES, CHUNK_BYTES = 6_000_000, 1_000_000, 250_000
#: Minimizers that a task gathers before it deals them out: few rows, well filled; documents looked at in one go; and pairs of a
#: minimizer and a document in a row.
FLUSH, SLICE, TOLD = 200_000, 250, 20_000
#: String starts beyond which a block is parted by whole strings; bounds a task's time and memory.
SPLIT_STARTS = 1_500_000
#: Bits of a start's number within its document; those above tell apart the texts of rows that repeat an id.
START_BITS = 40
_NULL = 2**63 - 1
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 2**64))


_cached: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; those for a chunk's length are computed once a worker."""
    have = _cached.get(int(base))
    if have is not None and len(have) >= n:
        return have[:n]
    out, done, factor = np.ones(max(n, 1), np.uint64), 1, int(base)
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(factor)
        factor = factor * factor % 2**64
        done += m
    if n <= 2 * CHUNK_BYTES:
        _cached[int(base)] = out
    return out[:n]


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Mixed polynomial hashes of all ``size``-byte substrings of ``data``."""
    n = len(data)
    if n < size:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    term = data.astype(np.uint64)
    term += np.uint64(1)
    term *= _powers(_P_INVERSE, n)
    np.cumsum(term, out=sums[1:])
    h = sums[size:] - sums[:-size]
    h *= _powers(_P, n - size + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of that many hashes the place of its smallest by the upper 32 bits, the first of equals: the place fills the lower bits."""
    value = h & np.uint64(0xFFFFFFFF00000000)
    value |= np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < window:
        step = min(have, window - have)
        value = np.minimum(value[:-step], value[step:])
        have += step
    return (value & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts that share a minimizer: (document, first start, last start, hash), starts within the document. Texts
    are joined to chunks for numpy's sake; no string crosses documents."""
    parts, chunk, size = [], [], 0
    for k, t in enumerate([*texts, None]):
        if chunk and (t is None or size + len(t) > CHUNK_BYTES):
            parts.append(_anchors_of(chunk, k - len(chunk), length))
            chunk, size = [], 0
        if t is not None:
            chunk.append(t)
            size += len(t)
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none, none.view(np.uint64))


def _anchors_of(texts: list[bytes], number: int, length: int) -> tuple[np.ndarray, ...]:
    size = np.array([len(t) for t in texts], np.int64)
    starts = np.maximum(size - length + 1, 0)
    none = np.empty(0, np.int64)
    if not starts.any():
        return none, none, none, none.view(np.uint64)
    h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
    at = minimizers(h, length - GRAM + 1)
    owner = np.repeat(np.arange(len(texts)), starts)
    local = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    anchor = at[local + np.repeat(np.cumsum(size) - size, starts)]
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
    tail = np.concatenate((head[1:], [len(owner)])) - 1
    return owner[head] + number, local[head], local[tail], h[anchor[head]]


#: Tuples of fewer bits are ranked through a table instead of a sort.
TABLE_BITS = 22


def _bits(*columns: np.ndarray) -> list[int]:
    return [max(int(c.max()).bit_length(), 1) if len(c) else 1 for c in columns]


def _order(key: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Places of whole numbers in order, equal ones in any. Where number and place fit one word together the words are sorted: several
    times as fast as sorting places."""
    places = max(len(key) - 1, 1).bit_length()
    if (_bits(key)[0] if bits is None else bits) + places > 64:
        return np.argsort(key)
    word = key.astype(np.uint64)
    word <<= np.uint64(places)
    word |= np.arange(len(key), dtype=np.uint64)
    word.sort()
    word &= np.uint64((1 << places) - 1)
    return word.view(np.int64)


def _packed_keys(columns: tuple[np.ndarray, ...], bits: list[int]) -> np.ndarray:
    key = columns[0].astype(np.uint64)
    for c, b in zip(columns[1:], bits[1:], strict=True):
        key <<= np.uint64(b)
        key |= c.astype(np.uint64)
    return key


def _ranks(*columns: np.ndarray) -> tuple[np.ndarray, int, np.ndarray | None]:
    """Dense ranks of tuples, first column first, how many there are, and the order they were sorted in (None if there was no sort)."""
    bits = _bits(*columns)
    if not len(columns[0]):
        return np.empty(0, np.int64), 0, np.empty(0, np.int64)
    if sum(bits) <= TABLE_BITS:
        key = _packed_keys(columns, bits)
        have = np.zeros(1 << sum(bits), bool)
        have[key] = True
        rank = np.cumsum(have, dtype=np.int64) - 1
        return rank[key], int(rank[-1]) + 1, None
    if sum(bits) <= 63:
        key = _packed_keys(columns, bits)
        order = _order(key, sum(bits))
        key = key[order]
        differ = key[1:] != key[:-1]
    else:
        order = np.lexsort(columns[::-1])
        differ = np.zeros(len(order) - 1, bool)
        for c in columns:
            differ |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(differ)))
    return out, int(out[order[-1]]) + 1, order


def _below(mine: tuple[np.ndarray, ...], theirs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For sorted tuples of two kinds: of the second kind, those less than each of the first; of the first, those at most each of the second."""
    bits = [max(a, b) for a, b in zip(_bits(*mine), _bits(*theirs), strict=True)]
    if sum(bits) <= 63:
        x, y = _packed_keys(mine, bits), _packed_keys(theirs, bits)
    else:
        dense = _ranks(*(np.concatenate(c) for c in zip(mine, theirs, strict=True)))[0]
        x, y = dense[: len(mine[0])], dense[len(mine[0]) :]
    return np.searchsorted(y, x, side="left"), np.searchsorted(x, y, side="right")


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Starts of ``s`` (numbers from 1) in order of their suffixes, equal ones beyond ``depth`` symbols in any order: difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    if depth <= 1:
        return _order(s)
    padded = np.concatenate((s.astype(np.int64), np.zeros(3, np.int64)))
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with n = 1 modulo 3 a sample past the end closes the first class
    sample = np.concatenate((one, two))
    names, kinds, order = _ranks(padded[sample], padded[sample + 1], padded[np.minimum(sample + 2, n + 2)])
    if kinds < len(sample) and depth > 3:
        order = suffix_array(names + 1, -(-depth // 3))
    elif order is None:
        order = _order(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    dense, _, order = _ranks(padded[zero], rank[zero + 1])
    zero = zero[_order(dense) if order is None else order]
    # Merge: against the first class by (symbol, rank), against the second by (symbol, symbol, rank).
    at = np.empty(n, np.int64)
    at[sampled] = np.arange(len(sampled))
    at[zero] = np.arange(len(zero))
    for k in (1, 2):
        part = sampled[sampled % 3 == k]
        keys = lambda x: (padded[x], rank[x + 1]) if k == 1 else (padded[x], padded[x + 1], rank[x + 2])  # noqa: B023, E731
        mine, theirs = _below(keys(zero), keys(part))
        at[zero] += mine
        at[part] += theirs
    out = np.full(n, -1, np.int64)
    out[at] = np.arange(n)
    return _order(at) if (out < 0).any() else out  # equal beyond the depth: two may claim one place


def repeated(contexts: np.ndarray, first: np.ndarray, valid: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """The smallest document of every string: ``contexts`` joined bytes, each with ``valid`` string starts from ``first`` on and its
    document. Returns one document for each start, in order."""
    used = np.zeros(256, np.int64)
    used[contexts] = 1
    order = suffix_array(np.cumsum(used)[contexts], length)  # few symbols: the first triples are named through a table
    owner = np.repeat(np.arange(len(first)), valid)
    starts = np.repeat(first, valid) + (np.arange(len(owner)) - np.repeat(np.cumsum(valid) - valid, valid))
    index = np.full(len(contexts), -1, np.int64)
    index[starts] = np.arange(len(starts))
    order = index[order]
    order = order[order >= 0]  # starts by their suffixes' order
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.concatenate((contexts, np.zeros(8, np.uint8))), 8)).view("<u8").ravel()
    p, q = starts[order[:-1]], starts[order[1:]]
    same = np.ones(len(p), bool)
    for k in [*range(0, length - 8, 8), length - 8]:
        same &= word[p + k] == word[q + k]
    group = np.concatenate(([0], np.cumsum(~same))) if len(order) else order
    least = np.full(int(group[-1]) + 1 if len(order) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, docs[owner[order]])
    out = np.empty(len(starts), np.int64)
    out[order] = least[group]
    return out


def _packed(target: np.ndarray, kind: str, *columns: np.ndarray) -> list[dict]:
    """Rows (to, kind, a, b, c) with the columns of each target, packed."""
    rows = []
    order = np.argsort(target, kind="stable")
    t = target[order]
    cuts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(t)] if len(t) else [], strict=True):
        part = order[lo:hi]
        rows.append({"to": int(t[lo]), "kind": kind} | {n: np.ascontiguousarray(c[part]).tobytes() for n, c in zip("abc", columns, strict=False)})
    return rows


_ROW = pa.schema([("to", pa.int64()), ("kind", pa.string()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_ROW_SQL = "to long, kind string, n long, a binary, b binary, c binary, d binary"


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_ROW)


def _columns(part: pa.Table, kind: str, kinds: dict[str, str]) -> list[np.ndarray]:
    rows = part.filter(pc.equal(part["kind"], kind))
    return [np.frombuffer(b"".join(rows[n].to_pylist()), np.dtype(t)) for n, t in kinds.items()]


def _cuts(t: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal values of a sorted array."""
    if not len(t):
        return []
    head = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    return list(zip(head.tolist(), [*head[1:].tolist(), len(t)], strict=True))


def _united(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs sorted by ``h``, where each value begins, its smallest document, and whether it has only that one."""
    order = np.argsort(h)
    h, own = h[order], own[order]
    if not len(h):
        return h, own, np.empty(0, np.int64), own, np.empty(0, bool)
    head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    least = np.minimum.reduceat(own, head)
    return h, own, head, least, least == np.maximum.reduceat(own, head)


def _variants(ids: np.ndarray, raws: list[bytes]) -> np.ndarray:
    """For rows that repeat an id, the number of their text among the id's distinct ones, in their order; else 0. All tasks that see
    the rows of an id give the same numbers."""
    out = np.zeros(len(ids), np.int64)
    order = np.argsort(ids, kind="stable")
    for lo, hi in _cuts(ids[order]):
        if hi - lo > 1:
            rows = order[lo:hi].tolist()
            number = {t: k for k, t in enumerate(sorted({raws[r] for r in rows}))}
            out[rows] = [number[raws[r]] for r in rows]
    return out


def _numbered_ids(docs: DataFrame, id_col: str) -> DataFrame | None:
    """(name, id): whole numbers in the order of ids that aren't whole numbers themselves; None if they are."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return None
    names = docs.select(named(id_col).alias("name")).where("name is not null").distinct().orderBy("name")
    return materialize(names.select("name", F.monotonically_increasing_id().alias("id")), "ids")


def find(docs: DataFrame, ids: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, split_starts: int = SPLIT_STARTS) -> tuple[DataFrame, DataFrame]:
    """(spans, numbered): packed starts to remove by group of documents, and the documents with their group."""
    spark = docs.sparkSession
    bounded_batches(spark)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(named(text_col))), F.lit(0))).first()[0]
    groups, blocks, dealers = (max(8, -(-total // k)) for k in (GROUP_BYTES, BLOCK_BYTES, 2 * GROUP_BYTES))
    rows = docs.select(named(id_col).alias("name"), F.coalesce(named(text_col), F.lit("")).cast("binary").alias("raw"))
    rows = rows.withColumn("id", F.col("name").cast("long")) if ids is None else rows.join(ids, "name", "left")
    ident = F.coalesce("id", F.lit(_NULL))
    numbered = rows.select(ident.alias("id"), "raw", F.pmod(F.xxhash64(ident), F.lit(groups)).alias("grp"))

    def fingerprints(batches):
        """Distinct minimizers of each document, to the task that unites a minimizer ("h"). Of one that several documents here have, only
        its number goes there ("m"), and the documents' groups are told through any task ("f")."""
        held, size, turn = [], 0, TaskContext.get().partitionId()

        def dealt():
            nonlocal turn
            h, own = (np.concatenate(x) for x in zip(*held, strict=True))
            h, own, head, least, one = _united(h, own)
            dealer = lambda x: (x % np.uint64(dealers)).astype(np.int64)
            single, several = h[head[one]], h[head[~one]]
            rows = _packed(dealer(single), "h", single, least[one]) + _packed(dealer(several), "m", several)
            told = np.flatnonzero(np.repeat(~one, np.diff(np.append(head, len(h)))))
            for k in range(0, len(told), TOLD):
                turn += 1
                some = told[k : k + TOLD]
                rows += _packed(np.full(len(some), turn % dealers), "f", h[some], own[some])
            return _table(rows).to_batches()

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, batch.num_rows, SLICE):
                owner, _, _, h = _anchors(batch.column(1).slice(k, SLICE).to_pylist(), length)
                if len(h):
                    held.append((h, ids[k : k + SLICE][owner]))
                    size += len(h)
                if size >= FLUSH:
                    yield from dealt()
                    held, size = [], 0
        if size:
            yield from dealt()

    def shared(part: pa.Table) -> pa.Table:
        h, own = _columns(part, "h", {"a": "u8", "b": "i8"})
        (several,) = _columns(part, "m", {"a": "u8"})
        h, own, head, _, one = _united(h, own)
        many = np.repeat(~one | np.isin(h[head], several), np.diff(np.append(head, len(h))))
        fh, fown = _columns(part, "f", {"a": "u8", "b": "i8"})
        h, own = np.concatenate((h[many], fh)), np.concatenate((own[many], fown))
        return _table(_packed(_group_of(own, groups), "s", h, own))

    replies = materialize(numbered.select("id", "raw").mapInArrow(fingerprints, _ROW_SQL).groupBy("to").applyInArrow(shared, _ROW_SQL), "shared")

    def contexts(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Texts of a group with the minimizers that other documents have: contexts to their blocks, and starts decided within the group."""
        ids = left["id"].to_numpy()
        raws = left["raw"].to_pylist()
        variant = _variants(ids, raws)
        # Rows of equal id and text have one answer.
        rows = _firsts(ids, variant)
        ids, variant, raws = ids[rows], variant[rows], [raws[k] for k in rows.tolist()]
        owner, lo, hi, h = _anchors(raws, length)
        sh, sown = _columns(right, "s", {"a": "u8", "b": "i8"}) if right.num_rows else (np.empty(0, np.uint64), np.empty(0, np.int64))
        mark = lambda a, b: a ^ (b.astype(np.uint64) * _P)  # noqa: E731  a chance equality only lets one context more through
        keep = np.isin(mark(h, ids[owner]), mark(sh, sown)) if len(h) else np.empty(0, bool)
        owner, lo, hi, h = owner[keep], lo[keep], hi[keep], h[keep]
        start, count = lo | variant[owner] << START_BITS, hi - lo + 1
        # Equal contexts: the smallest document speaks for all, and the others' starts go at once.
        seen: dict[bytes, int] = {}
        sent, gone = [], []
        for k in np.argsort(ids[owner], kind="stable").tolist():
            c = raws[owner[k]][lo[k] : hi[k] + length]
            j = seen.setdefault(c, k)
            (sent if j == k or ids[owner[j]] == ids[owner[k]] else gone).append(k)
        out = _packed(np.full(len(gone), key[0].as_py(), np.int64), "g", ids[owner[gone]], start[gone], count[gone]) if gone else []
        sent = np.array(sent, np.int64)
        to = (h[sent] % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        t = to[order]
        for a, b in _cuts(t):
            part = sent[order[a:b]]
            text = b"".join(raws[owner[k]][lo[k] : hi[k] + length] for k in part.tolist())
            out.append({"to": int(t[a]), "kind": "c", "n": int(count[part].sum()), "a": ids[owner[part]].tobytes(), "b": start[part].tobytes(), "c": count[part].tobytes(), "d": text})
        return _table(out)

    def parted(batches, parts: int):
        """Contexts of a block of too many starts as single strings, to parts by the string's hash; of equal ones in a row the smallest
        document speaks for all."""
        for batch in batches:
            part = pa.Table.from_batches([batch])
            for row in range(batch.num_rows):
                one = part.slice(row, 1)
                own, base, valid = _columns(one, "c", {"a": "i8", "b": "i8", "c": "i8"})
                text = np.frombuffer(one["d"][0].as_py(), np.uint8)
                first = np.cumsum(valid + length - 1) - (valid + length - 1)
                of = np.repeat(np.arange(len(own)), valid)
                step = np.arange(len(of)) - np.repeat(np.cumsum(valid) - valid, valid)
                at, start, mine = first[of] + step, base[of] + step, own[of]
                for k in range(0, len(at), CHUNK_BYTES // length):
                    chunk = slice(k, k + CHUNK_BYTES // length)
                    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[at[chunk]])
                    _, same = np.unique(strings.view(f"V{length}").ravel(), return_inverse=True)
                    least = np.full(int(same.max()) + 1, _NULL)
                    np.minimum.at(least, same, mine[chunk])
                    late = mine[chunk] > least[same]
                    n = len(late)
                    rows = _packed(_group_of(mine[chunk][late], groups), "g", mine[chunk][late], start[chunk][late], np.ones(int(late.sum()), np.int64))
                    to = blocks + (gram_hashes(strings.ravel(), length)[::length] % np.uint64(parts)).astype(np.int64)
                    stay = np.flatnonzero(~late)
                    stay = stay[np.argsort(to[stay], kind="stable")]
                    for a, b in _cuts(to[stay]):
                        p = stay[a:b]
                        rows.append({"to": int(to[p[0]]), "kind": "c", "n": len(p), "a": mine[chunk][p].tobytes(), "b": start[chunk][p].tobytes(), "c": np.ones(len(p), np.int64).tobytes(), "d": strings[p].tobytes()})
                    yield from _table(rows).to_batches() if n else ()

    def decided(part: pa.Table) -> pa.Table:
        """One block: the starts whose string a smaller document has, by group of documents."""
        own, base, valid = _columns(part, "c", {"a": "i8", "b": "i8", "c": "i8"})
        text = b"".join(part["d"].to_pylist())
        if not len(own):
            return _table([])
        size = valid + length - 1
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        # Equal contexts once, with their smallest document.
        known: dict[bytes, int] = {}
        kind = np.array([known.setdefault(text[a : a + b], len(known)) for a, b in zip(first.tolist(), size.tolist(), strict=True)])
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, own)
        distinct = list(known)
        v = np.array([len(x) - length + 1 for x in distinct])
        f = np.concatenate(([0], np.cumsum(v + length - 1)[:-1]))
        found = repeated(np.frombuffer(b"".join(distinct), np.uint8), f, v, least, length)
        at = np.cumsum(v) - v
        # Runs of starts that go, of each context as it came.
        index = np.repeat(at[kind], valid) + (np.arange(valid.sum()) - np.repeat(np.cumsum(valid) - valid, valid))
        of = np.repeat(np.arange(len(own)), valid)
        goes = found[index] < own[of]
        place = np.repeat(base, valid) + (np.arange(len(of)) - np.repeat(np.cumsum(valid) - valid, valid))
        edge = np.concatenate(([True], (of[1:] != of[:-1]) | (goes[1:] != goes[:-1])))
        head = np.flatnonzero(edge)
        count = np.diff(np.append(head, len(of)))
        pick = goes[head]
        return _table(_packed(_group_of(own[of[head[pick]]], groups), "g", own[of[head[pick]]], place[head[pick]], count[pick]))

    made = materialize(numbered.groupBy("grp").cogroup(replies.groupBy("to")).applyInArrow(contexts, _ROW_SQL), "contexts")
    release(replies)
    sent, told = made.where("kind = 'c'"), made.where("kind = 'g'")
    large = sent.groupBy("to").agg(F.sum("n").alias("starts")).where(F.col("starts") > split_starts)
    starts = large.agg(F.sum("starts")).first()[0]
    if starts:
        parts = -(-starts * length // BLOCK_BYTES)
        large = large.select("to")
        alone = materialize(sent.join(large, "to", "left_semi").select(*_ROW.names).mapInArrow(lambda batches: parted(batches, parts), _ROW_SQL), "contexts")
        sent = sent.join(large, "to", "left_anti").select(*_ROW.names).unionByName(alone.where("kind = 'c'"))
        told = told.unionByName(alone.where("kind = 'g'"))
    spans = materialize(sent.groupBy("to").applyInArrow(decided, _ROW_SQL).unionByName(told), "spans")
    release(made, *([alone] if starts else []))
    return spans, numbered


def _firsts(ids: np.ndarray, variant: np.ndarray) -> np.ndarray:
    """The first row of each pair, in the rows' order."""
    if not len(ids):
        return np.empty(0, np.int64)
    order = np.lexsort((variant, ids))
    new = np.concatenate(([True], (ids[order][1:] != ids[order][:-1]) | (variant[order][1:] != variant[order][:-1])))
    return np.sort(order[new])


def _group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents, as Spark's pmod(xxhash64(id), groups) gives it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    with np.errstate(over="ignore"):
        h = np.full(len(ids), 42, np.uint64) + p5 + np.uint64(8)
        h ^= turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> np.uint64(32)
    return np.mod(h.view(np.int64), groups)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, split_starts: int = SPLIT_STARTS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) for every row: each text's UTF-8 bytes without those covered by a ``length``-byte
    string that a document of a smaller id has too. Judged on the input; overlaps count; strings don't cross documents; null counts
    as empty. Ids of any type that can be ordered; null comes last. Rows that repeat an id count as one document: nothing is removed
    from one for the other, and each keeps its own text. Long texts are read whole; only the two named columns are read, so no
    other name clashes; an empty table gives no row."""
    ids = _numbered_ids(docs, id_col)
    spans, numbered = find(docs, ids, id_col, text_col, length, split_starts)

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, raws = left["id"].to_numpy(), left["raw"].to_pylist()
        own, start, count = _columns(right, "g", {"a": "i8", "b": "i8", "c": "i8"}) if right.num_rows else (np.empty(0, np.int64),) * 3
        variant = _variants(ids, raws)
        # A number for each id and text that orders spans and rows alike.
        known, many = np.unique(np.concatenate((ids, own))), int(variant.max(initial=0)) + 1
        row, span = np.searchsorted(known, ids) * many + variant, np.searchsorted(known, own) * many + (start >> START_BITS)
        start = start & (1 << START_BITS) - 1
        order = np.argsort(span, kind="stable")
        span, start, count = span[order], start[order], count[order]
        lo, hi = np.searchsorted(span, row, side="left"), np.searchsorted(span, row, side="right")
        n, removed, runs, kept = [], [], [], []
        for raw, a, b in zip(raws, lo.tolist(), hi.tolist(), strict=True):
            n.append(len(raw))
            if a == b:
                removed.append(0)
                runs.append(0)
                kept.append(raw)
                continue
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, start[a:b], 1)
            np.add.at(edge, start[a:b] + count[a:b] + length - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(kept, pa.binary())})

    out = numbered.groupBy("grp").cogroup(spans.groupBy("to")).applyInArrow(finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    if ids is None:
        name = F.when(F.col("id") != _NULL, F.col("id")).cast(docs.schema[id_col].dataType)
    else:
        out, name = out.join(ids, "id", "left"), F.col("name")
    return out.select(name.alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    from loomspan.llm.common import table

    return remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
with doc as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
win as (select doc_id, i, substring(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) as i from doc)),
earliest as (select s, min(doc_id) as m from win group by s having min(doc_id) < max(doc_id)),
gone as (select doc_id, i from win join earliest using (s) where doc_id > m),
island as (
  select doc_id, i, sum(cast(p is null or i > p + 50 as int)) over (partition by doc_id order by i) as g
  from (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from gone)),
run as (select doc_id, min(i) as a, max(i) + 50 as b from island group by doc_id, g),
piece as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from run
  union all select doc_id, max(b), null from run group by doc_id),
kept as (select doc_id, string_agg(substring(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' order by a) as h from piece join doc using (doc_id) group by doc_id),
total as (select doc_id, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans from run group by doc_id)
select doc.doc_id, length(doc.h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.h, doc.h))) as kept_sha256
from doc left join kept using (doc_id) left join total using (doc_id)
"""
