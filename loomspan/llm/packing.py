"""Best-fit packing of tokenized documents by the sum-of-squares rule.

Tokenizing runs once, in Arrow batches without a shuffle; what goes on is one narrow row a piece (ids stay behind,
only their count and checksum travel). Packing is online within blocks of ``BLOCK`` pieces: a piece goes to the open
bin, or a new one, for which the sum over gaps g of N(g) squared becomes smallest, N(g) being the number of open bins
with g tokens left (Csirik et al., 2006). The waste of that rule grows more slowly than the number of pieces, so a block
of a quarter of a million leaves a few dozen sequences partly filled, and blocks run on any number of executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import bounded_batches, named
from loomspan.plans.shared import materialize

CAPACITY, END_ID = 4096, 1
#: Pieces packed by one task: bounds its time and memory, whatever the size of the corpus.
BLOCK = 250_000
#: Words whose ids a worker remembers in each of two generations, their bytes and those of their ids, and bytes of the longest one:
#: some 100 MB each with what Python adds to a word.
REMEMBERED, REMEMBERED_BYTES, LONGEST = 500_000, 40_000_000, 200
#: ASCII punctuation that the tokenizer splits from a letter before it. The apostrophe isn't among it: it starts contractions.
_TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


class WordTokenizer:
    """Token ids of whole texts. A tokenizer that splits at white space before anything else never looks across it, so ids are
    looked up by white-space separated chunk and only unknown chunks are encoded. Each shortcut is taken only if probes show
    that the tokenizer allows it: ``safe``, it splits so (else each text is encoded whole); ``folds``, it lower-cases A-Z;
    ``parts``, it splits ASCII punctuation from a word before it."""

    _loaded: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.safe, self.folds, self.parts = self._splits_at_space(), self._folds_case(), self._parts_tails()
        self.known: dict[bytes, bytes] = {}  # the newer of two generations: what is used stays
        self.older: dict[bytes, bytes] = {}
        self.size = 0  # bytes in the newer one

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _splits_at_space(self) -> bool:
        probes = ("Is it's 12 ab\n\t'll (re)do,  don't! x", " A-b C_d\r\n\r\nUPPER lower MiXed 3.14 1,000 50% $5 é ß İ ñ 中文 🎉 a/b <x> \"q\" ... --- #tag @me ", "ends in space \n ")
        return all(self._encode(p) == b"".join(self._encode(x) for x in p.split()) for p in probes)

    def _folds_case(self) -> bool:
        probes = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "The Quick BROWN fOX Jumps", "McDonald's I'LL NASA-Esa Île ÉCOLE Straße")
        return all(self._encode(p) == self._encode(p.encode().lower().decode()) for p in probes)

    def _parts_tails(self) -> bool:
        marks = _TAIL.decode()
        return all(self._encode("word" + x + y) == self._encode("word") + self._encode(x + y) for x in marks for y in ["", *marks])

    def _encode(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunk: bytes) -> bytes:
        """Ids of a chunk that isn't in the newer generation. A word with punctuation after it is put together each time:
        cheaper than to remember every pair of them."""
        body = chunk.rstrip(_TAIL) if self.parts else chunk
        if body and len(body) < len(chunk) and (body[-1] in b"abcdefghijklmnopqrstuvwxyz") and b"<" not in chunk:
            tail = chunk[len(body) :]
            return (self.known.get(body) or self._learn(body)) + (self.known.get(tail) or self._learn(tail))
        out = self.older.get(chunk)
        if out is None:
            out = self._encode(chunk.decode("utf-8", "replace"))
        if len(chunk) <= LONGEST:
            if len(self.known) >= REMEMBERED or self.size >= REMEMBERED_BYTES:
                self.known, self.older, self.size = {}, self.known, 0
            self.known[chunk] = out
            self.size += len(chunk) + len(out)
        return out

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.safe:
            return self._encode(text)
        raw = text.encode("utf-8", "replace")
        if self.folds and b"<|" not in raw:  # the special tokens' strings are case-sensitive
            raw = raw.lower()
        chunks = raw.split()
        found = list(map(self.known.get, chunks))
        if None in found:
            found = [self._learn(x) if y is None else y for x, y in zip(chunks, found, strict=True)]
        return b"".join(found)


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row a piece: (id, piece, start, length, ids_crc32[, ids]). A null text counts as empty, so it is the end id
    alone; texts longer than ``capacity`` are cut, and only those. Every row of ``docs`` gives pieces, repeated ones too."""
    bounded_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer.of(tokenizer_path)
        for batch in batches:
            at, piece, start, length, crc, own = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(tok.ids(text or "") + end)
                n = len(ids) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    part = ids[4 * s : 4 * min(n, s + capacity)]
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        own.append(bytes(part))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(own, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(named(id_col), named(text_col)).mapInArrow(run, schema)


class SumOfSquares:
    """Online packing into bins of ``capacity``; ``put`` returns (bin, offset)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # N(g), open bins by what is left; N(0) and N(capacity) count nothing
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def put(self, size: int) -> tuple[int, int]:
        cap, n = self.capacity, self.count
        # From gap h to h - size the sum changes by (N(h)-1)^2 - N(h)^2 + (N(h-size)+1)^2 - N(h-size)^2 = 2 (N(h-size) - N(h)) + 2;
        # a full bin counts nothing, nor does one before its first piece: by 2 N(h-size) + 1 from a new one, by 1 - 2 N(h) to a full one.
        new = 2 * int(n[cap - size]) + 1 if size < cap else 0
        best, gap = new, cap
        if size < cap:
            # Gap `size` exactly: the bin becomes full.
            if n[size] and (full := 1 - 2 * int(n[size])) <= best:
                best, gap = full, size
            here = n[size + 1 : cap]
            if len(here):
                change = np.where(here > 0, 2 * (n[1 : cap - size] - here) + 2, np.iinfo(np.int64).max)
                k = int(change.argmin())  # ties: the smallest gap, so the fullest bin
                if change[k] < best or change[k] == best and gap == cap:
                    best, gap = int(change[k]), size + 1 + k
        if gap == cap:
            where, offset = self.bins, 0
            self.bins += 1
        else:
            where, offset = self.open[gap].pop()
            n[gap] -= 1
        if left := gap - size:
            self.open[left].append((where, offset + size))
            n[left] += 1
        return where, offset


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``pieces`` (id, piece, length, any other columns) with ``sequence_id`` and a gapless ``offset`` in that sequence.
    Pieces that fill a sequence take one each. The others are dealt by hash to blocks, and a block is packed in hash order,
    ties by id and piece: the rule is made for mixed sizes, and the result doesn't depend on the partitioning."""
    bounded_batches(pieces.sparkSession)
    rest = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block))
    rest_cols = [f.name for f in pieces.schema.fields]

    def run(key: tuple, part: pa.Table) -> pa.Table:
        # Ids never leave Arrow: pandas would make numbers beside a null inexact.
        keys = pa.table({"hash": part["__hash"], "id": part[id_col], "piece": part["piece"]})
        part = part.take(pc.sort_indices(keys, sort_keys=[("hash", "ascending"), ("id", "ascending"), ("piece", "ascending")], null_placement="at_start"))
        bins = SumOfSquares(capacity)
        put = [bins.put(x) for x in part["length"].to_pylist()]
        number = key[0].as_py()
        part = part.select(rest_cols)
        return part.append_column("sequence_id", pa.array([number + blocks * x for x, _ in put], pa.int64())).append_column("offset", pa.array([x for _, x in put], pa.int64()))

    hashed = F.xxhash64(named(id_col).cast("string"), F.col("piece"))
    filled = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    packed = rest.withColumns({"__hash": F.floor(hashed / blocks), "__block": F.pmod(hashed, F.lit(blocks)).cast("long")}).groupBy("__block").applyInArrow(run, filled)
    # Negative numbers never meet those of the blocks.
    alone = pieces.where(F.col("length") >= capacity).select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def best_fit(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize and pack: (id, piece, start, length, ids_crc32, sequence_id, offset). Null and empty texts are the end id alone; ids of any
    type, null ones too, come back as they are; repeated rows are packed each; texts of any length are read whole; only the two
    named columns are read, so others can't clash. An empty table gives no row."""
    pieces = materialize(tokenized(docs, tokenizer_path or default_tokenizer(), id_col, text_col, capacity, end_id), "pieces")
    return pack(pieces, id_col, capacity)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    from loomspan.llm.common import table

    return best_fit(table(spark, sf_dir, "documents"))
