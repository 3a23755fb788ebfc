"""SentencePiece encoding and decoding by a table of distinct chunks.

In a vocabulary none of whose pieces has a white-space marker behind another character, no piece crosses the place before a run of
markers. Texts are cut there: a chunk is a run of markers with the word behind it. Each batch lists its distinct chunks, the library
segments those that the worker's table doesn't hold yet, each once, and their ids are joined back by the chunks' positions.
The table keeps what was used last within a bound of bytes; chunks beyond ``LONGEST`` are segmented where they stand.

A table of the whole corpus would need every occurrence of a chunk to be exchanged twice, which is several times the corpus; a
worker's table costs no exchange, and a task that is lost is simply run again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import bounded_batches, named, table

MARK = "▁"
#: Bytes of chunks and their ids in each of two generations of a worker's table, what Python adds to an entry, and the longest chunk in it.
TABLE_BYTES, OVERHEAD, LONGEST = 32_000_000, 200, 200
#: Chunks that the library segments in one call.
CALL = 20_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model with its table."""

    _loaded: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cut = self._cuttable(path)
        self.lead = self.inner.encode("x")  # a chunk is encoded behind a word of its own, as it stands within a text
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _cuttable(self, path: str) -> bool:
        """True if the model leaves texts as they are but for the markers, one of which it puts first, and no piece crosses a chunk's border."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        # BPE (2) merges neighbours alone, so what no piece crosses is segmented apart; a whole text's best path need not be.
        return plain and model.trainer_spec.model_type == 2 and not any(MARK in p.piece.lstrip(MARK) for p in model.pieces)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text cut before each run of markers, without the first marker of each; of the empty text nothing."""
        return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))] if text else []

    def _cut(self, texts: pa.Array) -> tuple[pa.ListArray, pa.Array]:
        """Chunks of every text, and of each text its place among them. Where words stand one space apart, that is a split at spaces."""
        odd = pc.or_(pc.or_(pc.match_substring(texts, MARK), pc.match_substring(texts, "  ")), pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")))
        first, rest = pc.split_pattern(texts.filter(pc.invert(odd)), " "), texts.filter(odd)
        other = pa.array([self.chunks(t.as_py()) for t in rest], pa.list_(pa.string()))
        places = np.empty(len(texts), np.int64)
        odd = odd.to_numpy(zero_copy_only=False)
        places[~odd], places[odd] = np.arange(len(first)), len(first) + np.arange(len(other))
        return pa.concat_arrays([first, other]), pa.array(places)

    def segment(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, as 32-bit numbers."""
        skip, out = len(self.lead), []
        for k in range(0, len(chunks), CALL):
            found = self.inner.encode(["x" + MARK + c for c in chunks[k : k + CALL]], num_threads=1)
            ends = 4 * np.cumsum([len(x) for x in found])
            every = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]) // 4).tobytes()
            out += [every[a:b] for a, b in zip([4 * skip, *(ends[:-1] + 4 * skip).tolist()], ends.tolist(), strict=True)]
        return out

    def look_up(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks: from the table, or segmented and put there."""
        found = list(map(self.known.get, chunks))
        if None in found:
            missing = [c for c, ids in zip(chunks, found, strict=True) if ids is None]
            fresh = {c: ids for c in missing if (ids := self.older.get(c)) is not None}
            unknown = [c for c in missing if c not in fresh]
            fresh.update(zip(unknown, self.segment(unknown), strict=True))
            found = [fresh[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
            if max(map(len, missing)) > LONGEST:
                fresh = {c: ids for c, ids in fresh.items() if len(c) <= LONGEST}
            if self.size >= TABLE_BYTES:  # what isn't asked for until the next one fills up is forgotten
                self.known, self.older, self.size = {}, self.known, 0
            self.known.update(fresh)
            self.size += OVERHEAD * len(fresh) + sum(map(len, fresh)) + sum(map(len, fresh.values()))
        return found

    def ids(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; none for a null one."""
        texts = pc.fill_null(texts, "")
        if not self.cut:
            return pa.array(self.inner.encode(texts.to_pylist(), num_threads=1), pa.list_(pa.int32()))
        cut, places = self._cut(texts)
        coded = cut.flatten().dictionary_encode()
        table = _lists(self.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        joined = table.take(coded.indices)  # by position
        ends = joined.offsets.to_numpy()[cut.offsets.to_numpy() - cut.offsets[0].as_py()] if len(joined) else np.zeros(len(cut) + 1, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), joined.flatten()).take(places)

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """What the library makes of each list of ids; of none and null the empty text."""
        ends = np.cumsum([0, *ids.value_lengths().fill_null(0).to_numpy()]).tolist()
        every = ids.flatten().to_numpy(zero_copy_only=False).tolist()
        return pa.array([self.inner.decode(every[a:b]) if a < b else "" for a, b in zip(ends, ends[1:], strict=False)], pa.string())


def _lists(numbers: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, numbers)]) // 4
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(numbers))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """(id, ids array<int>[, decoded]) of every row: the whole text's ids, without begin and end, and what they decode to. Null and empty texts have none; repeated rows are
    encoded each; ids of any type, null ones too, come back as they are; only the two named columns are read, so others can't clash;
    an empty table gives no row."""
    bounded_batches(docs.sparkSession)
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            ids = model.ids(batch.column(1))
            decoded = {decoded_col: model.texts(ids)} if decoded_col else {}
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, *decoded.values()], names=[id_col, ids_col, *decoded])

    kind = docs.schema[id_col].dataType.simpleString()
    more = f", `{decoded_col}` string" if decoded_col else ""
    return docs.select(named(id_col), named(text_col)).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>{more}")


def decode(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text that the library makes of its ids; no ids, and null, are the empty text. An id outside the vocabulary is an
    error, as it is there."""
    bounded_batches(encoded.sparkSession)
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, model.texts(batch.column(1))], names=[id_col, ids_col, text_col])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(named(id_col), named(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>, `{text_col}` string")


def op13_pieces(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    both = encode(table(spark, sf_dir, "documents"), decoded_col="decoded")
    decimals = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
