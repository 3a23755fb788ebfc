"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to word numbers and all their subsequences go into one automaton, whose size is linear in the
items' words. Training documents stream through it word by word; the automaton's state tells the longest item passage
that ends at each word. Only runs of words that items know at all are streamed, found by numpy, so most text costs one
dictionary lookup a word. There is no shuffle. The automaton is broadcast in blocks of at most ``MAX_BLOCK_WORDS`` item words.
Each row is scanned by all blocks, on the text as it came, and judged and cut once, on their united hits: results don't
depend on the size of the blocks.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import bounded_batches, map_rows, named

WINDOW = 10
#: Item words in one automaton. Built it has at most twice as many states, of some 30 bytes each where they have one way on, as most do;
#: while it is built on the driver a state takes some hundred bytes.
MAX_BLOCK_WORDS = 300_000
#: In the filter: documents with this share of hit words go as a whole; below it the spans are cut out.
MAX_COVERAGE = 0.5
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z; words are runs of digits, letters and anything beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers. ``items_at[s]``: items with a window that state s stands for. Once built, a state that
    has one way on has it in two arrays; only branching ones keep a table."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] | array = field(default_factory=lambda: [-1])
    length: list[int] | array = field(default_factory=lambda: [0])
    anchor: list[int] | array = field(default_factory=list)
    word: array = field(default_factory=lambda: array("i"))
    to: array = field(default_factory=lambda: array("i"))
    branches: dict[int, dict[int, int]] = field(default_factory=dict)
    items_at: dict[int, list[int]] = field(default_factory=dict)
    short: dict[int, list[tuple[int, list[int]]]] = field(default_factory=dict)
    least: int = 0
    names: list = field(default_factory=list)

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        def split(p: int, q: int) -> int:
            copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
            self.link[q] = copy
            while p >= 0 and self.next[p].get(word) == q:
                self.next[p][word] = copy
                p = self.link[p]
            return copy

        if (q := self.next[last].get(word)) is not None:  # another item has this passage
            return q if self.length[q] == self.length[last] + 1 else split(last, q)
        own, p = self._state(self.length[last] + 1, -1, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = own
            p = self.link[p]
        if p < 0:
            self.link[own] = 0
        else:
            q = self.next[p][word]
            self.link[own] = q if self.length[q] == self.length[p] + 1 else split(p, q)
        return own

    @classmethod
    def build(cls, items: list[tuple[object, list[bytes]]], window: int) -> Automaton:
        """``items``: (name, words). Items without words have no window."""
        self = cls(window)
        numbers = []
        for name, words in items:
            if words:
                self.names.append(name)
                numbers.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
        for row in numbers:
            last = 0
            for w in row:
                last = self._extend(last, w)
        # The suffix of just `window` words of what a state stands for belongs to its anchor.
        self.anchor = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            if self.length[s] >= window:
                up = self.link[s]
                self.anchor[s] = s if self.length[up] < window else self.anchor[up]
        self._compact()
        at: dict[int, set[int]] = {}
        short: dict[int, dict[int, set[int]]] = {}
        for k, row in enumerate(numbers):
            s = length = 0
            for w in row:
                s, length = self._step(s, length, w)
                if length >= window:
                    at.setdefault(self.anchor[s], set()).add(k)
            if len(row) < window:
                short.setdefault(s, {}).setdefault(len(row), set()).add(k)
        self.items_at = {s: sorted(x) for s, x in at.items()}
        self.short = {s: sorted((m, sorted(x)) for m, x in own.items()) for s, own in short.items()}
        self.least = min((min(len(r), window) for r in numbers), default=0)
        return self

    def _compact(self) -> None:
        self.word, self.to = array("i", [-1]) * len(self.next), array("i", [-1]) * len(self.next)
        for s, after in enumerate(self.next):
            if len(after) == 1:
                ((self.word[s], self.to[s]),) = after.items()
            elif after:
                self.branches[s] = after
        self.link, self.length, self.anchor = array("i", self.link), array("i", self.length), array("i", self.anchor)
        self.next = []

    def _step(self, s: int, length: int, w: int) -> tuple[int, int]:
        word, branches = self.word, self.branches
        while True:
            if word[s] == w:
                return self.to[s], length + 1
            if s in branches and (to := branches[s].get(w)) is not None:
                return to, length + 1
            if not s:
                return 0, 0
            s = self.link[s]
            length = self.length[s]

    def scan(self, words: list[bytes], least: int) -> tuple[np.ndarray | None, set[int], int]:
        """Hit flags by word (None: no hit), the items with occurring windows, and the longest passage found in runs of
        ``least`` known words or more."""
        if not self.least or len(words) < least:
            return None, set(), 0
        get = self.vocabulary.get
        numbers = np.array([get(w, -1) for w in words], dtype=np.int64)
        known = np.concatenate(([0], (numbers >= 0).view(np.int8), [0]))
        edge = np.flatnonzero(np.diff(known))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= least
        hit, items, longest = None, set(), 0
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            s = length = 0
            for i, w in enumerate(numbers[a:b].tolist(), a):
                s, length = self._step(s, length, w)
                longest = max(longest, length)
                span = 0
                if length >= self.window:
                    span = self.window
                    items.update(self.items_at[self.anchor[s]])
                if self.short:
                    up = s
                    while up > 0:
                        for m, own in self.short.get(up, ()):
                            if m <= length:
                                span = max(span, m)
                                items.update(own)
                        up = self.link[up]
                if span:
                    if hit is None:
                        hit = np.zeros(len(words), bool)
                    hit[i - span + 1 : i + 1] = True
        return hit, items, longest


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata of the items, one at a time on the driver, each of at most ``max_block_words`` words (or one item of more)."""
    block, size = [], 0
    for name, text in items.select(F.col(id_col).cast("string"), text_col).orderBy(id_col).toLocalIterator():
        own = words_of(text)
        if block and size + len(own) > max_block_words:
            yield Automaton.build(block, window)
            block, size = [], 0
        block.append((name, own))
        size += len(own)
    yield Automaton.build(block, window)


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


class _Blocks:
    """The automata of all blocks, each a broadcast of its own."""

    def __init__(self, items: DataFrame, item_col: str, item_text_col: str, window: int, max_block_words: int):
        self.payloads, leasts = [], []
        for a in automata(items, item_col, item_text_col, window, max_block_words):
            self.payloads.append(items.sparkSession.sparkContext.broadcast(a))
            leasts += [a.least] if a.least else []
        self.least = min(leasts, default=0)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, list[str], int]:
        """Hit flags by word (None: no hit), the names of items with occurring windows, and the longest passage, over all blocks."""
        hit, names, longest = None, [], 0
        for payload in self.payloads:
            automaton = payload.value
            flags, own, most = automaton.scan(words, self.least)
            if flags is not None:
                hit = flags if hit is None else hit | flags
            names += [automaton.names[k] for k in sorted(own)]
            longest = max(longest, most)
        return hit, names, longest


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, longest) for each row, repeated and null ids too. Null and empty texts have no words, long
    ones are read whole; null or empty items no window; items of the same words all count. Only the two named columns are read, so no
    other name clashes; without documents there is no row, without items no hit."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = _Blocks(items, item_col, item_text_col, window, max_block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hits, found, longest = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                hit, own, most = blocks.scan(words)
                n.append(len(words))
                hits.append(0 if hit is None else int(hit.sum()))
                found.append(own)
                longest.append(most)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(longest, pa.int64())], names=[id_col, "n_words", "n_hit", "items", "longest"])

    return docs.select(named(id_col), named(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_hit long, items array<string>, longest long")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """``docs`` with the spans of hit words cut out of the text, a space in each one's place; documents whose share of
    hit words reaches ``max_coverage`` go. Other columns stay as they are, whatever their names; null and empty texts and texts without hits
    are untouched; rows are judged each, whatever their ids."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    blocks = _Blocks(items, item_col, item_text_col, window, max_block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = batch.column(at).to_pylist(), []
            for i, text in enumerate(texts):
                words = words_of(text)
                hit, _, _ = blocks.scan(words)
                stay.append(hit is None or hit.sum() < max_coverage * len(words))
                if hit is not None and stay[-1]:
                    texts[i] = cut(text, hit)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.filter(pa.array(stay, pa.bool_()))

    return map_rows(docs, run)


def cut(text: str, hit: np.ndarray) -> str:
    """``text`` without its hit words; what stands between two hit words of a run goes with them."""
    kept, end, inside = [], 0, False
    for flag, m in zip(hit.tolist(), _WORD.finditer(re.sub("[A-Z]", lambda x: x[0].lower(), text)), strict=True):
        if flag and not inside:
            kept.append(text[end : m.start()])
        if flag:
            end = m.end()
        inside = flag
    kept.append(text[end:])
    return " ".join(x.strip(" ") for x in kept).strip(" ")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    from loomspan.llm.common import table

    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
with doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_window as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item where len(w) > 0)),
sizes as (select distinct n from item_window),
doc_window as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, sizes where len(w) >= n)),
found as (select doc_id, d.n, i, item_id from doc_window d join item_window t on d.n = t.n and d.s = t.s),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names
        from (select distinct doc_id, item_id from found) group by doc_id)
select doc.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (doc_id) left join its using (doc_id)
"""
