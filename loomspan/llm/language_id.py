"""Language identification by a byte convolutional network.

Texts are cut to windows of ``WINDOW`` bytes, all of them, each of the same length. A network of byte embeddings, filters
of several widths, max pooling and a softmax, trained in numpy, scores windows in batches; a document's probabilities are
the mean of its windows', weighted by their bytes. The network is a few thousand numbers, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import SLACK, bounded_batches, fold, named, share
from loomspan.plans.shared import materialize, release

WINDOW = 256
EMBEDDING, WIDTHS, FILTERS = 6, (2, 3, 4), 8
#: Documents of each language that the network learns from, about: those whose hash lies below the share that is wanted; windows of
#: each, spread over the whole text; documents in all, about: more languages learn from fewer documents each, ``LEAST_DOCS`` at least.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC, MAX_DOCS, LEAST_DOCS = 500, 6, 100_000, 20
EPOCHS, BATCH, RATE = 12, 64, 4e-3
UNDETERMINED = "und"
#: ASCII bytes that aren't letters count as a space; padding is zero.
_PLAIN = bytes(c if 97 <= c <= 122 or c >= 128 or c == 0 else 32 for c in range(256))


def windows_of(text: str) -> np.ndarray:
    """(windows, WINDOW) bytes of the whole lower-case text, zeros after its end."""
    raw = text.lower().encode("utf-8", "replace").replace(b"\0", b" ").translate(_PLAIN)
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


@dataclass
class ByteCNN:
    languages: list[str]
    embedding: np.ndarray  # (256, EMBEDDING)
    filters: np.ndarray  # (max width * EMBEDDING, all filters): narrower ones are zero beyond their width
    bias: np.ndarray
    out: np.ndarray  # (all filters, languages)
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled responses of windows ``x``, where they were largest, and the unrolled input."""
        wide = max(WIDTHS)
        e = self.embedding[x]
        n, t = len(x), x.shape[1] - wide + 1
        rows = np.lib.stride_tricks.sliding_window_view(e.reshape(n, -1), wide * EMBEDDING, axis=1)[:, ::EMBEDDING]
        response = (rows.reshape(n * t, -1) @ self.filters).reshape(n, t, -1)
        return response, rows, e

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(self.pooled(x)[0].max(axis=1) + self.bias, 0)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores; texts without a letter, and null, are ``und`` with score 0."""
        use = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return labels, scores
        parts = [windows_of(texts[i]) for i in use]
        owner = np.repeat(np.arange(len(use)), [len(p) for p in parts])
        total = np.zeros((len(use), len(self.languages)))
        if use:
            x = np.concatenate(parts)
            for k in range(0, len(x), 256):
                some = x[k : k + 256]
                weight = np.maximum((some != 0).sum(axis=1), 1)[:, None]
                np.add.at(total, owner[k : k + 256], self.probabilities(some) * weight)
            total /= total.sum(axis=1, keepdims=True)
        for i, row in zip(use, total, strict=True):
            best = int(row.argmax())
            labels[i], scores[i] = self.languages[best], float(min(row[best], 1.0))
        return labels, scores


def fit_cnn(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 11, epochs: int = EPOCHS) -> ByteCNN:
    """Adam on cross-entropy. Back-propagation visits only the places that won the max pooling."""
    rng = np.random.default_rng(seed)
    wide, n_f = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((wide * EMBEDDING, n_f), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * EMBEDDING, k * FILTERS : (k + 1) * FILTERS] = 1
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = ByteCNN(languages, normal(256, EMBEDDING, scale=0.5), normal(wide * EMBEDDING, n_f, scale=0.3) * mask, np.zeros(n_f, np.float32), normal(n_f, len(languages), scale=0.3), np.zeros(len(languages), np.float32))
    if len(languages) < 2 or not len(x):
        return net
    names = ("embedding", "filters", "bias", "out", "out_bias")
    first, second, step = {k: np.zeros_like(getattr(net, k)) for k in names}, {k: np.zeros_like(getattr(net, k)) for k in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            xb, yb = x[order[k : k + BATCH]], y[order[k : k + BATCH]]
            n = len(xb)
            response, rows, _ = net.pooled(xb)
            at = response.argmax(axis=1)  # (n, filters)
            top = np.take_along_axis(response, at[:, None], axis=1)[:, 0] + net.bias
            h = np.maximum(top, 0)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), yb] -= 1
            p /= n
            dh = (p @ net.out.T) * (top > 0)
            won = rows[np.arange(n)[:, None], at]  # (n, filters, wide * EMBEDDING)
            grad = {"out": h.T @ p, "out_bias": p.sum(axis=0), "bias": dh.sum(axis=0), "filters": np.einsum("nf,nfk->kf", dh, won) * mask}
            de = (dh[:, :, None] * net.filters.T[None]).reshape(n, -1, wide, EMBEDDING)
            place = xb[np.arange(n)[:, None, None], at[:, :, None] + np.arange(wide)].ravel()
            grad["embedding"] = np.stack([np.bincount(place, de[..., j].ravel(), minlength=256) for j in range(EMBEDDING)], axis=1)
            step += 1
            for name in names:
                g = grad[name].astype(np.float32)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                change = RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, (getattr(net, name) - change).astype(np.float32))
    return net


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] | None = (4, 2), docs_per_language: int = DOCS_PER_LANGUAGE) -> ByteCNN:
    """Fit on about ``docs_per_language`` documents of each language, and about ``MAX_DOCS`` in all, none of the held-out fold. The choice
    goes by the hash of the id: no sort, no window, so a language that has most rows costs no more than others. Null texts, ids and
    languages are left out, rows that repeat an id are documents each, equal ones one; without rows nothing is learnt."""
    bounded_batches(docs.sparkSession)
    known = docs.select(named(id_col).cast("string").alias("id"), named(lang_col).cast("string").alias("lang"), named(text_col).alias("text")).where("id is not null and lang is not null")
    if held_out:
        known = known.where(~fold("id", *held_out))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    kinds = sorted(counts)
    most = max(LEAST_DOCS, min(docs_per_language, MAX_DOCS // max(1, len(kinds))))
    shares = [(k, 2**63 - 1 if counts[k] <= most else int(-(2**63) + 2**64 * most / counts[k])) for k in kinds]
    limits = docs.sparkSession.createDataFrame(shares, "lang string, upto long")
    rows = known.where("text is not null").join(F.broadcast(limits), "lang").where(F.xxhash64("id") <= F.col("upto")).select("id", "text", "lang", F.xxhash64("id", "text").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                w = windows_of(text)
                at = np.unique(np.linspace(0, len(w) - 1, min(len(w), WINDOWS_PER_DOC)).astype(int))
                out.append(w[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary()), batch.column(3)], names=["id", "lang", "windows", "h"])

    # An id may have any number of rows: equal ones are learnt once, and others beyond the bound are cut by their own hash.
    found = materialize(rows.mapInArrow(run, "id string, lang string, windows binary, h long").dropDuplicates(["h", "lang"]), "windows")
    over = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect() if r["n"] > SLACK * most}
    kept = F.lit(True)
    for lang, n in over.items():
        kept &= (F.col("lang") != lang) | share(F.col("h"), most, n)
    got = sorted(found.where(kept).select("id", "lang", "windows").collect())
    release(found)
    parts = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in got]
    number = {lang: k for k, lang in enumerate(kinds)}
    y = np.repeat([number[r["lang"]] for r in got], [len(p) for p in parts]).astype(np.int64)
    return fit_cnn(np.concatenate(parts) if parts else np.zeros((0, WINDOW), np.uint8), y, kinds)


def identify(docs: DataFrame, model: ByteCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row, null and repeated ids too, from its whole text alone, however long. Null texts and texts without
    a letter are ``und`` with score 0; of languages that tie the first in their order. Only the two named columns are read, so no other
    name clashes; an empty table gives no row."""
    bounded_batches(docs.sparkSession)
    payload = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k in range(0, max(len(texts), 1), 200):
                labels, scores = payload.value.predict(texts[k : k + 200])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 200), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(named(id_col), named(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    from loomspan.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
