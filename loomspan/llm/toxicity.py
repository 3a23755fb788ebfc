"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a plain sample of the corpus, whatever its labels, is the unlabelled set. A
sparse linear model over hashed words and word beginnings is trained in numpy with the non-negative risk estimator of Kiryo
et al. (2017): with class prior p,

    risk = p * mean_P loss(+1) + max(0, mean_U loss(-1) - p * mean_P loss(-1)),

whose negative part is corrected by ascending when it falls below zero. The prior is estimated from the same two samples
(best bin, Garg et al., 2021): a first model, fitted on one half, ranks the other half, and the least ratio of the unlabelled
to the positive share above any threshold bounds the share of positives.

Features are counted on the executors; only those that may get a weight come to the driver, so what it holds doesn't grow
with the length of texts. The model is a bounded set of weights (``MAX_FEATURES``), so shipping it doesn't grow either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import SLACK, bounded_batches, fold, map_rows, named, share
from loomspan.plans.shared import materialize, release

#: Bits of the feature hash.
BITS = 20
#: Positive and unlabelled documents that a model is fitted on, about: those whose hash lies below the bound's share of the hash range.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 8000
#: Most features that keep a weight.
MAX_FEATURES = 20000
#: Positive documents that a feature must occur in before it may get a weight.
MIN_POSITIVE_DF = 3
#: Least likelihood ratio of a feature, and least lift as a share of 1 / prior; chosen by cross-validation outside the held-out fold.
MIN_RATIO, MIN_LIFT = 12.0, 0.5
#: Beginnings of words, in characters, that count as features besides the word.
PREFIXES = (4, 5, 6)
#: Score from which a document is called toxic.
THRESHOLD = 0.7

_STRIP = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_MASK = (1 << BITS) - 1


def word_features(raw: str) -> tuple[int, ...]:
    """Hashed features of one white-space separated chunk: the lower-case word without outer punctuation, and its beginnings."""
    word = raw.strip(_STRIP).lower()
    if not word:
        return ()
    out = [zlib.crc32(b"w" + word.encode("utf-8", "replace")) & _MASK]
    out += [zlib.crc32(b"p" + word[:n].encode("utf-8", "replace")) & _MASK for n in PREFIXES if len(word) > n]
    return tuple(out)


def _distinct(text: str | None) -> np.ndarray:
    found: set[int] = set()
    for chunk in set((text or "").split()):
        found.update(word_features(chunk))
    return np.fromiter(found, dtype=np.int32, count=len(found))


@dataclass
class PUModel:
    """Weights by feature hash; ``score`` is the logistic of bias plus the weights of the distinct features present."""

    bias: float
    weights: dict[int, float]
    prior: float
    history: list[float] = field(default_factory=list)

    def scorer(self):
        weights, bias, known = self.weights, self.bias, {}

        def score(text: str | None) -> float:
            hit: set[int] = set()
            for chunk in set((text or "").split()):
                own = known.get(chunk)
                if own is None:
                    if len(known) > 400_000:
                        known.clear()
                    own = known[chunk] = tuple(f for f in word_features(chunk) if f in weights)
                if own:
                    hit.update(own)
            z = bias + sum(weights[f] for f in sorted(hit))
            return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))

        return score


def usable(n_p: int, n_u: int, prior: float, p: Column, u: Column) -> tuple[Column, Column]:
    """(condition, strength) of a feature that ``p`` of the positives and ``u`` of the unlabelled documents have. Its share among the
    positives must be beyond chance: a likelihood ratio that the corpus' many rare words don't reach by luck, and a lift near
    1 / prior, the most that a feature of toxic documents alone can have."""
    expect = (p + u) * (n_p / (n_p + n_u))
    part = lambda seen, wanted: F.when(seen > 0, seen * F.log(seen / wanted)).otherwise(0.0)
    ratio = 2 * (part(p, expect) + part(u, p + u - expect))
    lift = (p / n_p) / (F.greatest(u, F.lit(1)) / n_u)
    return (p >= min(MIN_POSITIVE_DF, n_p)) & (ratio >= MIN_RATIO) & (lift >= 1 + MIN_LIFT * (1 / prior - 1)), ratio


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The estimate for scores of positives and of unlabelled documents, and its part that must not be negative; logistic loss."""
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return float(prior * np.logaddexp(0, -zp).mean() + max(0.0, negative)), float(negative)


def _clip_prior(prior: float) -> float:
    return min(max(prior, 1e-3), 0.9)


def _scores(docs: list[np.ndarray], w: np.ndarray, b: float) -> np.ndarray:
    return b + np.array([w[x].sum() for x in docs], np.float64)


def fit_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, features: int, epochs: int = 300, rate: float = 0.05, l1: float = 2e-3, l2: float = 1e-5) -> tuple[np.ndarray, float, list[float]]:
    """(weights, bias, risk by epoch) by Adam with a proximal step for l1. Documents are arrays of feature numbers below ``features``."""
    prior = _clip_prior(prior)
    bias0 = float(np.log(prior / (1 - prior)))
    w, b, history = np.zeros(features), bias0, []
    if not positive or not unlabelled:
        return w, b, history
    flat = lambda docs: (np.repeat(np.arange(len(docs)), [len(x) for x in docs]), np.concatenate(docs).astype(np.int64))
    (rp, cp), (ru, cu) = flat(positive), flat(unlabelled)
    n_p, n_u = len(positive), len(unlabelled)
    m, v, mb, vb = np.zeros(features), np.zeros(features), 0.0, 0.0
    for t in range(1, epochs + 1):
        zp = b + np.bincount(rp, w[cp], minlength=n_p)
        zu = b + np.bincount(ru, w[cu], minlength=n_u)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        now, negative = risk(zp, zu, prior)
        history.append(now)
        if negative >= 0:
            gp, gu = (-prior * (1 - sp) - prior * sp) / n_p, su / n_u
        else:  # the correction: only the negative part, upwards
            gp, gu = prior * sp / n_p, -su / n_u
        g = np.bincount(cp, gp[rp], minlength=features) + np.bincount(cu, gu[ru], minlength=features) + l2 * w
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate / (np.sqrt(v / c2) + 1e-8) * (m / c1)
        w = np.maximum(w - rate * l1, 0)  # a feature is evidence for toxicity or none: long clean texts gather no credit
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, float(b), history


def estimate_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], features: int, start: float, rounds: int = 3) -> float:
    """Share of positives among the unlabelled, from ``start``: each round fits one half with the share so far and ranks the other half.
    Where a half has under ten documents of a kind, the start stands."""
    half = lambda docs: (docs[::2], docs[1::2])
    (fit_p, rank_p), (fit_u, rank_u) = half(positive), half(unlabelled)
    prior = _clip_prior(start)
    if min(len(rank_p), len(rank_u)) < 10:
        return prior
    for _ in range(rounds):
        w, b, _ = fit_pu(fit_p, fit_u, prior, features)
        zp, zu = np.sort(_scores(rank_p, w, b)), np.sort(_scores(rank_u, w, b))
        at = np.unique(zp)
        share_p = 1 - np.searchsorted(zp, at, side="left") / len(zp)
        share_u = 1 - np.searchsorted(zu, at, side="left") / len(zu)
        # each share with the margin of its sample, so that a threshold few positives pass doesn't win by luck
        slack = np.sqrt(np.log(20) / 2 / len(zp)) + np.sqrt(np.log(20) / 2 / len(zu))
        best = int(np.argmin((share_u + slack) / share_p))
        prior = _clip_prior(float(share_u[best] / share_p[best]))
    return prior


def _hashed(frame: DataFrame, keep: dict[int, int] | None) -> DataFrame:
    """Without ``keep``: (feature, p, u), how many documents of either kind have a feature, by task. With it: (kind, hash, features), the
    numbers of the kept features of each document."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for p, u, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                own = _distinct(text)
                if p:
                    df[0, own] += 1
                if u:
                    df[1, own] += 1
        some = np.flatnonzero(df.any(axis=0))
        for k in range(0, len(some), 50_000):
            part = some[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(df[0, part].astype(np.int64)), pa.array(df[1, part].astype(np.int64))], names=["feature", "p", "u"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.full(1 << BITS, -1, np.int32)
        index[list(keep)] = list(keep.values())
        for batch in batches:
            found = [index[_distinct(t)] for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([np.sort(x[x >= 0]).tobytes() for x in found], pa.binary())], names=["p", "u", "turn", "features"])

    if keep is None:
        return frame.mapInArrow(counted, "feature int, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    return frame.mapInArrow(kept, "p boolean, u boolean, turn long, features binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] | None = (3, 1), prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> PUModel:
    """Fit on about ``max_positive`` confirmed documents and a plain sample of about ``max_unlabelled`` of the corpus, by hashes of id and
    text, so the choice depends neither on partitioning nor on labels. ``held_out`` = (modulus, remainder) of the crc32 of the id: labels
    of that fold are never read, and its texts aren't used either. ``prior``: share of toxic documents in the corpus; by default it is
    estimated. Null labels and null ids are left out; rows that repeat an id are documents each, equal ones one; an empty table, or labels without a
    positive, give a model without weights whose score is the smoothed share."""
    spark = docs.sparkSession
    bounded_batches(spark)
    allowed = lambda df: df.where(F.col("id").isNotNull() & ~fold("id", *held_out)) if held_out else df.where("id is not null")
    known = allowed(labels.select(named(id_col).alias("id"), named(label_col).cast("int").alias("y"))).where("y is not null")
    corpus = allowed(docs.select(named(id_col).alias("id"), named(text_col).alias("text"))).withColumn("turn", F.xxhash64(F.col("id").cast("string")))
    total, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    rows = corpus.agg(F.count(F.lit(1))).first()[0]
    start = _clip_prior((toxic + 1) / (total + 2)) if prior is None else _clip_prior(prior)
    below = lambda most, of: F.lit(True) if of <= most else F.col("turn") < F.lit(int(-(2**63) + 2**64 * most / of))
    positives = known.where("y = 1").select("id").distinct().withColumn("turn", F.xxhash64(F.col("id").cast("string"))).where(below(max_positive, toxic)).select("id", F.lit(True).alias("p"))
    # broadcast: about max_positive ids at most
    sample = corpus.join(F.broadcast(positives), "id", "left").withColumn("h", F.xxhash64("id", "text"))
    sample = sample.withColumns({"p": F.coalesce("p", F.lit(False)), "u": share(F.col("h"), max_unlabelled, rows)}).where("p or u").select("p", "u", "turn", "text", "h")
    # An id may have any number of rows: equal ones are learnt once, and others beyond the bound are cut by their own hash.
    sample = materialize(sample.dropDuplicates(["h"]), "sample")
    held = lambda: sample.agg(F.coalesce(F.sum(F.col("p").cast("int")), F.lit(0)), F.coalesce(F.sum(F.col("u").cast("int")), F.lit(0))).first()
    n_p, n_u = held()
    if n_p > SLACK * max_positive or n_u > SLACK * max_unlabelled:
        cut = lambda c, most, n: F.col(c) & share(F.col("h"), most, n if n > SLACK * most else most)
        whole, sample = sample, sample.withColumns({"p": cut("p", max_positive, n_p), "u": cut("u", max_unlabelled, n_u)}).where("p or u")
        sample = materialize(sample, "sample")
        release(whole)
        n_p, n_u = held()
    sample = sample.drop("h")
    if not n_p or not n_u:
        return PUModel(float(np.log(start / (1 - start))), {}, start)
    counts = materialize(_hashed(sample, None), "counts")

    def pick(p: float) -> dict[int, int]:
        good, strength = usable(n_p, n_u, p, F.col("p"), F.col("u"))
        best = counts.where(good).orderBy(strength.desc(), "feature").limit(MAX_FEATURES).select("feature").collect()
        return {f: k for k, f in enumerate(sorted(r["feature"] for r in best))}

    def split(keep: dict[int, int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        got = sorted(_hashed(sample, keep).collect(), key=lambda r: (r["turn"], bytes(r["features"])))
        return tuple([np.frombuffer(r["features"], np.int32) for r in got if r[k]] for k in ("p", "u"))

    keep = pick(start)
    positive, unlabelled = split(keep)
    if prior is None:
        start = estimate_prior(positive, unlabelled, len(keep), start)
        keep = pick(start)
        positive, unlabelled = split(keep)
    w, b, history = fit_pu(positive, unlabelled, start, len(keep))
    release(sample, counts)
    return PUModel(b, {f: float(w[k]) for f, k in keep.items() if w[k]}, start, history)


def score(docs: DataFrame, model: PUModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, null ids too. Null and empty texts have no feature, so their score is the logistic of the bias; long
    texts are read whole; repeated rows are scored each; columns other than the two named aren't read, so none clashes; an empty table
    gives no row."""
    bounded_batches(docs.sparkSession)
    payload = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = payload.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t) for t in batch.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(named(id_col), named(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")


def reject(docs: DataFrame, model: PUModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score stays below ``threshold``."""
    bounded_batches(docs.sparkSession)
    payload = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = payload.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_rows(docs, run)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    from loomspan.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
