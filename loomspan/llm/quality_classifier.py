"""Quality classifier: a sparse ensemble of rules (Friedman & Popescu's RuleFit).

Small boosted trees are grown in numpy on statistics of a bounded sample of labelled documents; every path to a node is
a conjunctive rule; logistic regression with a lasso penalty picks and weighs few of them. The rules are compiled to one
Spark column expression over the statistics, so scoring the corpus is a projection without Python and without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import fold, hash_order, named
from loomspan.llm.quality_rules import with_statistics

#: Most labelled documents that a model is fitted on, in hash order of the id.
MAX_LABELLED = 20_000
TREES, TREE_DEPTH, SHRINKAGE, CUTS, MIN_LEAF = 24, 3, 0.3, 48, 10
PENALTY = 0.002
THRESHOLD = 0.5
#: Statistics that rules test: name and SQL over the columns of ``with_statistics`` and n_marks (exclamation marks).
STATISTICS = {
    "log_words": "ln(1 + cast(n_words as double))",
    "word_length": "word_chars / cast(greatest(n_words, 1) as double)",
    "symbols": "n_symbols / cast(greatest(n_words, 1) as double)",
    "upper": "n_upper / cast(greatest(word_chars, 1) as double)",
    "repeated": "n_repeat_words / cast(greatest(n_words, 1) as double)",
    "dup_lines": "cast(n_dup_lines as double)",
    "marks": "n_marks / cast(greatest(n_words, 1) as double)",
}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is upper bound, bound)."""

    terms: tuple[tuple[str, bool, float], ...]

    def hits(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(columns.values()))), bool)
        for name, upper, bound in self.terms:
            out &= columns[name] <= bound if upper else columns[name] > bound
        return out

    def sql(self) -> str:
        return " and ".join(f"{name} {'<=' if upper else '>'} {bound!r}D" for name, upper, bound in self.terms)


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score as a column over the statistics' names."""
        z = f"{self.bias!r}D" + "".join(f" + if({rule.sql()}, {weight!r}D, 0D)" for rule, weight in self.rules)
        return F.expr(f"1D / (1D + exp(-({z})))")

    def predict(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        z = np.full(len(next(iter(columns.values()))), self.bias)
        for rule, weight in self.rules:
            z += weight * rule.hits(columns)
        return 1 / (1 + np.exp(-z))


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, value: np.ndarray) -> None:
    """Least-squares tree on ``g`` over ``rows``; appends each node's path to ``out`` and writes leaf means to ``value``."""
    best = None
    total, n = g[rows].sum(), len(rows)
    if depth and n >= 2 * MIN_LEAF:
        for f, own in enumerate(cuts):
            if not len(own):
                continue
            at = np.searchsorted(own, x[rows, f], side="left")  # at <= k exactly where x <= own[k]
            count = np.bincount(at, minlength=len(own) + 1).cumsum()[:-1]
            left = np.bincount(at, g[rows], minlength=len(own) + 1).cumsum()[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((count >= MIN_LEAF) & (n - count >= MIN_LEAF), left**2 / count + (total - left) ** 2 / (n - count) - total**2 / n, -1.0)
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), f, float(own[k]))
    if best is None:
        value[rows] = total / max(n, 1)
        return
    _, f, bound = best
    low = x[rows, f] <= bound
    for upper, part in ((True, rows[low]), (False, rows[~low])):
        own = (*path, (f, upper, bound))
        out.append(own)
        _grow(x, cuts, g, part, depth - 1, own, out, value)


def _simplified(path: tuple, names: list[str]) -> Rule:
    """Only the tightest bound of each statistic and side, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for f, upper, bound in path:
        old = tight.get((f, upper))
        tight[f, upper] = bound if old is None else min(old, bound) if upper else max(old, bound)
    return Rule(tuple((names[f], upper, bound) for (f, upper), bound in sorted(tight.items())))


def fit_rules(columns: dict[str, np.ndarray], y: np.ndarray, seed: int = 7) -> RuleModel:
    """Without rows of both classes, the score is the smoothed share of ones."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return RuleModel(bias, [])
    names = list(columns)
    x = np.column_stack([columns[k] for k in names]).astype(np.float64)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, CUTS))) for f in range(x.shape[1])]
    rng = np.random.default_rng(seed)
    z, paths = np.full(n, bias), []
    for _ in range(TREES):
        g = y - 1 / (1 + np.exp(-z))
        rows = np.sort(rng.choice(n, max(min(n, 2 * MIN_LEAF), n // 2), replace=False))
        off = set(rng.choice(len(names), len(names) // 4, replace=False).tolist())
        grown, value = [], np.zeros(n)
        own = [c if f not in off else c[:0] for f, c in enumerate(cuts)]
        _grow(x, own, g, rows, TREE_DEPTH, (), grown, value)
        paths += grown
        # Steps follow the sampled rows; the others get their leaves' values by the rules.
        leaf = {}
        for p in grown:
            hit = _simplified(p, names).hits(columns)
            if (own_rows := hit[rows]).any():
                leaf[p] = (hit, g[rows][own_rows].mean())
        step = np.zeros(n)
        for p in sorted(leaf, key=len):
            step[leaf[p][0]] = leaf[p][1]
        z = z + SHRINKAGE * 4 * step
    rules = sorted({_simplified(p, names) for p in paths}, key=lambda r: r.terms)
    m = np.column_stack([r.hits(columns) for r in rules]).astype(np.float64) if rules else np.zeros((n, 0))
    keep = np.flatnonzero((m.sum(axis=0) >= MIN_LEAF) & (m.sum(axis=0) <= n - MIN_LEAF))
    m, rules = m[:, keep], [rules[k] for k in keep]
    # Lasso logistic regression by accelerated proximal steps; the step is one over the Lipschitz bound.
    w, b = np.zeros(len(rules)), bias
    full = np.column_stack([np.ones(n), m])
    v = np.ones(full.shape[1])
    for _ in range(30):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / max(float(v @ (full.T @ (full @ v))), 1e-9)
    wp, bp, wq, bq, t = w, b, w, b, 1.0
    for _ in range(600):
        r = 1 / (1 + np.exp(-(m @ wq + bq))) - y
        w_new = wq - rate * (m.T @ r) / n
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - rate * PENALTY, 0)
        b_new = bq - rate * r.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wq, bq, t = w_new + (t - 1) / t_new * (w_new - wp), b_new + (t - 1) / t_new * (b_new - bp), t_new
        wp, bp = w_new, b_new
    return RuleModel(float(bp), [(rules[k], float(wp[k])) for k in np.flatnonzero(np.abs(wp) > 1e-6)])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one column a statistic); null and empty texts have zeros."""
    text = F.coalesce(named(text_col), F.lit(""))
    rows = docs.select(named(id_col).alias("id"), text.alias("text")).withColumn("n_marks", F.length("text") - F.length(F.translate("text", "!", "")))
    return with_statistics(rows, "text").select("id", *[F.expr(x).alias(k) for k, x in STATISTICS.items()])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: tuple[int, int] | None = (3, 1), max_labelled: int = MAX_LABELLED) -> RuleModel:
    """Fit on at most ``max_labelled`` rows of at most as many labelled ids; labels of the held-out fold are never read. Null labels, ids without a
    document and repeated labels of one id (the largest counts) do no harm; rows that repeat an id are documents each. Without
    documents or without both labels there are no rules, and the score is the smoothed share."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    if held_out:
        known = known.where(~fold("id", *held_out))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(*hash_order("id")).limit(max_labelled)
    # broadcast: at most max_labelled rows of two numbers
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).join(F.broadcast(known), "id")
    stats = statistics(rows, "id", "text").join(F.broadcast(known), "id")
    # an id may have any number of rows, so rows are bounded too, those of the smallest hashes staying
    stats = stats.orderBy(*hash_order("id"), F.xxhash64(*STATISTICS), *STATISTICS).limit(max_labelled)
    got = stats.toPandas().sort_values(["id", *STATISTICS], ignore_index=True)
    return fit_rules({k: got[k].to_numpy(np.float64) for k in STATISTICS}, got["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, null and repeated ids too; null and empty texts have statistics of zero, long ones are read whole. Only the
    text is read besides the id, so no other name clashes; an empty table gives no row."""
    return statistics(docs, id_col, text_col).select(F.col("id").alias(id_col), model.column().alias("score"))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    from loomspan.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
