"""Quality by a sparse ensemble of rules over text statistics, compiled into column expressions.

Statistics of whole texts are built-in functions.  On a bounded sample of labelled rows small boosted trees are
grown; every path from a root to a node becomes a conjunctive rule.  Logistic weights with a lasso penalty keep
few of the rules.  The kept rules are column expressions, so scoring never leaves the JVM.

Null and empty texts have all statistics 0 and get the score that the rules give to them.  Without labelled
rows, or with labels of one kind, the score is the smoothed share of label 1 (0.5 without rows).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 6000
STATS = "_gw_statistics"
SYMBOLS = "#$%&*!|~^=+<>{}[]@\\/_"
DIGITS = "0123456789"


def _without(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _per(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a struct of statistics.

    The struct leaves through a one-row generator: no later filter can be pushed below it and compute it twice.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    upper = F.length(F.regexp_replace(t, r"\P{Lu}+", ""))
    base = docs.withColumn(
        "_gw_counts",
        F.explode(F.array(F.struct(
            F.length(t).alias("chars"), F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("distinct_words"),
            F.size(lines).alias("lines"), F.size(F.array_distinct(lines)).alias("distinct_lines"),
            upper.alias("upper"), _without(t, SYMBOLS).alias("symbols"), _without(t, DIGITS).alias("digits"),
            _without(t, ".,;:").alias("stops"), _without(t, "\n").alias("breaks"), _without(t, "|").alias("bars"),
        ))),
    )
    c = F.col("_gw_counts")
    found = {
        "log_words": F.log1p(c["words"].cast("double")),
        "word_length": _per(c["chars"], c["words"]),
        "distinct_words": _per(c["distinct_words"], c["words"]),
        "distinct_lines": _per(c["distinct_lines"], c["lines"]),
        "line_words": F.log1p(_per(c["words"], c["lines"])),
        "upper": _per(c["upper"], c["chars"]),
        "symbols": _per(c["symbols"], c["words"]),
        "digits": _per(c["digits"], c["chars"]),
        "stops": _per(c["stops"], c["words"]),
        "bars": _per(c["bars"], c["words"]),
        "repeats": _per(F.log1p(c["words"].cast("double")), c["distinct_words"]),
    }
    packed = F.struct(*[v.alias(k) for k, v in found.items()])
    return base.withColumn(STATS, F.explode(F.array(packed))).drop("_gw_counts")


@dataclass
class RuleModel:
    """``rules``: conjunctions of (statistic, threshold, above?) with a logistic weight each."""

    intercept: float = 0.0
    rules: list[tuple[tuple[tuple[str, float, bool], ...], float]] = field(default_factory=list)

    def score(self, stats: str = STATS) -> Column:
        """Probability of label 1 as a column expression over the statistics struct."""
        total = F.lit(self.intercept)
        for terms, weight in self.rules:
            total = total + F.when(_holds(terms, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _holds(terms, stats: str) -> Column:
    holds = F.lit(True)
    for name, threshold, above in terms:
        value = F.col(stats)[name]
        holds = holds & ((value > threshold) if above else (value <= threshold))
    return holds


class _Trees:
    """Boosted trees of small depth on thresholded statistics."""

    def __init__(self, values: np.ndarray, label: np.ndarray, cuts: int = 40):
        self.terms: list[tuple[int, float]] = []
        columns = []
        for j in range(values.shape[1]):
            points = np.unique(np.quantile(values[:, j], np.linspace(0.005, 0.995, cuts)))
            for p in points:
                above = values[:, j] > p
                if 0 < above.sum() < len(above):
                    self.terms.append((j, float(p)))
                    columns.append(above)
        self.above = np.array(columns, np.float32).T if columns else np.zeros((len(label), 0), np.float32)
        self.label = label

    def rules(self, trees: int = 80, depth: int = 3, rate: float = 0.15, seed: int = 5) -> set[tuple]:
        """Conjunctions ((statistic, threshold, above?), ...) of all nodes of all trees."""
        share = self.label.mean()
        margin = np.full(len(self.label), np.log(share / (1 - share)))
        rng, found = np.random.default_rng(seed), set()
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = (self.label - p).astype(np.float32), (p * (1 - p)).astype(np.float32)
            rows = rng.random(len(p)) < 0.6
            step = np.zeros(len(p))
            nodes = [(np.ones(len(p), bool), ())]
            for level in range(depth + 1):
                below = []
                for inside, path in nodes:
                    used = inside & rows
                    split = self._split(used, gradient, weight) if level < depth else None
                    if split is None:
                        step[inside] = gradient[used].sum() / (weight[used].sum() + 1.0)
                        continue
                    j, threshold = self.terms[split]
                    side = self.above[:, split] > 0
                    for above in (True, False):
                        longer = tuple(sorted({*path, (j, threshold, above)}))
                        found.add(longer)
                        below.append((inside & (side == above), longer))
                nodes = below
            margin += rate * step
        return found

    def _split(self, used: np.ndarray, gradient: np.ndarray, weight: np.ndarray, least: int = 8) -> int | None:
        if used.sum() < 2 * least:
            return None
        part = self.above[used]
        g, h, n = gradient[used] @ part, weight[used] @ part, part.sum(axis=0)
        all_g, all_h = gradient[used].sum(), weight[used].sum()
        gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
        gain[(n < least) | (n > used.sum() - least)] = -1
        best = int(np.argmax(gain))
        return best if gain[best] > 1e-3 else None


def _lasso(held: np.ndarray, label: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty by accelerated proximal steps."""
    n, m = held.shape
    mean = held.mean(axis=0)
    scale = np.sqrt(mean * (1 - mean)) + 1e-6
    x = ((held - mean) / scale).astype(np.float64)
    v = np.random.default_rng(1).standard_normal(m)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 4 * n / (np.linalg.norm(x.T @ (x @ v)) + 1e-12)
    share = label.mean()
    bias, w = np.log(share / (1 - share)), np.zeros(m)
    point, old, momentum = w.copy(), w.copy(), 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ point + bias))) - label
        w = point - rate * (x.T @ error) / n
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        bias -= error.mean() * 2
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        point = w + (momentum - 1) / grown * (w - old)
        old, momentum = w, grown
    weights = w / scale
    return float(bias - weights @ mean), weights


def fit(sample: DataFrame, penalty: float = 0.001) -> RuleModel:
    """A model from ``(doc_id, text, label)`` rows; the caller bounds their number."""
    read = statistics(sample).select("doc_id", "label", f"{STATS}.*").toPandas().sort_values("doc_id", kind="stable")
    names = [c for c in read.columns if c not in ("doc_id", "label")]
    label = read["label"].to_numpy(float)
    share = (label.sum() + 1) / (len(label) + 2)
    model = RuleModel(float(np.log(share / (1 - share))))
    if len(set(label.tolist())) < 2:
        return model
    values = read[names].to_numpy(float)
    grown = sorted(_Trees(values, label).rules())
    held = np.array([np.all([(values[:, j] > t) == above for j, t, above in r], axis=0) for r in grown], np.float32).T
    if not len(grown):
        return model
    kept, distinct = np.unique(held, axis=1, return_index=True)
    frequent = (kept.mean(axis=0) > 0.002) & (kept.mean(axis=0) < 0.998)
    kept, distinct = kept[:, frequent], distinct[frequent]
    bias, weights = _lasso(kept, label, penalty)
    model.intercept = bias
    for k, w in zip(distinct.tolist(), weights.tolist()):
        if abs(w) > 1e-4:
            model.rules.append((tuple((names[j], t, above) for j, t, above in grown[k]), w))
    return model
