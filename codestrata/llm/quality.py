"""Quality classifier.

Method: sparse rule ensemble.  Statistics of a text are computed once; shallow trees are boosted on
them; every path of a tree is a conjunctive rule; a lasso logistic regression keeps few rules; the
kept rules are compiled into one Spark column expression over the statistics.

The model is fitted on about ``SAMPLE`` labelled documents of each class at most (by a hash of the
id, counted beforehand); only their statistics reach the driver.

Defined results: null text is empty, an empty text has statistics of zero and is scored like any
other; without labels of both classes every score is the share of label 1 (0.5 without labels);
repeated rows get the same score, ties of thresholds go to the side below, very long texts are read
whole, an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import bounded_sample, not_held_out, release_tokens, small_batches

#: Labelled training documents of each class (expected number; the choice is by hash).
SAMPLE = 2000
TREES, DEPTH, RATE, BINS, LASSO = 24, 3, 0.3, 24, 0.004

STATISTICS = (
    "words", "word_length", "distinct", "repeated", "top_word", "upper", "digit", "symbol", "mark", "pipe", "punctuation",
    "plain_words", "odd_ends", "non_ascii", "line_words", "repeated_lines", "long_words", "short_words",
)
_KIND = np.zeros(256, dtype=np.int64)
for _chars, _k in ((range(65, 91), 1), (range(48, 58), 2), (b"$#%&*@~^=+<>{}[]\\/_`", 3), (b"!?", 4), (b"|", 5), (b".,;:'\"()-", 6), (range(128, 256), 7)):
    _KIND[list(_chars)] = _k


def statistics(text: str) -> tuple[float, ...]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    words = text.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, raw = len(words), np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=8) / len(raw)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    repeated = sum(map(str.__eq__, words, words[1:]))
    ends = Counter(w[-1] for w in words)
    plain = sum(c for w, c in ends.items() if w.isalpha())
    usual = plain + sum(ends.get(c, 0) for c in ".,;:!?)\"'")
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        math.log1p(n), float(lengths.mean()), len(counts) / n, repeated / n, max(counts.values()) / n,
        float(kinds[1]), float(kinds[2]), float(kinds[3]), float(kinds[4]), float(kinds[5]), float(kinds[6]),
        plain / n, 1.0 - usual / n, float(kinds[7]), math.log1p(n / len(lines)), 1.0 - len(set(lines)) / len(lines),
        float((lengths > 15).mean()), float((lengths < 3).mean()),
    )


def with_statistics(df: DataFrame, text: str = "text", into: str = "__stats") -> DataFrame:
    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release_tokens()
        for batch in batches:
            yield pd.DataFrame([statistics(t) for t in batch.fillna("")], columns=list(STATISTICS), dtype="float64")

    return small_batches(df).withColumn(into, measure(F.col(text)))


@dataclass
class Rule:
    """A conjunction of (statistic, at most?, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, below, cut in self.terms:
            out &= x[:, f] <= cut if below else x[:, f] > cut
        return out

    def column(self, stats: str) -> Column:
        c = F.lit(True)
        for f, below, cut in self.terms:
            s = F.col(f"{stats}.{STATISTICS[f]}")
            c = c & ((s <= F.lit(cut)) if below else (s > F.lit(cut)))
        return c


@dataclass
class Model:
    shift: float
    rules: list[tuple[float, Rule]] = field(default_factory=list)

    def score(self, stats: str = "__stats") -> Column:
        """The compiled rules: a column between 0 and 1 over a struct of statistics."""
        total = F.lit(self.shift)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, depth: int, rules: list, out: np.ndarray) -> None:
    """One regression tree on logistic gradients; adds each path to ``rules`` and each leaf's step to ``out``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    if path:
        rules.append(Rule(path))
    best = (1e-6, -1, -1)
    if depth and len(rows) >= 20:
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, grad[rows], len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], len(cut) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < 8) | (len(rows) - nl < 8)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), f, i)
    if best[1] < 0:
        out[rows] += RATE * g / (h + 1)
        return
    _, f, i = best
    left = binned[rows, f] <= i
    for below, part in ((True, rows[left]), (False, rows[~left])):
        _grow(x, binned, cuts, grad, hess, part, (*path, (f, below, float(cuts[f][i]))), depth - 1, rules, out)


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees, their paths as rules, and lasso weights for the rules."""
    mean = float(y.mean()) if len(y) else 0.5
    prior = Model(math.log((mean + 1e-3) / (1 - mean + 1e-3)))
    if not len(y) or not 0 < mean < 1:
        return prior
    # thresholds lie midway between neighbouring values at quantiles
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        mids = (v[1:] + v[:-1]) / 2
        cuts.append(np.unique(np.concatenate([np.quantile(mids, np.linspace(0, 1, BINS)), np.quantile(x[:, f], np.linspace(0.02, 0.98, BINS))])) if len(mids) else mids)
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin, rules = np.full(len(y), math.log(mean / (1 - mean))), []
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(np.arange(len(y)) * 2654435761 % 97 % 3 != t % 3)
        _grow(x, binned, cuts, y - p, p * (1 - p), rows, (), DEPTH, rules, margin)
    if not rules:
        return prior
    unique = list({r.terms: r for r in rules}.values())
    design = np.stack([r.holds(x) for r in unique], axis=1).astype(float)
    _, first = np.unique(design, axis=1, return_index=True)
    unique, design = [unique[i] for i in sorted(first)], design[:, sorted(first)]
    weights, shift = _lasso(design, y, LASSO)
    return Model(shift, [(float(w), r) for w, r in zip(weights, unique, strict=True) if abs(w) > 1e-6])


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradients; the shift is free of penalty."""
    n, k = a.shape
    full = np.concatenate([a, np.ones((n, 1))], axis=1)
    step = 4.0 * n / max(np.linalg.norm(full, 2) ** 2, 1e-9)
    w, z, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ z, -30, 30)))
        u = z + step * (full.T @ (y - p)) / n
        u[:k] = np.sign(u[:k]) * np.maximum(np.abs(u[:k]) - step * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = u + (t - 1) / t2 * (u - w), u, t2
    return w[:k], float(w[k])


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Model:
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null").where(not_held_out(F.col("id"), folds, held))
    share = known.agg(F.avg("y")).first()[0]
    known = bounded_sample(known, "id", sample, "y")
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = with_statistics(docs.join(F.broadcast(known), "id")).select("id", "y", "__stats.*").collect()  # ids and labels of the sample are sent
    rows.sort(key=lambda r: r[0])
    y = np.array([r[1] for r in rows], dtype=float)
    model = train(np.array([r[2:] for r in rows], dtype=float).reshape(-1, len(STATISTICS)), y)
    if share and 0 < share < 1 and len(y) and 0 < y.mean() < 1:  # the sample holds the classes alike, the labels don't
        model.shift += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return model


def score(df: DataFrame, model: Model, text: str = "text", into: str = "__quality") -> DataFrame:
    """Adds ``into``: the score of each whole text."""
    return with_statistics(df, text).withColumn(into, model.score()).drop("__stats")
