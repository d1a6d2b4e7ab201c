"""Toxic passages.

Method: maximum-scoring segment search.  Words get log-odds of occurring in toxic against other
documents under an informative Dirichlet prior (the corpus frequencies); a word not seen often
enough takes the log-odds of its longest known prefix.  A linear scan finds all maximal scoring
segments of a text, extreme-value (Karlin-Altschul) statistics fitted on the other documents turn
a segment's score and the text's length into a p-value, significant segments are the toxic
passages, and the evidence of the passages gives the score through a fitted logistic curve.

The model is fitted on about ``SAMPLE`` labelled documents of each class at most (by a hash of the
id, counted beforehand).  The curve is fitted on scores from the other half's log-odds.

Defined results: null and empty texts have no passage and the score of no evidence; without labels
of both classes every score is 0; documents labelled twice count twice; null labels are left out;
repeated rows get the same score, very long texts are scanned whole, an empty table gives no rows;
columns of the table named like a result stay beside it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import bounded_sample, not_held_out, release_tokens, small_batches, letter_runs

#: Labelled training documents of each class (expected number; the choice is by hash).
SAMPLE = 2000
PREFIXES = (5, 4)
PRIOR, LEAST, DRIFT, CEILING, CLEAR, MANY, SIGNIFICANT = 20.0, 4, 0.8, 5.0, 3.5, 40, 0.01
CACHE = 150_000


def words_of(text: str | None) -> list[str]:
    return letter_runs(text)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in order, in linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        left, after = i, total
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= after:
                break
            left, before = found[j][0], found[j][2]
            del found[j:]
        found.append((left, i + 1, before, after))
    return [(a, b, y - x) for a, b, x, y in found]


def _clearness(y1: int, y0: int, n1: int, n0: int) -> float:
    """Square root of the likelihood ratio of two occurrence counts against equal rates."""
    rate = (y1 + y0) / (n1 + n0)
    part = lambda y, n: y * math.log(y / (n * rate)) if y else 0.0
    return math.sqrt(max(0.0, 2 * (part(y1, n1) + part(y0, n0))))


class Odds:
    """Log-odds of words and prefixes with a Dirichlet prior."""

    def __init__(self, texts: list[list[str]], toxic: list[int]):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(texts, toxic, strict=True):
            words = set(text)
            counts[label].update({w for w in words} | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) >= n})
        n1, n0 = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
        self.known: dict[str, float] = {}
        for g in counts[0].keys() | counts[1].keys():
            y1, y0 = counts[1][g], counts[0][g]
            if y1 + y0 < LEAST:
                continue
            a = PRIOR * (y1 + y0) / (n1 + n0)
            odds1, odds0 = (y1 + a) / (n1 + PRIOR - y1 - a + 1e-9), (y0 + a) / (n0 + PRIOR - y0 - a + 1e-9)
            delta = math.log(odds1 / odds0)
            z = _clearness(y1, y0, n1, n0)
            if abs(z) > CLEAR:
                self.known[g] = delta
            elif y1 + y0 >= MANY:  # seen often and in both alike; a word seen less says nothing and its prefix is asked
                self.known[g] = 0.0
        self.cache: dict[str, float] = {}

    def word(self, w: str) -> float:
        s = self.known.get(w)
        if s is None:
            s = next((x for n in PREFIXES if (x := self.known.get(f"{w[:n]}*")) is not None and len(w) >= n), 0.0)
        return max(min(s, CEILING), -CEILING / 2) - DRIFT

    def scores(self, words: list[str]) -> list[float]:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for w in set(words):
            if w not in cache:
                cache[w] = self.word(w)
        return [cache[w] for w in words]


def distinct_texts(texts: list[list[str]]) -> list[int]:
    """Indices of texts that are no near copies of earlier ones, by two bands of two min-hashes of word triples.

    Copies would count one author's words many times over.
    """
    seen: set = set()
    kept = []
    for i, w in enumerate(texts):
        h = [zlib.crc32(" ".join(x).encode()) for x in zip(w, w[1:], w[2:])] or [zlib.crc32(" ".join(w).encode())]
        low = [min((x * m + 12345) & 0xFFFFFFFF for x in h) for m in (2654435761, 2246822519, 3266489917, 668265263)]
        bands = {(0, low[0], low[1]), (1, low[2], low[3])}
        if not bands & seen:
            kept.append(i)
        seen |= bands
    return kept


class Calibration:
    """Extreme-value parameters of the best segment score in texts that are not toxic."""

    def __init__(self, odds: Odds, clean: list[list[str]]):
        rows = [odds.scores(t) for t in clean]
        seen = Counter(round(s, 2) for row in rows for s in row) or Counter({-1.0: 1})
        values = np.array(list(seen), dtype=float)
        share = np.array(list(seen.values()), dtype=float) / sum(seen.values())
        low, high = 1e-3, 8.0
        for _ in range(60):  # sum(p * exp(lambda * s)) = 1
            mid = (low + high) / 2
            low, high = (mid, high) if float(share @ np.exp(mid * values)) < 1 else (low, mid)
        self.rate = low
        excess = []
        for row in rows:
            best = max((s for _, _, s in segments(row)), default=0.0)
            if row:
                excess.append(self.rate * best - math.log(len(row)))
        self.log_k = float(np.mean(excess)) - 0.5772 if excess else 0.0

    def evidence(self, score: float, words: int) -> float:
        """-ln of the probability that a clean text of this length has a segment so good."""
        x = self.rate * score - math.log(max(words, 1)) - self.log_k
        p = -math.expm1(-math.exp(min(-x, 50.0)))
        return x if p < 1e-12 else -math.log(p)


class Model:
    def __init__(self, texts: list[str], toxic: list[int]):
        read = [words_of(t) for t in texts]
        own = distinct_texts(read)
        texts, toxic = [read[i] for i in own], [toxic[i] for i in own]
        self.ready = 0 < sum(toxic) < len(toxic)
        if not self.ready:
            return
        xs, ys = [], []
        for half in (0, 1):
            own = [i for i in range(len(texts)) if i % 2 == half]
            other = [i for i in range(len(texts)) if i % 2 != half]
            if not 0 < sum(toxic[i] for i in own) < len(own):
                continue
            odds = Odds([texts[i] for i in own], [toxic[i] for i in own])
            cal = Calibration(odds, [texts[i] for i in own if not toxic[i]])
            for i in other:
                xs.append(self._sum(odds, cal, texts[i])[0])
                ys.append(toxic[i])
        self.odds = Odds(texts, toxic)
        self.cal = Calibration(self.odds, [t for t, y in zip(texts, toxic, strict=True) if not y])
        self.slope, self.shift = _logistic(np.array(xs), np.array(ys, dtype=float)) if xs else (1.0, -5.0)

    @staticmethod
    def _sum(odds: Odds, cal: Calibration, text: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
        row = odds.scores(text)
        scored = [(a, b, cal.evidence(s, len(row))) for a, b, s in segments(row)]
        passages = [x for x in scored if x[2] > -math.log(SIGNIFICANT)]
        total = sum(e for _, _, e in passages) or max((e for _, _, e in scored), default=0.0)
        return math.log1p(max(0.0, total)), passages

    def predict(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The score of a text and its toxic passages (first word, end, evidence)."""
        if not self.ready:
            return 0.0, []
        x, passages = self._sum(self.odds, self.cal, words_of(text))
        return 1.0 / (1.0 + math.exp(-max(min(self.slope * x + self.shift, 50.0), -50.0))), passages


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-variable logistic curve, slightly ridged, classes weighted alike."""
    w = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y)
    beta, design = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (y - p)) - 0.5 * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held: int = 1, sample: int = SAMPLE) -> Model:
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null").where(not_held_out(F.col("id"), folds, held))
    known = bounded_sample(known, "id", sample, "y")
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = docs.join(F.broadcast(known), "id").select("id", "text", "y").collect()  # 2 x SAMPLE rows of two numbers are sent, at most
    rows.sort(key=lambda r: r[0])
    return Model([r[1] or "" for r in rows], [r[2] for r in rows])


def predict(df: DataFrame, model: Model, text: str = "text", into: str = "__toxic") -> DataFrame:
    """Adds ``into``: struct (score, passages), the passages as word ranges with their evidence."""

    @F.pandas_udf("score double, passages array<struct<start:int,end:int,evidence:double>>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release_tokens()
        for batch in batches:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["score", "passages"])

    return small_batches(df).withColumn(into, ask(F.col(text)))
