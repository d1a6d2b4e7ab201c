"""Language identification.

Method: word-first backoff.  A word seen in training scores its log frequency in each language; an
unseen word scores the mean log frequency of its character n-grams of the greatest length (5, 4, 3,
2, 1, word boundaries marked) of which any was seen.  A document's language is the one with the
largest sum over all its words.

The model is fitted on at most about ``SAMPLE`` documents of each language, and ``TOTAL`` of all (chosen
by a hash of the id, counted beforehand).  Words and n-grams are counted by Spark, and only those seen
often enough reach the driver, so what it holds is bounded by the sample; everything is scored.

Defined results: null text and text without letters (Unicode category L) give ``und`` with score 0;
ties go to the alphabetically first language; without any training rows every text gives ``und``;
null languages are not learned from; repeated rows are learned and scored as often as they occur;
a very long text is scored whole, by its distinct words; columns named like a result are kept beside it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import bounded_sample, cut, not_held_out, release_tokens, small_batches, letter_runs

#: Training documents of each language (expected number; the choice is by hash).
SAMPLE = 600
#: Training documents of all languages together.
TOTAL = 12_000
#: Longest n-gram of the backoff.
LONGEST = 5
#: Words per worker whose scores are kept.
CACHE = 60_000
#: A word or n-gram must occur this often in the sample to count as known.
LEAST, LEAST_GRAM = 2, 6


class Model:
    """Log frequencies of known words and n-grams: ``counts`` has (size, text, counts by language), size 0 for words."""

    def __init__(self, langs: list[str], counts: Iterable[tuple[int, str, Sequence[int]]], longest: int = LONGEST):
        self.langs, self.longest = langs, longest
        n = max(1, len(langs))
        tables: list[dict[str, int]] = [{} for _ in range(longest + 1)]
        values: list[list[Sequence[int]]] = [[] for _ in range(longest + 1)]
        for size, text, row in counts:
            tables[size][text] = len(values[size])
            values[size].append(row)
        # all log frequencies are rows of one matrix: a dictionary entry costs a key and a number
        logs, first = [np.zeros((1, n))], 1
        for table, rows in zip(tables, values, strict=True):
            for text in table:
                table[text] += first
            known = np.array(rows, dtype=np.float64).reshape(-1, n) + 0.5
            logs.append(np.log(known / (known.sum(axis=0) + 1)))
            first += len(rows)
        self.words, self.grams = tables[0], tables
        self.rows = np.concatenate(logs).astype(np.float32)
        self.cache: dict[str, int] = {}
        self.extra = np.zeros((0, n), dtype=np.float32)

    def word(self, w: str) -> int | np.ndarray:
        """The row of a known word, or the mean of the rows of an unseen word's longest known n-grams."""
        if (found := self.words.get(w)) is not None:
            return found
        padded = f" {w} "
        for size in range(min(self.longest, len(padded)), 0, -1):
            level = self.grams[size]
            rows = [r for i in range(len(padded) - size + 1) if (r := level.get(padded[i : i + size])) is not None]
            if rows:
                return self.rows[rows[0]] if len(rows) == 1 else self.rows[rows].mean(axis=0)
        return 0

    def predict(self, text: str | None) -> tuple[str, float]:
        found = Counter(letter_runs(text))
        if not found or not self.langs:
            return "und", 0.0
        if len(self.cache) > CACHE or not len(self.extra):
            self.cache, self.extra, self.used = {}, np.zeros((CACHE, len(self.langs)), dtype=np.float32), 0
        cache, n, at = self.cache, len(self.rows), []
        for w in found:
            i = cache.get(w)
            if i is None:
                i = self.word(w)
                if not isinstance(i, int):
                    if self.used == len(self.extra):
                        self.extra = np.concatenate([self.extra, np.zeros_like(self.extra)])
                    self.extra[self.used] = i
                    i = n + self.used
                    self.used += 1
                cache[w] = i
            at.append(i)
        idx, count = np.array(at), np.fromiter(found.values(), dtype=np.float64)
        seen = idx < n
        scores = count[seen] @ self.rows[idx[seen]] + count[~seen] @ self.extra[idx[~seen] - n]
        best = int(scores.argmax())
        share = scores - scores[best]
        return self.langs[best], float(1.0 / np.exp(np.maximum(share, -700.0)).sum())


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Model:
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("lang is not null and text is not null and id is not null").where(not_held_out(F.col("id"), folds, held))
    rows = bounded_sample(rows, "id", sample, "lang", TOTAL)
    words = cut(rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).groupBy("lang", "w").count())
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    known = words.groupBy("w").agg(_by_lang("count"), F.sum("count").alias("total")).where(F.col("total") >= LEAST).select(F.lit(0).alias("size"), F.col("w").alias("gram"), "by")
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.char_length(padded))), lambda size: F.transform(F.sequence(F.lit(1), F.char_length(padded) - size + 1), lambda i: F.struct(size.alias("size"), F.substring(padded, i, size).alias("gram")))))
    counted = words.select("lang", "count", F.explode(grams).alias("g")).groupBy("g.size", "g.gram", "lang").agg(F.sum("count").alias("n"))
    often = counted.groupBy("size", "gram").agg(_by_lang("n"), F.sum("n").alias("total")).where(F.col("total") >= LEAST_GRAM).select("size", "gram", "by")
    found = sorted((r[0], r[1], [r[2].get(lang, 0) for lang in langs]) for r in known.unionByName(often).collect())
    return Model(langs, found)


def _by_lang(count: str) -> Column:
    return F.map_from_entries(F.collect_list(F.struct("lang", count))).alias("by")


def predict(df: DataFrame, model: Model, text: str = "text", into: str = "__lang") -> DataFrame:
    """Adds ``into``: struct (lang_pred, score), the score being the posterior of the language."""

    @F.pandas_udf("lang_pred string, score double")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release_tokens()
        for batch in batches:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang_pred", "score"])

    return small_batches(df).withColumn(into, ask(F.col(text)))
