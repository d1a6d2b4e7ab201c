"""Source divergence audit: how far the sources of a language differ in their words, in exact integers.

A language keeps the terms of at least ``least`` of its documents.  A source gives each of them
p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), and two sources differ by the sum of |p - q|.

Heavy-light split: were all sources without a term, two of them would differ by the same |p0 - q0| for each.
Terms that more than one in ``DENSE`` sources of the language hold are laid out as dense tiles of terms by
sources, and two blocks of sources are compared by numpy: what |p - q| has more than |p0 - q0|.  Of the other,
light terms only the postings exist.  What a source's own change against a source without them depends on
the other's q0 only, and is read from the prefix sums of the source's sorted p; a term that both hold is corrected
by |p - q| - |p - q0| - |p0 - q| + |p0 - q0|, posting by posting.  The sums are integers and added.

Terms are counted within each partition first, by document, in a dictionary of a bounded number of entries,
so a source with a third of all rows is a few rows of each task.  Sources are numbered in blocks of
``BLOCK`` and terms dealt over tiles of about ``TILE``; a task holds one tile of two blocks.  Every pair of sources
of a language is a result by definition; it is formed in these tiles, and no rows are joined to make it.

Defined results: null text, language and source are empty strings; a group without terms is a group with
zero counts; no kept terms make all divergences zero; repeated rows count again; very long texts are
counted in whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import cut, small_batches

SCALE, SMOOTH, LEAST, TOP = 1_000_000_000, 5, 30, 50
#: A term is heavy if more than one in so many sources hold it; terms of a tile, sources of a block.
DENSE, TILE, BLOCK = 8, 4096, 64
#: Entries of a task's dictionary before it is emptied, about 200 bytes each, and bits of its count of documents.
ENTRIES, BITS = 500_000, 24
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str) -> list[str]:
    """Runs of ASCII letters and non-ASCII characters, only A-Z lower-cased."""
    return TERM.findall(text.lower() if text.isascii() else text.translate(LOWER))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences, and documents that hold the term; each group has a row of the empty term."""
    said = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by group and term one integer, occurrences above documents
        held: dict[tuple, dict[str, int]] = {}
        size = 0

        def emptied() -> pa.RecordBatch:
            long = [len(own) for own in held.values()]
            packed = np.array([x for own in held.values() for x in own.values()], dtype=np.int64)
            named = [pa.array([k[i] for k in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), long))) for i in (0, 1)]
            out = pa.RecordBatch.from_arrays([*named, pa.array([t for own in held.values() for t in own], pa.string()), pa.array(packed >> BITS), pa.array(packed & ((1 << BITS) - 1))], ["lang", "source", "term", "n", "d"])
            held.clear()
            return out

        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                own = held.setdefault((lang, source), {"": 0})
                before = len(own)
                for term, n in Counter(terms_of(text)).items():
                    own[term] = own.get(term, 0) + (n << BITS | 1)
                size += len(own) - before
                if size >= ENTRIES:
                    yield emptied()
                    size = 0
        if held:
            yield emptied()

    part = small_batches(said).mapInArrow(count, "lang string, source string, term string, n long, d long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exact at any size; 0 without terms."""
    big = lambda c: c.cast("decimal(19,0)")
    share = F.call_function("div", (big(n) + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), F.nullif(big(total) + big(terms) * SMOOTH, F.lit(0).cast("decimal(20,0)")))
    return F.coalesce(share.cast("long") + 1, F.lit(0).cast("long"))


def profiles(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, g, sources, terms, total, whole, p0) and postings (lang, source, g, term, n, p, q, k, p0, sources, terms).

    ``g`` numbers a language's sources, ``terms`` is V, ``q`` the language's p, ``k`` how many sources hold the term.
    """
    of = W.partitionBy("lang", "term")  # as many rows as sources hold the term
    c = counts(docs).withColumn("df", F.sum("d").over(of)).withColumn("ln", F.sum("n").over(of)).withColumn("k", F.count("*").over(of))
    c = cut(c.where((F.col("term") == "") | (F.col("df") >= least)).select("lang", "source", "term", "n", "ln", "k"))
    real = F.col("term") != ""
    groups = c.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = c.where(real).groupBy("lang", "term").agg(F.first("ln").alias("ln")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("ln").alias("whole"))
    groups = groups.join(langs, "lang", "left").na.fill(0, ["terms", "whole"])
    one = W.partitionBy("lang")  # a row a source
    groups = groups.withColumn("g", F.row_number().over(one.orderBy("source")) - 1).withColumn("sources", F.count("*").over(one))
    groups = cut(groups.withColumn("p0", probability(F.lit(0), F.col("total"), F.col("terms"))))
    p, q = probability(F.col("n"), F.col("total"), F.col("terms")), probability(F.col("ln"), F.col("whole"), F.col("terms"))
    postings = c.where(real).join(groups, ["lang", "source"]).select("lang", "source", "g", "term", "n", p.alias("p"), q.alias("q"), "k", "p0", "sources", "terms")
    return groups, cut(postings)


_SUMS = "lang string, a int, b int, value long"


def _pairs(lang: str, rows: np.ndarray, cols: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    """The pairs a < b of two blocks with their sums."""
    a, b = np.meshgrid(rows, cols, indexing="ij")
    keep = a < b
    return pd.DataFrame({"lang": lang, "a": a[keep].astype("int32"), "b": b[keep].astype("int32"), "value": value[keep]})


def _sides(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The source numbers of the two blocks of a tile, rows of which may be of either."""
    block = g["block"].to_numpy()
    return np.unique(g["g"].to_numpy()[block == g["i"].iloc[0]]), np.unique(g["g"].to_numpy()[block == g["j"].iloc[0]])


def _dense(g: pd.DataFrame) -> pd.DataFrame:
    """What the heavy terms of a tile change against absent ones; a row without term gives a source's p of absent terms."""
    rows, cols = _sides(g)
    absent = g[g["term"].isna()].drop_duplicates("g").set_index("g")["p"]
    held = g[g["term"].notna()]
    code, _ = pd.factorize(held["term"])
    width = int(code.max()) + 1 if len(code) else 0

    def tile(own: np.ndarray) -> np.ndarray:
        m = np.repeat(absent.loc[own].to_numpy()[:, None], width, axis=1).astype(np.int64)
        at = held["g"].isin(own).to_numpy()
        m[np.searchsorted(own, held["g"].to_numpy()[at]), code[at]] = held["p"].to_numpy()[at]
        return m

    left, right = tile(rows), tile(cols)
    # a term that none of these sources holds is no column here, so the base counts it and every other as absent
    base = np.abs(absent.loc[rows].to_numpy()[:, None] - absent.loc[cols].to_numpy()[None, :]).astype(np.int64) * width
    value = np.stack([np.abs(right - x).sum(axis=1) for x in left]) - base if width else base
    return _pairs(g["lang"].iloc[0], rows, cols, value)


def _base(g: pd.DataFrame) -> pd.DataFrame:
    """Sums over all terms as if no heavy one were held and no two sources shared a light one.

    Rows are (g, p, number of light terms with it), p null for the source itself.
    """
    rows, cols = _sides(g)
    facts = g[g["p"].isna()].drop_duplicates("g").set_index("g")
    p0, terms = facts["p0"], int(facts["terms"].iloc[0])
    own = {k: x.sort_values("p") for k, x in g[g["p"].notna()].groupby("g")}

    def against(of: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Over the light terms of each source, what |p - q0| has more than |p0 - q0|."""
        out = np.zeros((len(of), len(others)), dtype=np.int64)
        q0 = p0.loc[others].to_numpy().astype(np.int64)
        for i, k in enumerate(of):
            if k in own:
                p, n = own[k]["p"].to_numpy().astype(np.int64), own[k]["cnt"].to_numpy().astype(np.int64)
                upto, words = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * p)])
                below = np.searchsorted(p, q0)
                out[i] = q0 * upto[below] - words[below] + (words[-1] - words[below]) - q0 * (upto[-1] - upto[below]) - upto[-1] * np.abs(int(p0.loc[k]) - q0)
        return out

    a0, b0 = p0.loc[rows].to_numpy().astype(np.int64), p0.loc[cols].to_numpy().astype(np.int64)
    value = terms * np.abs(a0[:, None] - b0[None, :]) + against(rows, cols) + against(cols, rows).T
    return _pairs(g["lang"].iloc[0], rows, cols, value)


def _shared(g: pd.DataFrame) -> pd.DataFrame:
    """Corrections for the light terms that both sources of a pair hold."""
    rows, cols = _sides(g)
    value = np.zeros((len(rows), len(cols)), dtype=np.int64)
    number, p, p0 = g["g"].to_numpy(), g["p"].to_numpy(), g["p0"].to_numpy()
    left, right = (g["block"] == g["i"]).to_numpy(), (g["block"] == g["j"]).to_numpy()
    for own in g.groupby("term").indices.values():
        x, y = own[left[own]], own[right[own]]
        if len(x) and len(y):
            pa_, pb, a0, b0 = p[x][:, None], p[y][None, :], p0[x][:, None], p0[y][None, :]
            value[np.ix_(np.searchsorted(rows, number[x]), np.searchsorted(cols, number[y]))] += np.abs(pa_ - pb) - np.abs(pa_ - b0) - np.abs(a0 - pb) + np.abs(a0 - b0)
    out = _pairs(g["lang"].iloc[0], rows, cols, value)
    return out[out["value"] != 0]


def divergences(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, a, b, value): the divergence of every two sources a < b of a language, by number."""
    heavy = F.col("k") * DENSE > F.col("sources")
    tiles = F.greatest(F.lit(1), F.ceil(F.col("terms") / TILE)).cast("int")
    block = F.floor(F.col("g") / BLOCK).cast("int")
    last = F.floor((F.col("sources") - 1) / BLOCK).cast("int")

    def met(others: Column) -> Column:
        return F.explode(F.transform(others, lambda o: F.struct(block.alias("block"), F.least(block, o).alias("i"), F.greatest(block, o).alias("j"))))

    every = F.sequence(F.lit(0), last)
    tile = F.pmod(F.xxhash64("term"), tiles).cast("int")
    at = ("lang", "tile", "i", "j")
    full = postings.where(heavy).select("lang", "g", "term", "p", tile.alias("tile"), met(every).alias("x")).select("lang", "g", "term", "p", "tile", "x.*")
    alone = groups.select("lang", "g", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), "sources")
    alone = alone.select("lang", "g", "term", "p", "tile", met(every).alias("x")).select("lang", "g", "term", "p", "tile", "x.*")
    dense = full.unionByName(alone).groupBy(*at).applyInPandas(_dense, _SUMS)

    sparse = postings.where(~heavy)
    facts = groups.select("lang", "g", F.lit(None).cast("long").alias("p"), "p0", F.lit(0).cast("long").alias("cnt"), "terms", "sources")
    bars = sparse.groupBy("lang", "g", "p", "sources").agg(F.count("*").alias("cnt")).select("lang", "g", "p", F.lit(None).cast("long").alias("p0"), "cnt", F.lit(None).cast("long").alias("terms"), "sources")
    base = facts.unionByName(bars).select("lang", "g", "p", "p0", "cnt", "terms", met(every).alias("x")).select("lang", "g", "p", "p0", "cnt", "terms", "x.*")
    base = base.groupBy("lang", "i", "j").applyInPandas(_base, _SUMS)

    # a term's postings meet in the blocks that hold it: at most 1 in DENSE of the sources, and no others
    blocks = sparse.where("k > 1").groupBy("lang", "term").agg(F.collect_set(block).alias("blocks"))
    both = sparse.where("k > 1").join(blocks, ["lang", "term"]).select("lang", "g", "term", "p", "p0", tile.alias("tile"), met(F.col("blocks")).alias("x")).select("lang", "g", "term", "p", "p0", "tile", "x.*")
    shared = both.groupBy(*at).applyInPandas(_shared, _SUMS)
    return dense.unionByName(base).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source by divergence, and the ``top`` terms a source has more than its language."""
    groups, postings = profiles(docs, least)
    pairs = cut(divergences(groups, postings))
    name = lambda side: groups.select("lang", F.col("g").alias(side), F.col("source").alias(f"{side}_source"))
    named = pairs.join(name("a"), ["lang", "a"]).join(name("b"), ["lang", "b"])
    each = F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item"))))
    named = named.select("lang", each.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    by = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    named = named.withColumn("rank", F.row_number().over(by))
    over = postings.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)  # Spark keeps a task's best before it shuffles
    return named.unionByName(over)


QUERY_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(list_concat([''], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS term FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), kept AS (
  SELECT lang, term, count(*) AS ln FROM d WHERE term <> '' GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST}
), l AS (
  SELECT lang, count(*) AS v, sum(ln) AS whole FROM kept GROUP BY lang
), c AS (
  SELECT d.lang, d.source, d.term, count(*) AS n FROM d JOIN kept USING (lang, term) GROUP BY ALL
), t AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + (CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + {SMOOTH})) // (coalesce(t.total, 0) + {SMOOTH} * l.v))::BIGINT AS p,
    (1 + (CAST({SCALE} AS HUGEINT) * (k.ln + {SMOOTH})) // (l.whole + {SMOOTH} * l.v))::BIGINT AS q
  FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN t ON g.lang = t.lang AND g.source = t.source
    LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), over AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM over)
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
