"""Vector search by exact cosine, and the keyword operators around it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_SCORE, BOOST_BASE, BOOST_STEP, ONLY_BASE = 0.35, 0.3, 0.1, 0.7
#: Words that ask for documentation.
DOC_WORDS = frozenset("how why what guide migrate setup explain document documentation docs tutorial example configure install convention pattern".split())
#: Words too common to search file names for.
STOP_WORDS = frozenset(
    "the a an is are was were be been being have has had do does did will would could should may might can shall to of in for "
    "on with at by from as into through during before after above below between out off over under again further then once and but or nor "
    "not no so if it its this that these those we they i you he she my your his her our their what which who when where why how "
    "all each every both few more most other some such than too very just also new old use add make get set check want need still able however".split()
)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector or unequal lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / F.nullif(norm, F.lit(0.0))).otherwise(F.lit(0.0))


def topk(embeddings: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """(vec_id, distance, score) of the nearest vectors."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = F.round(1 - cosine(F.col("embedding"), q), 6)
    return embeddings.select("vec_id", d.alias("distance")).withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - F.col("distance")), 6)).orderBy("distance", "vec_id").limit(k)


def search_split(found: DataFrame, results: int, summaries: int) -> DataFrame:
    """The best code and the best module results of one search (I11); ``found`` has level and distance."""
    kind = F.when(F.col("level").isin("module", "system"), "module").otherwise("code")
    w = W.partitionBy("kind").orderBy("distance", "vec_id")
    ranked = found.withColumn("kind", kind).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= F.when(F.col("kind") == "module", summaries).otherwise(results))


def hash_embed(df: DataFrame, text: str, into: str = "embedding", dims: int = 64) -> DataFrame:
    """Deterministic feature-hashing embedder, the offline default of the provider interface."""
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch.fillna(""):
                v = [0.0] * dims
                for w in t.lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    v[h % dims] += 1.0 if h >> 63 else -1.0
                n = sum(x * x for x in v) ** 0.5 or 1.0
                out.append([x / n for x in v])
            yield pd.Series(out)
    return df.withColumn(into, embed(F.col(text)))


def discriminating_words(text: str) -> list[str]:
    """Words of a query worth searching names for; repeats stay."""
    import re

    words = (re.sub(r"[^A-Za-z0-9]", "", w).lower() for w in re.split(r"[\s,;:!?.()\[\]{}\"'`]+", text))
    return [w for w in words if len(w) >= 4 and w not in STOP_WORDS and not w.isdigit()]


def keyword_match(files: DataFrame, words: list[str], most: int = 15) -> DataFrame:
    """(path, hits): files whose name holds a word that not more than ``most`` files hold."""
    name = F.lower(F.substring_index("path", "/", -1))
    held = F.filter(F.array(*map(F.lit, sorted(set(words)) or [""])), lambda w: (w != "") & F.contains(name, w))
    rows = files.select("path", F.explode(held).alias("word"))
    rare = rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return rows.join(rare, "word").groupBy("path").agg(F.count("*").alias("hits"))


def boost(found: DataFrame, keywords: DataFrame) -> DataFrame:
    """Drops weak results, lifts those whose file name matches, and adds files that match by name only."""
    strong = found.where(F.col("score") >= MIN_SCORE)
    j = strong.join(keywords, "path", "full")
    s = F.when(F.col("score").isNull(), F.least(F.lit(1.0), ONLY_BASE + BOOST_STEP * F.col("hits"))).when(F.col("hits").isNotNull(), F.least(F.lit(1.0), F.col("score") + BOOST_BASE + BOOST_STEP * F.col("hits"))).otherwise(F.col("score"))
    return j.select("path", F.round(s, 6).alias("score"))


def full_text(docs: DataFrame, terms: list[str], each: int = 5) -> DataFrame:
    """(path, content, term): documents that hold a term, the first ``each`` of a term by path, each path once (I8)."""
    rows = None
    for no, term in enumerate(terms):
        at = F.instr(F.lower("content"), term.lower())
        # from 100 characters before the term to 200 after its start
        first = F.greatest(F.lit(1), at - 100)
        cut = F.trim(F.substring(F.col("content"), first, at + 200 - first))
        hit = docs.where(at > 0).orderBy("path").limit(each).select(F.lit(no).alias("no"), F.lit(term).alias("term"), "path", F.concat(F.lit("**"), "path", F.lit("** (full-text match)\n..."), cut, F.lit("...")).alias("content"))
        rows = hit if rows is None else rows.unionByName(hit)
    if rows is None:
        return docs.select(F.lit("").alias("term"), "path", F.lit("").alias("content")).limit(0)
    w = W.partitionBy("path").orderBy("no")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "no")


def partitioned_search(found: DataFrame, query: str, keywords: DataFrame, docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """(kind, target, content, relevance): code and documents of one search (I8).

    ``found`` (target_id, level, path, summary, score) are the vector hits, ``keywords`` (path, hits) files by
    name, ``docs`` (path, content) the texts to fall back on where fewer than three documents are hit.
    """
    from codestrata.operators import context as C

    words = query.lower().split()
    strong = found.where(F.col("score") >= least).withColumn("relevance", C.relevance(F.col("score"), F.coalesce("path", F.lit("")), words))
    asks = any(w in DOC_WORDS for w in discriminating_split(query))
    code = strong.where("level <> 'doc'").join(keywords, "path", "full")
    lifted = F.when(F.col("target_id").isNull(), C.relevance(F.least(F.lit(1.0), ONLY_BASE + BOOST_STEP * F.col("hits")), F.col("path"), words)).when(F.col("hits").isNotNull(), F.least(F.lit(1.0), F.col("relevance") + BOOST_BASE + BOOST_STEP * F.col("hits"))).otherwise(F.col("relevance"))
    label = F.when(F.col("target_id").isNull(), F.concat(F.lit("**"), "path", F.lit("**"))).otherwise(F.concat(F.lit("**"), F.coalesce("path", "target_id"), F.lit("** ("), "level", F.lit(")\n"), "summary"))
    code = code.select(F.lit("code").alias("kind"), F.coalesce("path", "target_id").alias("target"), label.alias("content"), F.round(lifted, 6).alias("relevance"))
    read = strong.where("level = 'doc'")
    told = read.select(F.lit("doc").alias("kind"), F.col("target_id").alias("target"), F.concat(F.lit("**"), "target_id", F.lit("** (doc)\n"), "summary").alias("content"), F.round(F.least(F.lit(1.0), F.col("relevance") + (0.1 if asks else 0.0)), 6).alias("relevance"))
    terms = list(dict.fromkeys(discriminating_words(query)))[:3]
    enough = read.groupBy().agg(F.count("*").alias("n")).where("n < 3")  # one row, or none
    text = full_text(docs.join(read.select("path"), "path", "left_anti"), terms).select(F.lit("doc").alias("kind"), F.col("path").alias("target"), "content", F.lit(0.5).alias("relevance"))
    text = text.withColumn("n", F.lit(1)).join(enough.select(F.lit(1).alias("n")), "n", "left_semi").drop("n")
    return code.unionByName(told).unionByName(text)


def discriminating_split(query: str) -> list[str]:
    """All words of a query in lower case, by white space and punctuation."""
    import re

    return [w for w in re.split(r"[\s,;:!?.()\[\]{}\"'`]+", query.lower()) if w]
