"""Vector search by product codes with exact re-ranking (I3), and near-duplicate vectors by pivots."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codestrata.operators.graph import _cut
from codestrata.operators.vector import cosine

#: Parts of a vector, codes of a part, and about how many rows the codes are fitted on.
PARTS, CODES, SAMPLE = 32, 64, 8000
#: Candidates of a query that are ranked exactly, queries that are scored in one pass, and pivots at most.
RANKED, QUERIES, PIVOTS = 150, 1000, 2000
#: Rows that a task scores at a time, and vectors of the places of near duplicates that travel together.
SLICE, REGION = 1000, 20_000


def _unit(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of length 1; a null, or a vector of another width, is a row of zeros."""
    m = np.stack([np.asarray(v, dtype=np.float64) if v is not None and len(v) == width else np.zeros(width) for v in vectors]) if len(vectors) else np.zeros((0, width))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _sample(embeddings: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """About ``most`` unit vectors chosen by a hash of the id after a count, at most twice as many, and the count."""
    n = embeddings.count()
    share = int(min(1.0, most / max(1, n)) * (1 << 20)) + 1
    picked = embeddings.where("embedding is not null").where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * most)
    rows = [r[0] for r in picked.select("embedding").collect()]
    width = max((len(r) for r in rows), default=0)
    m = _unit(pd.Series(rows, dtype=object), width)
    return m[np.abs(m).sum(axis=1) > 0], n


def fit(embeddings: DataFrame, parts: int = PARTS, codes: int = CODES, sample: int = SAMPLE) -> list[list[list[float]]]:
    """Centroids of each part: k-means on the parts of a bounded sample."""
    x, _ = _sample(embeddings, sample)
    out = []
    for own in np.array_split(x, min(parts, max(1, x.shape[1])), axis=1):
        centres = own[np.linspace(0, len(own) - 1, min(codes, len(own))).astype(int)] if len(own) else np.zeros((0, own.shape[1]))
        for _ in range(12 if len(own) else 0):
            nearest = (((own**2).sum(axis=1)[:, None] - 2 * own @ centres.T) + (centres**2).sum(axis=1)[None, :]).argmin(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, own)
            n = np.bincount(nearest, minlength=len(centres))[:, None]
            centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
        out.append(centres.tolist())
    return out


def build(embeddings: DataFrame, folder: str, **options: int) -> None:
    """Writes the index of (vec_id, embedding): the centroids, and a code of one byte a part for every row."""
    centres = fit(embeddings, **options)
    spark = embeddings.sparkSession
    spark.createDataFrame([json.dumps(centres)], StringType()).coalesce(1).write.mode("overwrite").text(f"{folder}/model")
    width = sum(len(c[0]) for c in centres if c)

    @F.pandas_udf("binary")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = [np.array(c) for c in centres]
        for vectors in batches:
            x, first, out = _unit(vectors, width), 0, []
            for c in at:
                own = x[:, first : first + c.shape[1]]
                out.append(((c**2).sum(axis=1)[None, :] - 2 * own @ c.T).argmin(axis=1).astype(np.uint8))
                first += c.shape[1]
            yield pd.Series([r.tobytes() for r in np.stack(out, axis=1)], dtype=object)

    own = embeddings.where(F.size("embedding") == width) if width else embeddings.limit(0)
    own.select("vec_id", code("embedding").alias("code")).write.mode("overwrite").parquet(f"{folder}/codes")


def _model(spark: SparkSession, folder: str) -> list[np.ndarray]:
    return [np.array(c) if c else np.zeros((0, 0)) for c in json.loads(spark.read.text(f"{folder}/model").first()[0])]


def candidates(spark: SparkSession, folder: str, queries: DataFrame, ranked: int = RANKED) -> DataFrame:
    """(query_id, vec_id): for each query (query_id, embedding) the ``ranked`` rows whose codes score best.

    Only codes are read.  Queries are scored in passes of up to ``QUERIES``; a task keeps its best for each, and the best
    of those are taken.
    """
    centres = _model(spark, folder)
    width = sum(c.shape[1] for c in centres if len(c))
    codes = spark.read.parquet(f"{folder}/codes")
    kind = dict(queries.dtypes)["query_id"], dict(codes.dtypes)["vec_id"]
    named = np.int64 if kind[1] == "bigint" else object
    passes = max(1, -(-queries.count() // QUERIES))
    found = None
    for i in range(passes):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).select("query_id", "embedding").collect()  # about QUERIES rows
        x = _unit(pd.Series([r[1] for r in rows], dtype=object), width)
        edges = np.cumsum([0, *(c.shape[1] for c in centres)])
        table = [x[:, edges[p] : edges[p + 1]] @ c.T for p, c in enumerate(centres)]
        ids = [r[0] for r in rows]

        def score(batches: Iterator[pd.DataFrame], table=table, ids=ids, named=named) -> Iterator[pd.DataFrame]:
            best = [(np.zeros(0), np.zeros(0, dtype=named))] * len(ids)
            for b in batches:
                for first in range(0, len(b), SLICE):  # scores of all queries with a slice, 8 MB
                    rows = b.iloc[first : first + SLICE]
                    code = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
                    own, total = rows["vec_id"].to_numpy(), np.zeros((len(ids), len(rows)))
                    for p, t in enumerate(table):
                        total += t[:, code[:, p]]
                    for q in range(len(ids)):
                        s, v = np.concatenate([best[q][0], total[q]]), np.concatenate([best[q][1], own])
                        top = np.argpartition(-s, ranked)[:ranked] if len(s) > ranked else slice(None)
                        best[q] = s[top], v[top]
            for q, (s, v) in zip(ids, best, strict=True):
                if len(s):
                    yield pd.DataFrame({"query_id": [q] * len(s), "vec_id": v.tolist(), "s": s})

        part = codes.mapInPandas(score, f"query_id {kind[0]}, vec_id {kind[1]}, s double") if rows else None
        found = part if found is None else found if part is None else found.unionByName(part)
    if found is None:
        return codes.select(F.lit(None).cast(kind[0]).alias("query_id"), "vec_id").limit(0)
    w = W.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    return found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= ranked).select("query_id", "vec_id")


def search(spark: SparkSession, folder: str, embeddings: DataFrame, queries: DataFrame, k: int = 10, ranked: int = RANKED) -> DataFrame:
    """(query_id, vec_id, distance, rank): the ``k`` nearest rows of each query, exact among the candidates."""
    near = _cut(candidates(spark, folder, queries, ranked))
    both = near.join(embeddings.select("vec_id", "embedding"), "vec_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    told = both.select("query_id", "vec_id", F.round(1 - cosine(F.col("embedding"), F.col("q")), 6).alias("distance"))
    w = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return told.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, block: int = 1000) -> DataFrame:
    """Pairs (a < b) with cosine over the threshold, exact (I4, D23); see :func:`meetings`."""
    dealt = meetings(embeddings, threshold, block)[0]

    def near(home: pd.DataFrame, x: np.ndarray, other: pd.DataFrame, y: np.ndarray) -> Iterator[pd.DataFrame]:
        for first in range(0, len(other), SLICE):
            sim = x @ y[first : first + SLICE].T
            i, j = np.nonzero(sim > threshold - 1e-5)
            told = np.round(sim[i, j], 6)
            a, b = home["vec_id"].to_numpy()[i], other["vec_id"].to_numpy()[first + j]
            keep = (told > threshold) & (a != b)
            yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": told[keep]})

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        home, guests = g[g["visits"].isna()], g[g["visits"].notna()]
        if not len(home):
            return pd.DataFrame({"a": [], "b": [], "similarity": []}).astype({"a": "int64", "b": "int64", "similarity": "float64"})
        width = len(g["u"].iloc[0])
        places = {place: (own, _unit(own["u"], width)) for place, own in home.groupby("place")}
        out = []
        if g["chunk"].iloc[0] == 0:
            for own, x in places.values():  # each pair of a place from both sides
                out += [f.drop_duplicates() for f in near(own, x, own, x)]
        y = _unit(guests["u"], width)
        visits = guests["visits"].tolist()
        came: dict[int, list[int]] = {}
        for i, v in enumerate(visits):
            for place in v:
                came.setdefault(int(place), []).append(i)
        for place, at in came.items():
            if place in places:
                out += near(*places[place], guests.iloc[at], y[at])
        found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "similarity": []})
        return found.drop_duplicates(["a", "b"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    return dealt.groupBy("region", "chunk").applyInPandas(meet, "a long, b long, similarity double")


def meetings(embeddings: DataFrame, threshold: float, block: int) -> tuple[DataFrame, float]:
    """Vectors dealt over the groups in which near ones meet, and the share of all pairs that meet.

    Each vector lives in the cell of its nearest pivot, cells in blocks of about ``block``.  By the triangle inequality on
    angles a vector can only be near one of a cell if its angle to the pivot is at most the cell's radius and the
    threshold's angle together, so it visits only such cells, of a higher number than its own; within a cell it visits
    the blocks before its own.  Blocks that follow each other are a region of about ``REGION`` vectors, to which a guest
    travels once, with the list of the blocks that it visits there; guests come in chunks of ``REGION``, so a task holds two regions.
    """
    pivots, n = _sample(embeddings, max(1, min(PIVOTS, -(-embeddings.count() // block))))
    pivots = pivots[:PIVOTS] if len(pivots) else np.zeros((1, 1))
    width = pivots.shape[1]
    slack = 1e-4  # similarities are rounded to six digits before they are compared
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + slack

    @F.pandas_udf("cell int, angle double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            x = _unit(vectors, width)
            angle = np.arccos(np.clip(x @ pivots.T, -1, 1))
            yield pd.DataFrame({"cell": angle.argmin(axis=1).astype("int32"), "angle": angle.min(axis=1)})

    # a zero vector is near none, and one of another width equals no other by definition
    e = embeddings.where(F.size("embedding") == width).select("vec_id", F.col("embedding").alias("u"), place("embedding").alias("p")).select("vec_id", "u", "p.*")
    e = _cut(e.where(F.exists("u", lambda v: v != 0)))
    facts = {r["cell"]: (r["n"], r["r"]) for r in e.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect()}  # at most PIVOTS rows
    size = np.array([facts.get(c, (0, 0.0))[0] for c in range(len(pivots))])
    radius = np.array([facts.get(c, (0, 0.0))[1] for c in range(len(pivots))])
    subs = np.maximum(1, -(-size // block))
    first = np.concatenate([[0], np.cumsum(subs)])  # the places of a cell follow each other
    together = max(1, REGION // block)
    number = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    sub = F.pmod(F.xxhash64("vec_id"), number(subs.tolist())).cast("int")
    e = e.withColumn("place", (number(first[:-1].tolist()) + sub).cast("int"))

    @F.pandas_udf("array<int>")
    def visited(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, cell, own in batches:
            angle = np.arccos(np.clip(_unit(vectors, width) @ pivots.T, -1, 1))
            may = (angle <= radius[None, :] + reach) & (size > 0)[None, :] & (np.arange(len(size))[None, :] > cell.to_numpy()[:, None])
            out = []
            for m, c, p in zip(may, cell, own, strict=True):
                cells = [np.arange(first[c], p), *(np.arange(first[x], first[x + 1]) for x in np.nonzero(m)[0])]
                out.append(np.concatenate(cells).astype("int32"))
            yield pd.Series(out, dtype=object)

    # a vector travels once to a region, with the places that it visits there
    came = e.select("vec_id", "u", "cell", "place", visited("u", "cell", "place").alias("all"))
    of = F.transform("all", lambda p: F.floor(p / together).cast("int"))
    came = came.select("vec_id", "u", "all", F.explode(F.array_distinct(of)).alias("region"))
    came = came.select("vec_id", "u", F.filter("all", lambda p: F.floor(p / together).cast("int") == F.col("region")).alias("visits"), "region")
    told = {r["region"]: (r["n"], r["v"]) for r in came.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.size("visits")).alias("v")).collect()}  # a row a region
    chunks = F.coalesce(F.try_element_at(F.create_map(*(F.lit(int(x)) for r, (n, _) in told.items() for x in (r, -(-n // REGION)))), F.col("region")), F.lit(1)) if told else F.lit(1)
    home = e.select("vec_id", "u", "place", F.lit(None).cast("array<int>").alias("visits"), F.floor(F.col("place") / together).cast("int").alias("region"))
    home = home.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    came = came.select("vec_id", "u", F.lit(None).cast("int").alias("place"), "visits", "region").withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), chunks).cast("int"))
    mean = size.sum() / max(1, first[-1])
    met = sum(int(s) * (int(s) - 1) / 2 / int(b) for s, b in zip(size, subs, strict=True)) + sum(v for _, v in told.values()) * mean
    return home.unionByName(came), met / max(1.0, n * (n - 1) / 2)
