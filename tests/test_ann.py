"""Vector index: recall and rows read; near-duplicate vectors: brute force and pruning."""

import numpy as np
from pyspark.sql import functions as F

from codestrata.operators import ann as N

SF = "/root/testdata/sf0.1"


def test_index_recall_and_share_read(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    N.build(e, str(tmp_path / "index"))
    got = N.search(spark, str(tmp_path / "index"), e, q).toPandas()
    p = e.toPandas()
    m = np.stack(p["embedding"])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    ids = p["vec_id"].to_numpy()
    hits = []
    for query, own in got.groupby("query_id"):
        want = ids[np.lexsort((ids, np.round(1 - m @ m[ids == query][0], 6)))][:10]
        hits.append(len(set(want) & set(own["vec_id"])) / 10)
    assert len(hits) == q.count() and (got.groupby("query_id").size() == 10).all()
    assert np.mean(hits) >= 0.9 and N.RANKED / len(p) <= 0.1


def test_index_of_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [1.0, 0.1])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    N.build(e, str(tmp_path / "i"))
    got = N.search(spark, str(tmp_path / "i"), e, e.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding"), 2).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 6]
    N.build(e.limit(0), str(tmp_path / "none"))
    assert N.search(spark, str(tmp_path / "none"), e, e.select(F.col("vec_id").alias("query_id"), "embedding")).count() == 0


def brute(rows, threshold):
    m = np.array([v for _, v in rows])
    sim = np.round(m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1)), 6)
    return {(min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])) for i in range(len(rows)) for j in range(i) if sim[i, j] > threshold}


def test_near_duplicates_of_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.12).tolist()) for i in range(2000)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (50, 300):
        got = [(r["a"], r["b"]) for r in N.near_duplicates(e, 0.97, block).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 0.97) and len(got) > 1000
    assert N.meetings(e, 0.97, 20)[1] < 0.2


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [0.0, 0.0]), (6, [1.0, 0.001]), (7, [0.0, 1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {(r["a"], r["b"]) for r in N.near_duplicates(e, 0.99, 1).collect()} == {(1, 2), (1, 6), (2, 6)} == {(r["a"], r["b"]) for r in N.near_duplicates(e, 0.99).collect()}
    assert N.near_duplicates(e.limit(0)).count() == 0


def test_guests_travel_once_to_a_region(spark):
    """What is sent grows with regions of blocks, not with blocks (F8)."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1500)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert N.meetings(e, 0.9, 10)[0].count() <= 2 * len(rows)
    assert {(r["a"], r["b"]) for r in N.near_duplicates(e, 0.9, 10).collect()} == brute(rows, 0.9)
