"""Dependency-graph operators over an edge list (src, dst); dst may be null, edges may repeat."""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` (a local one on a local master that names none, as in tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codestrata-graph-"))
    return sc.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def nodes(edges: DataFrame) -> DataFrame:
    """Every endpoint once (F1)."""
    e = edges.where("dst is not null")
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


def fan_in_out(edges: DataFrame) -> DataFrame:
    """Distinct targets and sources of each file; self-edges count."""
    e = edges.where("dst is not null").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def coupling(edges: DataFrame) -> DataFrame:
    """Efferent (distinct targets) and afferent coupling (distinct sources other than itself)."""
    e = edges.where("dst is not null").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.when(F.col("src") != F.col("dst"), 1).otherwise(0)))
    return ends.groupBy("node").agg(F.sum("o").alias("efferent"), F.sum("i").alias("afferent"))


def cohesion(efferent, symbols):
    """1 - efferent / symbols in [0, 1]; 0 without symbols."""
    return F.when(symbols > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - efferent / symbols))).otherwise(F.lit(0.0))


def bfs(edges: DataFrame, start: DataFrame, depth: int = 2, direction: str = "forward") -> DataFrame:
    """(source, node, depth): nodes within ``depth`` steps of each start node, at their least depth."""
    fwd = edges.where("dst is not null").select("src", "dst").distinct()
    if direction == "reverse":
        fwd = fwd.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    elif direction == "both":
        fwd = fwd.union(fwd.select("dst", "src")).distinct()
    seen = start.select(F.col("node").alias("source"), "node").distinct().withColumn("depth", F.lit(0).cast("long"))
    edge = seen
    for d in range(1, depth + 1):
        step = edge.join(fwd, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        edge = step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("depth", F.lit(d).cast("long"))
        seen = seen.unionByName(edge)
    return seen.where("depth > 0")


def blast_radius(edges: DataFrame, sources: DataFrame, depth: int = 1, k: int = 25) -> DataFrame:
    """Dependents of several files ranked by how many of them they reach."""
    n = sources.select("node").distinct()
    hit = bfs(edges, n, depth, "reverse").join(n, "node", "left_anti").groupBy("node").agg(F.count_distinct("source").alias("overlap"))
    total = n.agg(F.count("*").alias("n"))
    ranked = hit.orderBy(F.desc("overlap"), "node").limit(k)
    return ranked.join(F.broadcast(total)).select("node", "overlap", F.round(F.least(F.lit(1.0), F.col("overlap") / F.col("n") + 0.3), 6).alias("relevance"))  # one row is broadcast


def staleness(edges: DataFrame, changed: DataFrame, cap: int = 50) -> DataFrame:
    """Changed files, and their direct dependents up to a cap in node order."""
    ch = changed.select("node").distinct()
    dep = bfs(edges, ch, 1, "reverse").select("node").distinct().join(ch, "node", "left_anti").orderBy("node").limit(cap)
    return ch.withColumn("reason", F.lit("content_changed")).union(dep.withColumn("reason", F.lit("dependency_changed")))


def shared_dependencies(edges: DataFrame, files: DataFrame, least: int = 2) -> DataFrame:
    """Targets outside the set that at least two of its files import."""
    s = files.select("node").distinct()
    out = edges.where("dst is not null").join(s, F.col("src") == F.col("node"), "left_semi").join(s, F.col("dst") == F.col("node"), "left_anti")
    return out.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("importers")).where(F.col("importers") >= least)


def scc(edges: DataFrame, core: int = 200_000) -> DataFrame:
    """(node, component) of every strongly connected component of two or more nodes (F2).

    Up to ``core`` edges are solved by one iterative pass.  Of more, nodes without a way in or out are
    trimmed until none is left; the rest is small in dependency graphs and is solved in the same way, or by
    forward-backward colouring over joins.  The component is its smallest node.
    """
    e = _cut(edges.where("dst is not null and src <> dst").select("src", "dst").distinct())
    n = e.count()
    while n > core:
        left = _cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = left.count()
        e, n, before = left, m, n
        if m == before:
            break
    if n > core:
        return _scc_by_colour(e)
    return e.groupBy(F.lit(1).alias("g")).applyInPandas(lambda g: _tarjan(g), "node long, component long")


def _tarjan(g: pd.DataFrame) -> pd.DataFrame:
    adj: dict = {}
    for a, b in zip(g["src"].tolist(), g["dst"].tolist(), strict=True):
        adj.setdefault(a, []).append(b)
        adj.setdefault(b, [])
    index, low, on, stack, out, count = {}, {}, set(), [], [], 0
    for root in adj:
        if root in index:
            continue
        work = [(root, iter(adj[root]))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(adj[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    comp = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        comp.append(w)
                        if w == v:
                            break
                    if len(comp) > 1:
                        out += [(w, min(comp)) for w in comp]
    return pd.DataFrame(out, columns=["node", "component"], dtype="int64")


def _spread(e: DataFrame, start: DataFrame) -> DataFrame:
    """Smallest label that reaches each node: (node, label), labels given by ``start``."""
    told = F.bit_xor(F.xxhash64("node", "label"))  # cannot overflow, as a sum of labels can
    lab = _cut(start)
    before = lab.agg(told).first()[0]
    while True:
        new = lab.unionByName(e.join(lab, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "label")).groupBy("node").agg(F.min("label").alias("label"))
        new = _cut(new)
        now = new.agg(told).first()[0]
        if now == before:
            return new
        lab, before = new, now


def _scc_by_colour(e: DataFrame) -> DataFrame:
    """Colour each node by the smallest node that reaches it; what reaches back within a colour is its component."""
    found = None
    while not e.isEmpty():
        colour = _spread(e, nodes(e).select("node", F.col("node").alias("label")))
        s, t = colour.select(F.col("node").alias("src"), F.col("label").alias("ls")), colour.select(F.col("node").alias("dst"), F.col("label").alias("lt"))
        same = _cut(e.join(s, "src").join(t, "dst").where("ls = lt").select("src", "dst", F.col("ls").alias("label")))
        back = colour.where("node = label")
        while True:
            more = _cut(back.union(same.join(back.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "label")).distinct())
            if more.count() == back.count():
                break
            back = more
        found = back if found is None else found.union(back)
        e = _cut(same.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    big = found.groupBy("label").count().where("count > 1").select("label")
    return found.join(big, "label", "left_semi").select("node", F.col("label").alias("component"))
