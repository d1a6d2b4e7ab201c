"""The engine's twelve tools as functions of a store of tables, each returning a DataFrame.

A :class:`Store` holds the tables of one project by name (files, symbols, edges, commits, commit_files,
summaries, findings, embeddings, docs, projects, jobs, runs, requests); a tool reads what it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import assemble as A
from codestrata.operators import context as C
from codestrata.operators import graph as G
from codestrata.operators import history as H
from codestrata.operators import merge as M
from codestrata.operators import resolve as R
from codestrata.operators import runs as U
from codestrata.operators import vector as V


@dataclass
class Store:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def embedded(store: Store, query: str) -> list[float]:
    """The vector of a query by the offline embedder, as long as the store's vectors."""
    one = store["embeddings"].select(F.size("embedding").alias("n")).first()
    row = store.spark.createDataFrame([(query,)], "text string")
    return list(V.hash_embed(row, "text", dims=one["n"] if one else 64).first()["embedding"])


def search_codebase(store: Store, query: str, vector: list[float] | None = None, limit: int = 15) -> DataFrame:
    """(kind, target, content, relevance) of the code and documents that a query asks for."""
    top = V.topk(store["embeddings"], vector or embedded(store, query), -(-limit * 3 // 2))
    s = store["summaries"].select(F.col("id").alias("vec_id"), "target_id", "level", F.col("content").alias("summary"))
    found = top.join(s, "vec_id").select("target_id", "level", F.when(F.startswith("target_id", F.lit("file:")), F.regexp_replace("target_id", "^file:", "")).alias("path"), "summary", "score")
    words = V.discriminating_words(query)
    return V.partitioned_search(found, query, V.keyword_match(store["files"], words), store["docs"])


def register_project(store: Store, name: str, slug: str, url: str | None = None) -> DataFrame:
    """The projects with one more, unless its slug is known."""
    new = store.spark.createDataFrame([(name, slug, url, 0)], "name string, slug string, url string, ord int")
    old = store["projects"]
    if not U.by_key(old, slug).isEmpty():
        return old
    return old.unionByName(new.drop("ord"), allowMissingColumns=True)


def delete_project(store: Store, slug: str) -> DataFrame:
    """The projects without one."""
    return store["projects"].join(U.by_key(store["projects"], slug).select("slug"), "slug", "left_anti")


def trigger_reindex(store: Store, project_id: int, layers: str) -> DataFrame:
    """The requests with a newer one for a project."""
    new = store.spark.createDataFrame([(project_id, layers)], "project_id long, layers string").withColumn("requested_at", F.current_timestamp())
    return M.latest_request(store["requests"].unionByName(new))


def get_project_status(store: Store, project_id: int) -> DataFrame:
    """The latest run of each layer of a project, and whether a job is active."""
    latest = M.latest_per_group(store["runs"].where(F.col("project_id") == project_id), ["layer"], [F.desc("created_at"), F.desc("id")])
    return latest.join(U.has_active(store["jobs"]), "project_id", "left")


def _findings(store: Store) -> DataFrame:
    return store["findings"]


def _file(store: Store, path: str) -> DataFrame:
    return store["files"].where(F.col("path") == path).select("id", "path")


def get_file_context(store: Store, path: str, budget: int = 4000) -> DataFrame:
    own = _file(store, path).first()
    if own is None:
        return store.spark.createDataFrame([("Error", 1, f'File "{path}" not found in the index.', 15, False)], "heading string, priority int, content string, tokens long, truncated boolean")
    seed = store.spark.createDataFrame([(own["id"],)], "node long")

    def reached(direction: str) -> DataFrame:
        near = G.bfs(store["edges"], seed, 2, direction).where("depth > 0").join(store["files"].select(F.col("id").alias("node"), "path"), "node")
        return A.with_summary(near.select("path", "depth"), store["summaries"])

    s, directory = store["summaries"], path.rsplit("/", 1)[0]
    own_file = s.where(F.col("target_id") == f"file:{path}").select(F.concat(F.lit("**File Summary**\n"), "content").alias("content"), F.lit(1.0).alias("relevance"))
    module = s.where(F.col("target_id") == f"module:{directory}").select(F.concat(F.lit(f"**Module Context** ({directory})\n"), "content").alias("content"), F.lit(0.9).alias("relevance"))
    symbols = store["symbols"].where("exported").where(F.col("file_id") == own["id"]).select(F.coalesce("signature", "name").alias("signature"), "kind")
    findings = _findings(store).where(F.contains("evidence", F.lit(path)))
    return A.file_context(own["id"], own_file.unionByName(module), reached("reverse"), reached("forward"), symbols, findings, store["commit_files"], budget)


def get_module_context(store: Store, module: str, budget: int = 3000) -> DataFrame:
    return A.module_context(module, store["files"], store["summaries"], store["edges"], store["symbols"], _findings(store), budget)


def get_related_files(store: Store, path: str, limit: int = 20) -> DataFrame:
    """Files related to one by imports and shared changes, with their score."""
    own = _file(store, path)
    names = store["files"].select(F.col("id").alias("node"), "path")
    near = G.bfs(store["edges"], own.select(F.col("id").alias("node")), 1, "both").where("depth > 0").join(names, "node").select("path", "depth")
    row = own.first()
    together = H.co_changed(store["commit_files"], row["id"] if row else -1, 2 * limit).select(F.col("file_path").alias("path"), "co_changes")
    none = store.spark.createDataFrame([], "path string, score double")
    return C.related_files(none, near, together, limit)


def get_architecture_overview(store: Store, budget: int = 5000) -> DataFrame:
    top = lambda c: F.substring_index(c, "/", 2)
    names = store["files"].select("id", top(F.col("path")).alias("m"))
    links = store["edges"].join(names.select(F.col("id").alias("src"), F.col("m").alias("source")), "src").join(names.select(F.col("id").alias("dst"), F.col("m").alias("target")), "dst")
    return A.architecture_context(store["summaries"], links.select("source", "target"), _findings(store), store["commit_files"], budget)


def get_change_context(store: Store, path: str | None = None, module: str | None = None, since: str | None = None, until: str | None = None, budget: int = 4000) -> DataFrame:
    row = _file(store, path).first() if path else None
    return A.change_context(store["commits"], store["commit_files"], budget, row["id"] if row else None, module, since, until)


def get_review_context(store: Store, since: str, until: str, budget: int = 8000) -> DataFrame:
    return A.review_context(store["commits"], store["commit_files"], store["summaries"], _findings(store), since, until, budget)


def enrich_task_context(store: Store, query: str, vector: list[float] | None = None, budget: int = 16000) -> DataFrame:
    """All that helps with a task: named files, search, dependants and history."""
    said = store.spark.createDataFrame([(query,)], "q string").select(F.posexplode(T.mentions(F.col("q"))).alias("ord", "mention"))
    said = F.broadcast(said)  # the paths that one text names; their size is unknown to Spark, which would take all files instead
    named = store["files"].join(F.broadcast(R.match_mentions(said, store["files"]).select("path")), "path", "left_semi")
    return A.task_context(named, search_codebase(store, query, vector, 20), store["files"], store["summaries"], store["edges"], store["commits"], store["commit_files"], budget)


TOOLS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        search_codebase, register_project, delete_project, trigger_reindex, get_project_status, get_file_context, get_module_context, get_related_files,
        get_architecture_overview, get_change_context, get_review_context, enrich_task_context,
    )
}
