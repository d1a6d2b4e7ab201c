"""Every query of the engine over the driver's tables, with equivalent SQL.

``QUERIES`` maps a name to (function of (spark, sf_dir), SQL or None).
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from codestrata.functions import code as K
from codestrata.functions import text as T
from codestrata.operators import ann as N
from codestrata.operators import assemble as A
from codestrata.operators import context as C
from codestrata.operators import detectors as D
from codestrata.operators import graph as G
from codestrata.operators import history as H
from codestrata.operators import incremental as I
from codestrata.operators import merge as M
from codestrata.operators import resolve as R
from codestrata.operators import vector as V
from codestrata.plans.registry import QUERIES, query
from codestrata.sources import gitlog as L
from codestrata.sources import proxies as P
from codestrata.sources.proxies import with_tables as sql
from codestrata.streaming import events as S

# --- history

@query(sql("SELECT file_path, file_id, count(*) AS changes FROM commit_files WHERE file_id IS NOT NULL GROUP BY 1, 2 ORDER BY changes DESC, file_path LIMIT 15", "commit_files"))
def change_hotspots(spark, d):
    return H.hotspots(P.commit_files(spark, d))


@query(sql("SELECT b.file_path, count(*) AS co_changes FROM (SELECT *, row_number() OVER () AS rid FROM commit_files) a JOIN (SELECT *, row_number() OVER () AS rid FROM commit_files) b ON a.commit_id = b.commit_id AND a.rid <> b.rid WHERE a.file_id = 7 GROUP BY 1 ORDER BY co_changes DESC, b.file_path LIMIT 10", "commit_files"))
def co_changed_files(spark, d):
    return H.co_changed(P.commit_files(spark, d), 7)


@query(sql("SELECT id, sha, author_name, committed_at FROM commits ORDER BY committed_at DESC, id DESC LIMIT 20", "commits"))
def recent_commits(spark, d):
    return H.recent_commits(P.commits(spark, d))


@query(sql("SELECT id, sha, committed_at FROM commits WHERE committed_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'", "commits"))
def commits_in_range(spark, d):
    return H.commits_in_range(P.commits(spark, d), "1996-01-01", "1996-03-31")


@query(sql("SELECT sha, committed_at, CAST(line AS BIGINT) AS line, change_type FROM commit_files JOIN commits ON commit_id = id WHERE file_id = 7 ORDER BY committed_at DESC, sha, line, change_type LIMIT 10", "commits", "commit_files"))
def file_commits(spark, d):
    return H.file_commits(P.commit_files(spark, d), P.commits(spark, d), 7)


@query(sql("SELECT id, sha, coalesce(paths, '') AS paths, coalesce(n, 0) AS n_files FROM commits LEFT JOIN (SELECT commit_id, string_agg(file_path, ',' ORDER BY file_path) AS paths, count(*) AS n FROM commit_files GROUP BY 1) ON id = commit_id", "commits", "commit_files"))
def commits_with_files(spark, d):
    return H.commits_with_files(P.commits(spark, d), P.commit_files(spark, d))


@query(sql("SELECT coalesce(author_name, 'unknown') AS author, count(*) AS commits FROM commits GROUP BY 1", "commits"))
def author_distribution(spark, d):
    return H.author_distribution(P.commits(spark, d))


@query(sql("SELECT count(DISTINCT c.id) AS n_commits, count(DISTINCT file_path) AS n_paths, count(DISTINCT author_name) AS n_authors FROM commits c LEFT JOIN commit_files ON commit_id = c.id", "commits", "commit_files"))
def change_summary(spark, d):
    return H.change_summary(P.commits(spark, d), P.commit_files(spark, d))


@query(sql("SELECT cluster, count(*) AS support FROM (SELECT commit_id, string_agg(p, '|' ORDER BY p) AS cluster, count(*) AS n FROM (SELECT DISTINCT commit_id, 'g' || (file_id % 25) AS p FROM commit_files) GROUP BY 1) WHERE n BETWEEN 2 AND 10 GROUP BY 1 HAVING count(*) >= 2", "commit_files"))
def co_change_clusters(spark, d):
    return H.co_change_clusters(P.commit_files(spark, d).withColumn("file_path", F.concat(F.lit("g"), F.pmod("file_id", F.lit(25)).cast("string"))))


@query(sql("SELECT f.id, f.path, coalesce(n, 0) AS change_frequency, last_changed_at FROM files f LEFT JOIN (SELECT file_id, count(*) AS n, max(committed_at) AS last_changed_at FROM commit_files JOIN commits ON commit_id = id GROUP BY 1) ON f.id = file_id", "files", "commits", "commit_files"))
def change_frequency(spark, d):
    return H.change_frequency(P.files(spark, d), P.commit_files(spark, d), P.commits(spark, d))


# --- quality of summaries

@query(sql("SELECT count(*) AS total, round(avg(quality_score), 6) AS mean_quality, count(*) FILTER (WHERE demoted) AS demoted FROM summaries", "summaries"))
def quality_stats(spark, d):
    return P.summaries(spark, d).agg(F.count("*").alias("total"), F.round(F.avg("quality_score"), 6).alias("mean_quality"), F.count_if("demoted").alias("demoted"))


_BUCKETS = ("unscored", "0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0")


@query(sql("SELECT b.bucket, count(s.id) AS n FROM (VALUES ('unscored'), ('0.0-0.2'), ('0.2-0.4'), ('0.4-0.6'), ('0.6-0.8'), ('0.8-1.0')) b(bucket) LEFT JOIN (SELECT id, CASE WHEN quality_score IS NULL THEN 'unscored' WHEN quality_score < 0.2 THEN '0.0-0.2' WHEN quality_score < 0.4 THEN '0.2-0.4' WHEN quality_score < 0.6 THEN '0.4-0.6' WHEN quality_score < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bucket FROM summaries) s ON b.bucket = s.bucket GROUP BY 1", "summaries"))
def quality_distribution(spark, d):
    q = F.col("quality_score")
    bucket = F.when(q.isNull(), _BUCKETS[0])
    for i, name in enumerate(_BUCKETS[1:5], 1):
        bucket = bucket.when(q < F.lit(i / 5), name)
    n = P.summaries(spark, d).groupBy(bucket.otherwise(_BUCKETS[5]).alias("bucket")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(b,) for b in _BUCKETS], "bucket string")
    return names.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(sql("SELECT coalesce(level, 'all') AS level, round(avg(quality_score), 6) AS mean_quality, count(*) AS n FROM summaries GROUP BY ROLLUP (level)", "summaries"))
def quality_by_level(spark, d):
    r = P.summaries(spark, d).rollup("level").agg(F.round(F.avg("quality_score"), 6).alias("mean_quality"), F.count("*").alias("n"))
    return r.select(F.coalesce("level", F.lit("all")).alias("level"), "mean_quality", "n")


@query(sql("SELECT id, target_id FROM summaries WHERE demoted", "summaries"))
def demoted_summaries(spark, d):
    return P.summaries(spark, d).where("demoted").select("id", "target_id")


@query(sql("SELECT id, quality_score FROM summaries WHERE quality_score < 0.4 ORDER BY quality_score, id", "summaries"))
def low_quality_summaries(spark, d):
    return P.summaries(spark, d).where(F.col("quality_score") < 0.4).select("id", "quality_score").orderBy("quality_score", "id")


@query(sql("SELECT id, target_id FROM summaries WHERE content ILIKE '%benchmark%' OR content ILIKE '%with the%' ORDER BY target_id, id LIMIT 50", "summaries"))
def doc_fulltext(spark, d):
    c = F.col("content")
    return P.summaries(spark, d).where(c.ilike("%benchmark%") | c.ilike("%with the%")).select("id", "target_id").orderBy("target_id", "id").limit(50)


# --- runs, jobs, queues

@query(sql("SELECT layer, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY created_at DESC, id DESC) AS k FROM runs) WHERE k = 1", "runs"))
def latest_run_per_layer(spark, d):
    return M.latest_per_group(P.runs(spark, d), ["layer"], [F.desc("created_at"), F.desc("id")]).select("layer", "id", "created_at")


@query(sql("SELECT layer, round(sum(coalesce(cost_usd, 0)), 4) AS cost FROM runs GROUP BY 1", "runs"))
def run_cost_by_layer(spark, d):
    return P.runs(spark, d).groupBy("layer").agg(F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 4).alias("cost"))


@query(sql("SELECT project_id, id FROM (SELECT project_id, id, coalesce(sum(coalesce(cost_usd, 0)) OVER (PARTITION BY project_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM runs) WHERE spent < 500", "runs"))
def budget_cutoff(spark, d):
    return I.budget_cutoff(P.runs(spark, d), "project_id", ["created_at", "id"], "cost_usd", 500.0).select("project_id", "id")


@query(sql("SELECT r.id, coalesce(c_name, 'Unknown') AS project_name, created_at FROM runs r LEFT JOIN customer ON c_custkey = project_id ORDER BY created_at DESC, r.id DESC LIMIT 100", "runs"))
def jobs_with_project(spark, d):
    c = P.read(spark, d, "customer").select("c_custkey", "c_name")
    j = P.runs(spark, d).orderBy(F.desc("created_at"), F.desc("id")).limit(100).join(c, F.col("project_id") == F.col("c_custkey"), "left")
    return j.select("id", F.coalesce("c_name", F.lit("Unknown")).alias("project_name"), "created_at")


_JOBS = "(SELECT id, project_id, created_at, CASE layer WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'running' ELSE 'pending' END AS status FROM runs)"


def _jobs(spark, d):
    s = F.col("layer")
    return P.runs(spark, d).select("id", "project_id", "created_at", F.when(s == "click", "completed").when(s == "error", "failed").when(s == "purchase", "running").otherwise("pending").alias("status"))


@query(sql(f"SELECT id, project_id, created_at FROM {_JOBS} WHERE status = 'pending' ORDER BY created_at, id LIMIT 1", "runs"))
def pending_queue_head(spark, d):
    return I.claim_next(_jobs(spark, d)).select("id", "project_id", "created_at")


_STATES = "(SELECT project_id, CASE arg_max(layer, (created_at, id)) WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'running' ELSE 'pending' END AS status FROM runs GROUP BY 1)"


@query(sql(f"SELECT project_id, min(created_at) AS requested_at FROM {_JOBS} j WHERE status = 'failed' AND project_id NOT IN (SELECT project_id FROM {_STATES} WHERE status IN ('pending', 'running')) GROUP BY 1", "runs"))
def active_project_dedup(spark, d):
    """A project's job is in the state that its latest run left it in."""
    last = P.runs(spark, d).groupBy("project_id").agg(F.max_by("layer", F.struct("created_at", "id")).alias("s"))
    state = F.when(F.col("s") == "click", "completed").when(F.col("s") == "error", "failed").when(F.col("s") == "purchase", "running").otherwise("pending")
    j = _jobs(spark, d)
    return I.drain_requests(j.where("status = 'failed'").withColumnRenamed("created_at", "requested_at"), last.select("project_id", state.alias("status")))


@query(sql(f"SELECT status, count(*) AS n FROM {_JOBS} GROUP BY 1", "runs"))
def job_counts(spark, d):
    return _jobs(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT user_id AS project_id, arg_max(event_type, (ts, event_id)) AS layers, max(ts) AS requested_at FROM events GROUP BY 1")
def latest_requests(spark, d):
    r = P.runs(spark, d).select("project_id", F.col("layer").alias("layers"), F.struct("created_at", "id").alias("requested_at"))
    return M.latest_request(r).select("project_id", "layers", F.col("requested_at.created_at").alias("requested_at"))


# --- graph metrics and detectors

@query(sql("SELECT node, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM (SELECT src AS node, count(DISTINCT dst) AS o, 0 AS i FROM edges30 WHERE dst IS NOT NULL GROUP BY 1 UNION ALL SELECT dst, 0, count(DISTINCT src) FROM edges30 WHERE dst IS NOT NULL GROUP BY 1) GROUP BY 1", "edges30"))
def fan_in_out(spark, d):
    return G.fan_in_out(P.dependencies(spark, d, 30))


_COUPLING = "SELECT node, CAST(sum(o) AS BIGINT) AS efferent, CAST(sum(i) AS BIGINT) AS afferent FROM (SELECT src AS node, count(DISTINCT dst) AS o, 0 AS i FROM edges30 WHERE dst IS NOT NULL GROUP BY 1 UNION ALL SELECT dst, 0, count(DISTINCT CASE WHEN src <> dst THEN src END) FROM edges30 WHERE dst IS NOT NULL GROUP BY 1) GROUP BY 1"


@query(sql(_COUPLING, "edges30"))
def coupling_metrics(spark, d):
    return G.coupling(P.dependencies(spark, d, 30))


def _cohesion(spark, d):
    n = P.symbols(spark, d).groupBy("file_id").agg(F.count("*").alias("n_symbols"))
    m = G.coupling(P.dependencies(spark, d, 30)).join(n, F.col("node") == F.col("file_id"), "left")
    return m.select("node", "efferent", "afferent", G.cohesion(F.col("efferent"), F.coalesce("n_symbols", F.lit(0))).alias("cohesion"))


_COHESION = f"SELECT node, efferent, afferent, CASE WHEN coalesce(n, 0) > 0 THEN greatest(0.0, least(1.0, 1 - efferent / n)) ELSE 0.0 END::DOUBLE AS cohesion FROM ({_COUPLING}) LEFT JOIN (SELECT file_id, count(*) AS n FROM symbols GROUP BY 1) ON node = file_id"


@query(sql(f"SELECT node, round(cohesion, 6) AS cohesion FROM ({_COHESION})", "edges30", "symbols"))
def cohesion(spark, d):
    return _cohesion(spark, d).select("node", F.round("cohesion", 6).alias("cohesion"))


@query(sql("SELECT file_id, count(*) AS n_symbols FROM symbols GROUP BY 1", "symbols"))
def symbols_per_file(spark, d):
    return P.symbols(spark, d).groupBy("file_id").agg(F.count("*").alias("n_symbols"))


@query(sql("SELECT node, fan_in, fan_out, CASE WHEN fan_in + fan_out > 40 THEN 'high' WHEN fan_in + fan_out > 30 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT node, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM (SELECT src AS node, count(DISTINCT dst) AS o, 0 AS i FROM edges30 WHERE dst IS NOT NULL GROUP BY 1 UNION ALL SELECT dst, 0, count(DISTINCT src) FROM edges30 WHERE dst IS NOT NULL GROUP BY 1) GROUP BY 1) WHERE fan_in >= 8 AND fan_out >= 8 AND fan_in + fan_out >= 20", "edges30"))
def god_modules(spark, d):
    return D.god_modules(G.fan_in_out(P.dependencies(spark, d, 30)))


@query(sql(f"WITH m AS ({_COHESION}) SELECT node, 'efferent' AS metric, CAST(efferent AS DOUBLE) AS value, CASE WHEN efferent > 30 THEN 'high' ELSE 'medium' END AS severity FROM m WHERE efferent > 15 UNION ALL SELECT node, 'afferent', afferent, CASE WHEN afferent > 40 THEN 'high' ELSE 'medium' END FROM m WHERE afferent > 20 UNION ALL SELECT node, 'total', efferent + afferent, CASE WHEN efferent + afferent > 50 THEN 'high' ELSE 'medium' END FROM m WHERE efferent + afferent > 25 UNION ALL SELECT node, 'cohesion', round(cohesion, 6), 'low' FROM m WHERE cohesion < 0.2 AND cohesion >= 0", "edges30", "symbols").replace(" WITH m AS", ", m AS", 1))
def coupling_findings(spark, d):
    return D.coupling_findings(_cohesion(spark, d)).withColumn("value", F.round("value", 6))


_LEVEL = "CASE WHEN regexp_matches(path, '(^|/)(db|data|database|dal|repository|repo)/', 'i') THEN 0 WHEN regexp_matches(path, '(^|/)(schema|migration|drizzle)/', 'i') THEN 0 WHEN regexp_matches(path, '(^|/)(domain|model|models|entities|types)/', 'i') THEN 1 WHEN regexp_matches(path, '(^|/)(service|services|logic|core)/', 'i') THEN 2 WHEN regexp_matches(path, '(^|/)(indexer|engine|pipeline)/', 'i') THEN 2 WHEN regexp_matches(path, '(^|/)(api|routes?|controller|handler)/', 'i') THEN 3 WHEN regexp_matches(path, '(^|/)(ui|views?|components?|pages?|dashboard)/', 'i') THEN 4 WHEN regexp_matches(path, '(^|/)(cli|commands?)/', 'i') THEN 4 END"


@query(sql(f"SELECT id, path, coalesce({_LEVEL}, -1) AS level FROM files", "files"))
def classify_layer(spark, d):
    return P.files(spark, d).select("id", "path", F.coalesce(D.layer_level(F.col("path")), F.lit(-1)).alias("level"))


@query(sql(f"SELECT src_path, dst_path, CASE WHEN a < b THEN 'upward' ELSE 'skip' END AS kind, CASE WHEN b - a > 2 THEN 'high' WHEN a < b THEN 'medium' ELSE 'low' END AS severity FROM (SELECT s.path AS src_path, t.path AS dst_path, s.lv AS a, t.lv AS b FROM edges45 JOIN (SELECT id, path, {_LEVEL} AS lv FROM files) s ON src = s.id JOIN (SELECT id, path, {_LEVEL} AS lv FROM files) t ON dst = t.id) WHERE a < b OR a - b > 1", "edges45", "files"))
def layering_violations(spark, d):
    return D.layering_violations(P.dependencies(spark, d, 45), P.files(spark, d))


@query(sql("SELECT file_id, count(*) AS n_dead, string_agg(name, ',' ORDER BY name) AS names, CASE WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS severity FROM symbols WHERE exported AND file_id NOT IN (SELECT dst FROM edges45 WHERE dst IS NOT NULL) GROUP BY 1", "symbols", "edges45"))
def dead_code(spark, d):
    used = P.dependencies(spark, d, 45).where("dst is not null").select(F.col("dst").alias("file_id"))
    return D.dead_code(P.symbols(spark, d), used)


@query(sql("reach(a, b) AS (SELECT src, dst FROM trade UNION SELECT a, dst FROM reach JOIN trade ON b = src) SELECT component, count(*) AS cycle_length, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members, CASE WHEN count(*) > 5 THEN 'high' WHEN count(*) > 2 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT x.a AS node, min(x.b) AS component, count(DISTINCT x.b) AS n FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1) WHERE n > 1 GROUP BY 1", "trade").replace(" reach(a, b)", ", reach(a, b)", 1))
def circular_dependencies(spark, d):
    return D.circular_dependencies(G.scc(P.trade(spark, d)))


_FOUND = "(SELECT event_id AS ord, CASE WHEN event_type = 'error' THEN 'coupling' ELSE event_type END AS category, CASE WHEN event_id % 3 = 0 THEN 'high' WHEN event_id % 3 = 1 THEN 'medium' ELSE 'low' END AS severity, 'f' || (user_id % 50) AS file, round(value / 100, 2) AS confidence FROM events)"


def _findings(spark, d):
    e = P.read(spark, d, "events")
    k = F.pmod("event_id", F.lit(3))
    return e.select(F.col("event_id").alias("ord"), F.when(F.col("event_type") == "error", "coupling").otherwise(F.col("event_type")).alias("category"), F.when(k == 0, "high").when(k == 1, "medium").otherwise("low").alias("severity"), F.concat(F.lit("f"), F.pmod("user_id", F.lit(50)).cast("string")).alias("file"), F.round(F.col("value") / 100, 2).alias("confidence"))


@query(f"SELECT fingerprint, ord, confidence FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY confidence DESC NULLS LAST, ord) AS k FROM (SELECT *, sha256(category || '|' || file || '|' || severity) AS fingerprint FROM {_FOUND})) WHERE k = 1")
def findings_dedup(spark, d):
    f = _findings(spark, d)
    return D.dedup_findings(f.withColumn("fingerprint", D.fingerprint(F.col("category"), F.col("file"), F.col("severity")))).select("fingerprint", "ord", "confidence")


@query(f"SELECT ord, sha256(category || '|' || file || '|' || severity) AS fingerprint, CASE severity WHEN 'high' THEN 0.85 WHEN 'medium' THEN 0.6 ELSE 0.4 END::DOUBLE AS relevance FROM {_FOUND}")
def fingerprints(spark, d):
    return _findings(spark, d).select("ord", D.fingerprint(F.col("category"), F.col("file"), F.col("severity")).alias("fingerprint"), C.severity_relevance(F.col("severity")).alias("relevance"))


@query(f"SELECT ord, severity FROM {_FOUND} WHERE severity IN ('high', 'medium') ORDER BY ord LIMIT 50")
def severity_filter(spark, d):
    return _findings(spark, d).where(F.col("severity").isin("critical", "high", "medium")).select("ord", "severity").orderBy("ord").limit(50)


@query("SELECT event_id AS id FROM events e WHERE event_type = 'error' AND (instr(props, '\"k\": 1') > 0 OR instr(props, '\"k\": 6') > 0)")
def findings_by_path(spark, d):
    paths = ['"k": 1', '"k": 6']
    any_of = F.exists(F.array(*map(F.lit, paths)), lambda p: F.contains("props", p))
    return P.read(spark, d, "events").where((F.col("event_type") == "error") & any_of).select(F.col("event_id").alias("id"))


# --- traversal

def _seed(spark, n: int = 1):
    return spark.range(n).select(F.col("id").alias("node"))


def _bfs_sql(edges: str, n: int = 0) -> str:
    return sql(f"e AS ({edges}), walk(source, node, depth) AS (SELECT s, s, 0 FROM range({n + 1}) t(s) UNION SELECT source, dst, depth + 1 FROM walk JOIN e ON node = src WHERE depth < 2) SELECT source, node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY 1, 2 HAVING min(depth) > 0", "edges45").replace(" e AS (", ", e AS (", 1)


_FWD, _REV = "SELECT src, dst FROM edges45 WHERE dst IS NOT NULL", "SELECT dst AS src, src AS dst FROM edges45 WHERE dst IS NOT NULL"


@query(_bfs_sql(_FWD, 4))
def bfs_forward(spark, d):
    return G.bfs(P.dependencies(spark, d, 45), _seed(spark, 5))


@query(_bfs_sql(_REV, 4))
def bfs_reverse(spark, d):
    return G.bfs(P.dependencies(spark, d, 45), _seed(spark, 5), direction="reverse")


@query(_bfs_sql(f"{_FWD} UNION {_REV}", 4))
def bfs_both(spark, d):
    return G.bfs(P.dependencies(spark, d, 45), _seed(spark, 5), direction="both")


@query(sql("SELECT src AS node, count(DISTINCT dst) AS overlap, round(least(1.0, count(DISTINCT dst) / 20 + 0.3), 6)::DOUBLE AS relevance FROM edges45 WHERE dst < 20 AND src >= 20 GROUP BY 1 ORDER BY overlap DESC, node LIMIT 25", "edges45"))
def blast_radius(spark, d):
    return G.blast_radius(P.dependencies(spark, d, 45), _seed(spark, 20))


@query(sql("SELECT s AS node, 'content_changed' AS reason FROM range(10) t(s) UNION ALL SELECT node, 'dependency_changed' FROM (SELECT DISTINCT src AS node FROM edges45 WHERE dst < 10 AND src >= 10 ORDER BY 1 LIMIT 50)", "edges45"))
def staleness(spark, d):
    return G.staleness(P.dependencies(spark, d, 45), _seed(spark, 10))


@query(sql("SELECT dst AS node, count(DISTINCT src) AS importers FROM edges30 WHERE src < 100 AND dst >= 100 GROUP BY 1 HAVING count(DISTINCT src) >= 2", "edges30"))
def shared_dependencies(spark, d):
    return G.shared_dependencies(P.dependencies(spark, d, 30), _seed(spark, 100))


@query(sql("SELECT DISTINCT src, dst FROM edges45 JOIN files a ON src = a.id JOIN files b ON dst = b.id WHERE a.path NOT LIKE '%.md' AND b.path NOT LIKE '%.md'", "edges45", "files"))
def graph_export(spark, d):
    code = P.files(spark, d).where(~T.is_doc(F.col("path"))).select("id")
    e = P.dependencies(spark, d, 45).where("dst is not null")
    return e.join(code, F.col("src") == F.col("id"), "left_semi").join(code, F.col("dst") == F.col("id"), "left_semi").distinct()


# --- modules

_MODULE = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


@query(sql(f"SELECT {_MODULE} AS module, count(*) AS file_count, CAST(sum(line_count) AS BIGINT) AS lines, round(coalesce(avg(CASE WHEN complexity > 0 THEN complexity END), 0), 4) AS mean_complexity FROM files GROUP BY 1", "files"))
def module_rollup(spark, d):
    f = P.files(spark, d).withColumn("module", I.dirname(F.col("path"))).where("module is not null")
    return f.groupBy("module").agg(F.count("*").alias("file_count"), F.sum("line_count").alias("lines"), F.round(F.coalesce(F.avg(F.when(F.col("complexity") > 0, F.col("complexity"))), F.lit(0.0)), 4).alias("mean_complexity"))


@query(sql("SELECT a AS module, string_agg(b, ',' ORDER BY b) AS targets FROM (SELECT DISTINCT regexp_extract(s.path, '^[^/]+/[^/]+') AS a, regexp_extract(t.path, '^[^/]+/[^/]+') AS b FROM edges45 JOIN files s ON src = s.id JOIN files t ON dst = t.id) WHERE a <> b GROUP BY 1", "edges45", "files"))
def inter_module_edges(spark, d):
    m = P.files(spark, d).select("id", F.substring_index("path", "/", 2).alias("m"))
    e = P.dependencies(spark, d, 45).join(m.select(F.col("id").alias("src"), F.col("m").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("m").alias("b")), "dst").where("a <> b")
    return e.groupBy(F.col("a").alias("module")).agg(F.array_join(F.array_sort(F.collect_set("b")), ",").alias("targets"))


@query(sql("SELECT module, count(*) AS n FROM (SELECT path, max(m) AS module FROM files JOIN (SELECT DISTINCT regexp_extract(path, '^[^/]+/[^/]+') AS m FROM files WHERE id % 2 = 0 UNION SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM files WHERE id % 5 = 0) ON starts_with(path, m || '/') GROUP BY 1) GROUP BY 1", "files"))
def subsystem_groups(spark, d):
    f = P.files(spark, d)
    mods = f.where("id % 2 = 0").select(F.substring_index("path", "/", 2).alias("m")).union(f.where("id % 5 = 0").select(I.dirname(F.col("path")))).distinct()
    parts = F.split("path", "/")
    up = f.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("m"))
    return up.join(mods, "m").groupBy("path").agg(F.max_by("m", F.char_length("m")).alias("module")).groupBy("module").agg(F.count("*").alias("n"))


@query(sql("SELECT id, path, CASE lower(regexp_extract(path, '(\\.[^.]*)$', 1)) WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' WHEN '.js' THEN 'javascript' WHEN '.py' THEN 'python' END AS language FROM files", "files"))
def language_detect(spark, d):
    return P.files(spark, d).select("id", "path", T.language(F.col("path")).alias("language"))


@query(sql("SELECT id, path LIKE '%.md' AS is_doc, starts_with(path, 'src/api/') AS in_api FROM files", "files"))
def file_classification(spark, d):
    return P.files(spark, d).select("id", T.is_doc(F.col("path")).alias("is_doc"), F.col("path").startswith("src/api/").alias("in_api"))


@query(sql("SELECT id, path FROM files WHERE regexp_matches(path, '^src/(?:.*/)?[^/]*_1[^/]*\\.py$')", "files"))
def glob_files(spark, d):
    return P.files(spark, d).where(F.col("path").rlike(T.glob_regex("src/**/*_1*.py"))).select("id", "path")


# --- incremental

_DISK = "(SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 0 THEN 'x' || sha256(text) ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 13 <> 0)"
_KNOWN = "(SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS content_hash FROM documents WHERE doc_id % 10 <> 0)"


def _slices(spark, d):
    doc = P.read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("h"))
    disk = doc.where("doc_id % 13 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), "h")).otherwise(F.col("h")).alias("content_hash"))
    return disk, doc.where("doc_id % 10 <> 0").select("path", F.col("h").alias("content_hash"))


@query(f"SELECT a.path, CASE WHEN b.path IS NULL THEN 'added' ELSE 'changed' END AS change FROM {_DISK} a LEFT JOIN {_KNOWN} b ON a.path = b.path WHERE b.content_hash IS DISTINCT FROM a.content_hash")
def cdc_changed_files(spark, d):
    return I.changed_files(*_slices(spark, d))


@query(f"SELECT path FROM {_KNOWN} WHERE path NOT IN (SELECT path FROM {_DISK} a)")
def cdc_deleted_files(spark, d):
    return I.deleted_files(*_slices(spark, d))


@query(f"SELECT b.path, b.content_hash FROM {_KNOWN} b WHERE b.path NOT IN (SELECT path FROM {_DISK} a) UNION ALL SELECT path, content_hash FROM {_DISK} a")
def upsert_keep_last(spark, d):
    disk, known = _slices(spark, d)
    twice = disk.select("path", F.lit("old").alias("content_hash"), F.lit(0).alias("ord")).unionByName(disk.withColumn("ord", F.lit(1)))
    return M.upsert_keep_last(known, twice, ["path"], "ord")


@query(f"SELECT path, content_hash FROM {_DISK} a WHERE path NOT IN (SELECT path FROM {_KNOWN} b)")
def insert_ignore(spark, d):
    disk, known = _slices(spark, d)
    return M.insert_ignore(known, disk.withColumn("ord", F.lit(0)).unionByName(disk.withColumn("ord", F.lit(1))), ["path"], "ord")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 10 = 0 OR doc_id % 7 = 0) AS changed, round(count(*) FILTER (WHERE doc_id % 10 = 0 OR doc_id % 7 = 0) / count(*), 6) AS delta FROM documents")
def summary_delta(spark, d):
    doc = P.read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("target_id"), F.col("text").alias("content"))
    old = doc.where("doc_id % 10 <> 0").withColumn("input_hash", F.lit("a"))
    new = doc.select("target_id", F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("content")).alias("content"), F.when(F.col("doc_id") % 7 == 0, "b").otherwise("a").alias("input_hash"))
    return I.summary_delta(old, new)


@query(sql(f"SELECT DISTINCT 'module' AS level, 'module:' || {_MODULE} AS target_id FROM files WHERE id % 97 = 0 UNION ALL SELECT 'system', 'system:project'", "files"))
def dirty_rollup(spark, d):
    return I.dirty_modules(P.files(spark, d).where("id % 97 = 0"))


# --- vectors and ranking

def _query_vector(spark, d) -> list[float]:
    return list(P.read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"SELECT e.vec_id, round(1 - {_COS}, 6) AS distance, round(greatest(0.0, 1 - round(1 - {_COS}, 6)), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, e.vec_id LIMIT 10")
def vector_topk(spark, d):
    return V.topk(P.read(spark, d, "embeddings"), _query_vector(spark, d))


@query(sql(f"SELECT e.vec_id, round(1 - {_COS}, 6) AS distance, s.target_id, s.level FROM embeddings e JOIN summaries s ON s.id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, e.vec_id LIMIT 10", "summaries"))
def vector_topk_enriched(spark, d):
    s = P.summaries(spark, d).select("id", "target_id", "level")
    both = P.read(spark, d, "embeddings").join(s, F.col("vec_id") == F.col("id"), "left_semi")
    return V.topk(both, _query_vector(spark, d)).join(s, F.col("vec_id") == F.col("id")).select("vec_id", "distance", "target_id", "level")


@query(f"SELECT e.vec_id AS a, q.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings e JOIN embeddings q ON e.vec_id < q.vec_id WHERE round({_COS}, 6) > 0.4")
def near_duplicates(spark, d):
    return N.near_duplicates(P.read(spark, d, "embeddings"), 0.4)


@query("SELECT count(*) AS total, count(doc_id) AS joined FROM embeddings LEFT JOIN documents ON vec_id = doc_id")
def embedding_counts(spark, d):
    j = P.read(spark, d, "embeddings").select("vec_id").join(P.read(spark, d, "documents").select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left")
    return j.agg(F.count("*").alias("total"), F.count("doc_id").alias("joined"))


@query(sql("SELECT path, count(*) AS hits FROM (SELECT path, word FROM files, (VALUES ('green'), ('_77'), ('_12')) w(word) WHERE instr(lower(regexp_extract(path, '[^/]*$')), word) > 0) JOIN (SELECT word, count(*) AS n FROM files, (VALUES ('green'), ('_77'), ('_12')) w(word) WHERE instr(lower(regexp_extract(path, '[^/]*$')), word) > 0 GROUP BY 1) USING (word) WHERE n <= 15 GROUP BY 1", "files"))
def keyword_match(spark, d):
    return V.keyword_match(P.files(spark, d), ["green", "_77", "_12"])


@query(sql("SELECT id, round(greatest(0.0, least(1.0, line_count / 100 * (1 + 0.15 * ((instr(lower(path), 'api') > 0)::INT + (instr(lower(path), 'green') > 0)::INT)))), 6)::DOUBLE AS relevance FROM files", "files"))
def relevance_score(spark, d):
    return P.files(spark, d).select("id", F.round(C.relevance(F.col("line_count") / 100, F.col("path"), ["api", "green"]), 6).alias("relevance"))


_KEYED = "SELECT substr(content, 1, 100) AS key, id, quality_score AS r, 1 - quality_score AS r2 FROM summaries WHERE quality_score IS NOT NULL AND content IS NOT NULL"


@query(sql(f"SELECT key, round(coalesce(0.6 * a.r, 0) + coalesce(0.4 * b.r, 0) + 0.15 * (coalesce(n, 0) - CASE WHEN a.r IS NULL THEN 1 ELSE 0 END), 6) AS relevance FROM (SELECT key, arg_max(r, id) AS r FROM ({_KEYED}) WHERE r >= 0.3 GROUP BY 1) a FULL JOIN (SELECT key, sum(r2) AS r, count(*) AS n FROM ({_KEYED}) WHERE r2 >= 0.3 GROUP BY 1) b USING (key)", "summaries"))
def merge_ranked(spark, d):
    """The summaries that score well, and those that score well the other way round."""
    s = P.summaries(spark, d).where("quality_score is not null and content is not null")
    q = F.col("quality_score")
    return C.merge_ranked(s.where(q >= 0.3).select("id", "content", q.alias("relevance")), s.where(1 - q >= 0.3).select("id", "content", (1 - q).alias("relevance")))


@query(sql("SELECT node AS path, round(coalesce(0.3 / depth, 0) + 0.2 * least(1.0, coalesce(cc / 10, 0)) + CASE WHEN depth IS NOT NULL AND cc IS NOT NULL THEN 0.05 ELSE 0 END, 6)::DOUBLE AS score, concat_ws('+', CASE WHEN depth IS NOT NULL THEN 'dependency' END, CASE WHEN cc IS NOT NULL THEN 'co-change' END) AS relationship FROM (SELECT 'f' || dst AS node, 1 AS depth FROM edges30 WHERE src = 7 AND dst IS NOT NULL GROUP BY 1) FULL JOIN (SELECT 'f' || b.l_partkey AS node, count(*) AS cc FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey = 7 AND b.l_partkey <> 7 GROUP BY 1) USING (node) WHERE node <> 'f7' ORDER BY score DESC, path LIMIT 20", "edges30"))
def related_files(spark, d):
    seven = spark.range(7, 8).select(F.col("id").alias("node"))
    near = G.bfs(P.dependencies(spark, d, 30), seven, 1).where("node <> 7").select(F.concat(F.lit("f"), F.col("node").cast("string")).alias("path"), "depth")
    together = H.co_changed(P.commit_files(spark, d), 7, 1_000_000).where("file_path <> 'f7'").select(F.col("file_path").alias("path"), "co_changes")
    none = spark.createDataFrame([], "path string, score double")
    return C.related_files(none, near, together)


_ITEMS = "(SELECT source AS heading, 1 AS priority, doc_id AS ord, text AS content, (doc_id % 10) / 10.0 AS relevance FROM documents)"


def _items(spark, d, heading=None):
    return P.read(spark, d, "documents").select((F.col("source") if heading is None else heading).alias("heading"), F.lit(1).alias("priority"), F.col("doc_id").alias("ord"), F.col("text").alias("content"), (F.col("doc_id") % 10 / 10.0).alias("relevance"))


_SHELF = "source || '/' || lang || '/' || (doc_id // 50)"
_SECTIONS = f"SELECT heading, priority, string_agg(content, chr(10) || chr(10) ORDER BY relevance DESC, ord) AS content FROM {_ITEMS} WHERE content <> '' GROUP BY 1, 2"


@query(f"SELECT heading, priority, content, CAST(ceil(length(content) / 4) AS BIGINT) AS tokens FROM ({_SECTIONS.replace('source AS heading', _SHELF + ' AS heading')})")
def build_sections(spark, d):
    """Whole texts of a source, a language and fifty ids make a section."""
    shelf = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 50).cast("string"))
    return C.build_sections(_items(spark, d, shelf))


@query(f"SELECT heading, priority, CASE WHEN tokens <= 9000 - before THEN content ELSE substr(content, 1, CAST((9000 - before) * 4 AS INT)) || chr(10) || chr(10) || '*(truncated)*' END AS content, CAST(least(tokens, 9000 - before) AS BIGINT) AS tokens, tokens > 9000 - before AS truncated FROM (SELECT *, coalesce(sum(tokens) OVER (ORDER BY priority, heading ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, CAST(ceil(length(content) / 4) AS BIGINT) AS tokens FROM ({_SECTIONS}))) WHERE before < 9000")
def token_budget(spark, d):
    return C.truncate(C.build_sections(_items(spark, d), 9000), 9000)


@query("SELECT doc_id, CASE WHEN length(text) <= 150 THEN text WHEN instr(substr(text, 1, 150), '.') > 0 AND length(substr(text, 1, 150)) - instr(reverse(substr(text, 1, 150)), '.') + 1 > 75 THEN substr(text, 1, length(substr(text, 1, 150)) - instr(reverse(substr(text, 1, 150)), '.') + 1) ELSE substr(text, 1, 150) || '...' END AS cut FROM documents")
def sentence_cut(spark, d):
    return P.read(spark, d, "documents").select("doc_id", C.sentence_cut(F.col("text"), 150).alias("cut"))


# --- text

@query("SELECT o_orderkey AS id, 'ABC-' || o_custkey AS tickets, CAST(o_orderkey AS VARCHAR) AS issues FROM orders")
def commit_metadata(spark, d):
    o = P.read(spark, d, "orders")
    msg = F.concat(F.lit("Fix #"), F.col("o_orderkey").cast("string"), F.lit(" ABC-"), F.col("o_custkey").cast("string"), F.lit(" again #"), F.col("o_orderkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(T.commit_tickets(msg), ",").alias("tickets"), F.array_join(T.commit_issues(msg).cast("array<string>"), ",").alias("issues"))


@query("SELECT doc_id AS doc, CAST(0 AS BIGINT) AS section, 'Doc ' || doc_id AS heading, CAST(2 AS BIGINT) AS level, trim(replace(lang, chr(10), ' ')) AS content FROM documents UNION ALL SELECT doc_id, 1, 'Source', 3, source FROM documents")
def markdown_sections(spark, d):
    doc = P.read(spark, d, "documents")
    md = F.concat(F.lit("lost\n## Doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("lang"), F.lit("\n### Source\n"), F.col("source"))
    return T.markdown_sections(doc.select(F.col("doc_id").alias("doc"), md.alias("text")))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(coalesce(role, ''), ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def chat_history(spark, d):
    c = P.read(spark, d, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(turns, lambda t: F.coalesce(t["role"], F.lit(""))), ",").alias("roles"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'))[1:50] AS slug FROM pages")
def url_slugs(spark, d):
    return P.read(spark, d, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_counts(spark, d):
    return P.read(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- resolution, extraction, streams

@query(sql("SELECT a.path AS source_file, './' || b.stem AS specifier, b.path AS target_file FROM files a JOIN (SELECT id, path, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem FROM files) b ON a.id = b.id WHERE regexp_matches(a.path, '\\.(ts|tsx|js)$')", "files"))
def import_resolution(spark, d):
    """Each script imports itself without its extension, which the candidate probing has to find."""
    f = P.files(spark, d)
    own = f.where(F.col("path").rlike(r"\.(ts|tsx|js)$"))
    i = own.select(F.col("path").alias("source_file"), F.concat(F.lit("./"), F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1)).alias("specifier"))
    return R.resolve_imports(i, f).select("source_file", "specifier", "target_file")


@query(sql(f"SELECT kind, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY distance, vec_id) AS k FROM (SELECT e.vec_id, round(1 - {_COS}, 6) AS distance, CASE WHEN s.level IN ('de', 'fr') THEN 'module' ELSE 'code' END AS kind FROM (SELECT e.vec_id, e.embedding FROM embeddings e) e JOIN summaries s ON s.id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, e.vec_id LIMIT 40)) WHERE k <= CASE WHEN kind = 'module' THEN 5 ELSE 10 END", "summaries"))
def search_split(spark, d):
    s = P.summaries(spark, d).select("id", F.when(F.col("level").isin("de", "fr"), "module").otherwise("function").alias("level"))
    both = P.read(spark, d, "embeddings").join(s, F.col("vec_id") == F.col("id"), "left_semi")
    found = V.topk(both, _query_vector(spark, d), 40).join(s, F.col("vec_id") == F.col("id"))
    return V.search_split(found, 10, 5).select("kind", "vec_id", "distance")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_stream_counts(spark, d):
    return S.counts(P.read(spark, d, "events"))


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def job_state_stream(spark, d):
    e = P.read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("status"))
    return S.job_states(e).select("job_id", "status")


@query("SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS sha, count(*) AS n_files, CAST(sum(l_quantity) AS BIGINT) AS lines_added FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def gitlog_parse(spark, d):
    """A log dumped from commits and their files, parsed back."""
    cf = P.commit_files(spark, d)
    stat = cf.groupBy("commit_id").agg(F.array_join(F.collect_list(F.concat(F.col("lines_added").cast("int").cast("string"), F.lit("\t-\t"), "file_path")), "\n").alias("stat"))
    c = P.commits(spark, d).join(stat, F.col("id") == F.col("commit_id"))
    sep = F.lit(L.FIELD)
    log = F.concat(F.lit(L.COMMIT), "sha", sep, F.lit("a"), sep, F.lit("a@b"), sep, F.date_format("committed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), sep, "message", sep, F.lit("\n\n"), "stat")
    parsed = L.parse(c.select(log.alias("value")))
    return parsed.select("sha", F.size("files").cast("long").alias("n_files"), F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + f["lines_added"]).alias("lines_added"))


@query("SELECT doc_id AS path, CAST(1 AS INT) AS n_comments, 'note ' || doc_id AS header FROM documents")
def comments(spark, d):
    doc = P.read(spark, d, "documents")
    content = F.concat(F.lit("// note "), F.col("doc_id").cast("string"), F.lit("\nexport function f() {}\n"))
    rows = K.extract(doc.select(F.col("doc_id").cast("string").alias("path"), content.alias("content"), F.lit("typescript").alias("language")), "comments")
    return rows.groupBy(F.col("path").cast("long").alias("path")).agg(F.count("*").cast("int").alias("n_comments"), F.min_by("text", "start_line").alias("header"))


@query("SELECT doc_id AS path, 'f' || doc_id AS name, CAST(2 AS INT) AS complexity FROM documents")
def symbols_and_complexity(spark, d):
    doc = P.read(spark, d, "documents")
    content = F.concat(F.lit("export function f"), F.col("doc_id").cast("string"), F.lit("(x) {\n if (x) { return 1; }\n}\n"))
    src = doc.select(F.col("doc_id").cast("string").alias("path"), content.alias("content"), F.lit("typescript").alias("language"))
    return K.extract(src, "symbols").join(K.extract(src, "complexity"), "path").select(F.col("path").cast("long").alias("path"), "name", "complexity")


#: A source of each language around a document's text; {t} is the text as comment lines, {f} the id, {m} a number of lines that only look like code.
_SOURCES = (
    ("typescript", """/*\n{t}\n*/\nimport {{ a }} from "./{f}";\nexport function f{f}(x: {{ y: string }}): void {{\n  const inner{f} = (q) => {{\n    return `}} ${{q ? "{{" : 1}}`;\n  }};\n}}\n{m}class C{f} extends B {{ m() {{ if (/[{{/]/.test(a) && b) {{}} }} }}\n""", "const s = \"class X {\"; // enum Y {\n"),
    ("python", "# {t}\nimport os, sys\n@wrap\ndef g{f}(a, b=')'):\n    def _h{f}(): pass\n    return a if b and a else 1\n{m}class P{f}(B):\n    pass\n", "x = 'def no():' # class no\n"),
    ("c_sharp", "/*\n{t}\n*/\nusing System.Text;\nnamespace N {{\npublic class K{f} : B {{\n{m}    public int Go{f}(string s) {{\n        switch (s) {{ case \"}}\": case \"b\": return 1; default: return s == null ? 2 : 3; }}\n    }}\n}}\n}}\n", "    string v = @\"\"\"class X {\";\n"),
)
_SOURCE_ROWS = """WITH d AS (SELECT doc_id AS id, doc_id % 3 AS l, doc_id % 5 AS m, length(text) - length(replace(text, chr(10), '')) AS n FROM documents WHERE text IS NOT NULL),
r AS (
  SELECT id, 'import' AS kind, './' || id AS name, n + 4 AS a, n + 4 AS b, false AS exported, 'import { a } from "./' || id || '";' AS signature, 4 AS complexity FROM d WHERE l = 0
  UNION ALL SELECT id, 'function', 'f' || id, n + 5, n + 9, true, 'function f' || id || '(x: { y: string }): : void', 4 FROM d WHERE l = 0
  UNION ALL SELECT id, 'function', 'inner' || id, n + 6, n + 8, false, 'const inner' || id || ' = (q) => ...', 4 FROM d WHERE l = 0
  UNION ALL SELECT id, 'class', 'C' || id, n + 10 + m, n + 10 + m, false, 'class C' || id || ' extends B', 4 FROM d WHERE l = 0
  UNION ALL SELECT id, 'import', 'import os, sys', n + 2, n + 2, false, 'import os, sys', 3 FROM d WHERE l = 1
  UNION ALL SELECT id, 'function', 'g' || id, n + 4, n + 6, true, 'def g' || id || '(a, b='')'')', 3 FROM d WHERE l = 1
  UNION ALL SELECT id, 'function', '_h' || id, n + 5, n + 5, false, 'def _h' || id || '()', 3 FROM d WHERE l = 1
  UNION ALL SELECT id, 'class', 'P' || id, n + 7 + m, n + 8 + m, true, 'class P' || id || '(B)', 3 FROM d WHERE l = 1
  UNION ALL SELECT id, 'import', 'System.Text', n + 4, n + 4, false, 'using System.Text;', 4 FROM d WHERE l = 2
  UNION ALL SELECT id, 'class', 'K' || id, n + 6, n + 10 + m, true, 'class K' || id, 4 FROM d WHERE l = 2
  UNION ALL SELECT id, 'function', 'Go' || id, n + 7 + m, n + 9 + m, true, 'int Go' || id || '(string s)', 4 FROM d WHERE l = 2
) SELECT id, kind, name, a::INT AS start_line, b::INT AS end_line, exported, signature, complexity::INT AS complexity FROM r"""


@query(_SOURCE_ROWS)
def source_symbols(spark, d):
    """Declarations and complexity of a source of many lines around every document's text, in three languages (K1-K4, K7)."""
    doc = P.read(spark, d, "documents").where("text is not null")
    said = F.replace(F.regexp_replace("text", r"[^\x20-\x7e\n]", " "), F.lit("*/"), F.lit("* "))
    content, language = F.lit(""), F.lit("")
    for i, (name, body, filler) in enumerate(_SOURCES):
        parts = body.replace("{{", "\x01").replace("}}", "\x02")
        values = {"t": F.replace(said, F.lit("\n"), F.lit("\n# ")) if name == "python" else said, "f": F.col("doc_id").cast("string"), "m": F.repeat(F.lit(filler), (F.col("doc_id") % 5).cast("int"))}
        bits = [values[x[1]] if x in ("{t}", "{f}", "{m}") else F.lit(x.replace("\x01", "{").replace("\x02", "}")) for x in re.split(r"(\{[tfm]\})", parts)]
        mine = F.col("doc_id") % 3 == i
        content, language = F.when(mine, F.concat(*bits)).otherwise(content), F.when(mine, F.lit(name)).otherwise(language)
    src = doc.select(F.col("doc_id").cast("string").alias("path"), content.alias("content"), language.alias("language"))
    found = K.extract(src, "symbols").join(K.extract(src, "complexity"), "path")
    return found.select(F.col("path").cast("long").alias("id"), "kind", "name", "start_line", "end_line", "exported", "signature", "complexity")


# --- composed contexts

_CUT = "SELECT heading, CAST(priority AS INT) AS priority, CASE WHEN tokens <= {b} - before THEN content ELSE substr(content, 1, CAST(({b} - before) * 4 AS BIGINT)) || chr(10) || chr(10) || '*(truncated)*' END AS content, CAST(least(tokens, {b} - before) AS BIGINT) AS tokens, tokens > {b} - before AS truncated FROM (SELECT *, coalesce(sum(tokens) OVER (ORDER BY priority, heading ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT heading, priority, content, ceil(length(content) / 4.0) AS tokens FROM (SELECT heading, priority, string_agg(content, chr(10) || chr(10) ORDER BY relevance DESC, ord, content) AS content FROM items GROUP BY ALL))) WHERE before < {b}"
_TOGETHER = "SELECT b.file_path, count(*) AS co_changes FROM (SELECT *, row_number() OVER () AS rid FROM commit_files) a JOIN (SELECT *, row_number() OVER () AS rid FROM commit_files) b ON a.commit_id = b.commit_id AND a.rid <> b.rid WHERE a.file_id = 7 GROUP BY 1 ORDER BY co_changes DESC, b.file_path"
_LINES = "SELECT 'Recent Commits' AS heading, 1 AS priority, -epoch_us(committed_at) AS ord, '`' || substr(sha, 1, 7) || '` ' || message || coalesce(' — ' || author_name, '') || ' (' || strftime(committed_at, '%Y-%m-%d') || ')' AS content, 0.7 AS relevance FROM scope UNION ALL SELECT 'Author Distribution', 4, -count(*), coalesce(author_name, 'unknown') || ': ' || count(*) || ' commits', 0.4 FROM scope GROUP BY author_name"


@query(sql(f", scope AS (SELECT * FROM commits WHERE committed_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'), items AS ({_LINES}) {_CUT.format(b=900)}", "commits"))
def change_context_range(spark, d):
    return A.change_context(P.commits(spark, d), P.commit_files(spark, d), 900, since="1996-01-01", until="1996-03-31")


@query(sql(f", scope AS (SELECT * FROM commits WHERE id IN (SELECT commit_id FROM commit_files WHERE file_id = 7) ORDER BY committed_at DESC, id DESC LIMIT 20), times AS (SELECT count(*) AS n FROM commit_files WHERE file_id = 7), items AS ({_LINES} UNION ALL SELECT 'Change Frequency', 2, 0, 'Changed ' || n || ' times' || CASE WHEN n > 10 THEN ' (**hotspot** — consider refactoring)' ELSE '' END, CASE WHEN n > 10 THEN 0.9 ELSE 0.5 END FROM times WHERE n > 0 UNION ALL SELECT 'Co-Change Patterns', 3, -co_changes, '**' || file_path || '** — changed together ' || co_changes || ' times', least(1.0, co_changes / 10.0) FROM ({_TOGETHER} LIMIT 8)) {_CUT.format(b=4000)}", "commits", "commit_files"))
def change_context_file(spark, d):
    return A.change_context(P.commits(spark, d), P.commit_files(spark, d), file_id=7)


@query("""WITH d AS (SELECT doc_id AS doc, '## Doc ' || doc_id || chr(10) || replace(coalesce(text, ''), chr(10), ' ') AS body, '### Source' || chr(10) || source AS tail, 'Doc ' || doc_id AS head FROM documents)
SELECT doc, CAST(0 AS BIGINT) AS chunk, 'Introduction' AS heading, 'Introduction' AS heading_path, 'intro' AS content FROM d
UNION ALL SELECT doc, 1, head, head, CASE WHEN length(body) > 12000 THEN body ELSE body || chr(10) || tail END FROM d
UNION ALL SELECT doc, 2, 'Source', head || ' > Source', tail FROM d WHERE length(body) > 12000""")
def document_chunks(spark, d):
    doc = P.read(spark, d, "documents")
    md = F.concat(F.lit("intro\n## Doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\n### Source\n"), F.col("source"))
    return T.document_chunks(doc.select(F.col("doc_id").alias("doc"), md.alias("text")))


from codestrata.plans import layers  # noqa: E402, F401  registers the queries of the documentation, semantic and context layers
