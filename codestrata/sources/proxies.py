"""The engine's tables as views over the driver's tables, with the same definitions as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAYERS = ("db", "domain", "service", "api", "ui", "misc")
EXTENSIONS = ("ts", "tsx", "js", "py", "md")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def commits(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", "c_name").hint("merge")  # a file of a few MB may hold a million names
    o = read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select(F.col("o_orderkey").alias("id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha"), F.col("c_name").alias("author_name"), F.col("o_orderdate").alias("committed_at"), F.col("o_orderpriority").alias("message"))


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("file_id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file_path"), F.col("l_returnflag").alias("change_type"), F.col("l_quantity").alias("lines_added"))


def files(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    path = F.concat(F.lit("src/"), _pick(LAYERS, F.pmod(key, F.lit(6))), F.lit("/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), key.cast("string"), F.lit("."), _pick(EXTENSIONS, F.pmod(F.col("p_size"), F.lit(5))))
    return read(spark, d, "part").select(key.alias("id"), path.alias("path"), F.col("p_size").cast("long").alias("line_count"), F.col("p_retailprice").alias("complexity"))


def dependencies(spark: SparkSession, d: str, least: float) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    return li.select("l_quantity", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where(F.col("l_quantity") >= least).select("src", "dst")


def summaries(spark: SparkSession, d: str) -> DataFrame:
    lab = read(spark, d, "labels").select("doc_id", "toxic")
    s = read(spark, d, "documents").join(lab, "doc_id", "left")
    scored = F.when(F.col("toxic").isNotNull(), F.pmod(F.col("doc_id") * 37, F.lit(101)) / F.lit(100.0))
    return s.select(F.col("doc_id").alias("id"), F.col("lang").alias("level"), F.concat(F.lit("file:"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("target_id"), F.col("text").alias("content"), scored.alias("quality_score"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("demoted"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("name_id")).agg((F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)) == 1).alias("exported")).select("file_id", F.concat(F.lit("s"), F.col("name_id").cast("string")).alias("name"), "exported")


def runs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), F.col("event_type").alias("layer"), F.col("ts").alias("created_at"), F.col("value").alias("cost_usd"), "props")


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Within-region trade edges (src, dst) between nations above the 60th revenue percentile."""
    n = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a"))
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("b"))
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    paid = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    rev = paid.groupBy("a", "b").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("rev"))
    na, nb = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("rb"))
    near = rev.join(na, "a").join(nb, "b").where("ra = rb and a <> b")  # at most nations squared rows: one window partition
    return near.withColumn("pr", F.percent_rank().over(W.orderBy("rev", "a", "b"))).where("pr >= 0.6").select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"))


_TIES = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"


def edges_sql(least: int) -> str:
    return f"(SELECT src, dst FROM (SELECT l_quantity, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_TIES}) AS dst FROM lineitem) WHERE l_quantity >= {least})"


SQL = {
    "commits": "(SELECT o_orderkey AS id, sha256(CAST(o_orderkey AS VARCHAR)) AS sha, c_name AS author_name, o_orderdate AS committed_at, o_orderpriority AS message FROM orders LEFT JOIN customer ON o_custkey = c_custkey)",
    "commit_files": "(SELECT l_orderkey AS commit_id, l_linenumber AS line, l_partkey AS file_id, 'f' || l_partkey AS file_path, l_returnflag AS change_type, l_quantity AS lines_added FROM lineitem)",
    "files": "(SELECT p_partkey AS id, 'src/' || (['db','domain','service','api','ui','misc'])[(p_partkey % 6) + 1] || '/' || lower(replace(p_type, ' ', '_')) || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.' || (['ts','tsx','js','py','md'])[(p_size % 5) + 1] AS path, CAST(p_size AS BIGINT) AS line_count, p_retailprice AS complexity FROM part)",
    "summaries": "(SELECT d.doc_id AS id, lang AS level, 'file:' || source || '/' || d.doc_id AS target_id, text AS content, CASE WHEN toxic IS NOT NULL THEN ((d.doc_id * 37) % 101) / 100.0 END::DOUBLE AS quality_score, coalesce(toxic = 1, false) AS demoted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
    "symbols": "(SELECT l_partkey AS file_id, 's' || l_suppkey AS name, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 AS exported FROM lineitem GROUP BY l_partkey, l_suppkey)",
    "runs": "(SELECT event_id AS id, user_id AS project_id, event_type AS layer, ts AS created_at, value AS cost_usd, props FROM events)",
    "trade": "(SELECT src, dst FROM (SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst, percent_rank() OVER (ORDER BY rev, a, b) AS pr FROM (SELECT s_nationkey AS a, c_nationkey AS b, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) JOIN nation na ON a = na.n_nationkey JOIN nation nb ON b = nb.n_nationkey WHERE na.n_regionkey = nb.n_regionkey AND a <> b) WHERE pr >= 0.6)",
}


def with_tables(sql: str, *names: str) -> str:
    """``sql`` behind common table expressions for the named views; ``edges30`` and the like set the cut."""
    parts = [f"{n} AS {edges_sql(int(n[5:])) if n.startswith('edges') else SQL[n]}" for n in names]
    return f"WITH RECURSIVE {', '.join(parts)} {sql}"
