"""Change-history analytics over commits and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hotspots(commit_files: DataFrame, k: int = 15) -> DataFrame:
    """Most often changed files."""
    return commit_files.where("file_id is not null").groupBy("file_path", "file_id").agg(F.count("*").alias("changes")).orderBy(F.desc("changes"), "file_path").limit(k)


def co_changed(commit_files: DataFrame, file_id, k: int = 10) -> DataFrame:
    """Files changed in the same commits as one file (D5, E5): the file's commits filter the other side first."""
    key = ["commit_id", "line", "file_id", "file_path", "lines_added"]
    cf = commit_files.select(*key)
    mine = cf.where(F.col("file_id") == file_id).select("commit_id").groupBy("commit_id").agg(F.count("*").alias("n"))
    # a row meets each of the file's rows in its commit but itself
    met = cf.join(mine, "commit_id").withColumn("times", F.col("n") - F.when(F.col("file_id") == file_id, 1).otherwise(0))
    return met.groupBy("file_path").agg(F.sum("times").alias("co_changes")).where("co_changes > 0").orderBy(F.desc("co_changes"), "file_path").limit(k)


def recent_commits(commits: DataFrame, k: int = 20) -> DataFrame:
    """Newest commits (L1)."""
    return commits.select("id", "sha", "author_name", "committed_at").orderBy(F.desc("committed_at"), F.desc("id")).limit(k)


def commits_in_range(commits: DataFrame, since: str, until: str) -> DataFrame:
    """Commits between two times, both included (C4)."""
    return commits.where(F.col("committed_at").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz"))).select("id", "sha", "committed_at")


def file_commits(commit_files: DataFrame, commits: DataFrame, file_id, k: int = 10) -> DataFrame:
    """Commits of one file, newest first, a row for each of its change rows."""
    touched = commit_files.where(F.col("file_id") == file_id).select("commit_id", "line", "change_type")
    return touched.join(commits, F.col("commit_id") == F.col("id")).select("sha", "committed_at", "line", "change_type").orderBy(F.desc("committed_at"), "sha", "line", "change_type").limit(k)


def commits_with_files(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Each commit with its file paths, sorted."""
    grouped = commit_files.groupBy("commit_id").agg(F.array_join(F.array_sort(F.collect_list("file_path")), ",").alias("paths"), F.count("*").alias("n_files"))
    return commits.join(grouped, F.col("id") == F.col("commit_id"), "left").select("id", "sha", F.coalesce("paths", F.lit("")).alias("paths"), F.coalesce("n_files", F.lit(0).cast("long")).alias("n_files"))


def author_distribution(commits: DataFrame) -> DataFrame:
    """Commits by author, null as unknown."""
    return commits.groupBy(F.coalesce("author_name", F.lit("unknown")).alias("author")).agg(F.count("*").alias("commits"))


def change_summary(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Commits, distinct paths and authors of a period."""
    both = commits.select(F.col("id").alias("c"), "author_name").join(commit_files.select("commit_id", "file_path"), F.col("c") == F.col("commit_id"), "left")
    return both.agg(F.count_distinct("c").alias("n_commits"), F.count_distinct("file_path").alias("n_paths"), F.count_distinct("author_name").alias("n_authors"))


def co_change_clusters(commit_files: DataFrame, path: str = "file_path", smallest: int = 2, largest: int = 10, support: int = 2) -> DataFrame:
    """Sets of files that change together in several commits."""
    sets = commit_files.select("commit_id", path).distinct().groupBy("commit_id").agg(F.array_sort(F.collect_set(path)).alias("s"))
    sets = sets.where(F.size("s").between(smallest, largest)).select(F.array_join("s", "|").alias("cluster"))
    return sets.groupBy("cluster").agg(F.count("*").alias("support")).where(F.col("support") >= support)


def change_frequency(files: DataFrame, commit_files: DataFrame, commits: DataFrame) -> DataFrame:
    """Change count and last change of every file, from all commits."""
    seen = commit_files.join(commits.select("id", "committed_at"), F.col("commit_id") == F.col("id")).groupBy("file_id").agg(F.count("*").alias("n"), F.max("committed_at").alias("last_changed_at"))
    return files.select(F.col("id").alias("fid"), "path").join(seen, F.col("fid") == F.col("file_id"), "left").select(F.col("fid").alias("id"), "path", F.coalesce("n", F.lit(0).cast("long")).alias("change_frequency"), "last_changed_at")
