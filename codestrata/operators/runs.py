"""Life of indexing runs and the lookups around projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def run_lifecycle(events: DataFrame) -> DataFrame:
    """One row for each run from its events (run_id, ts, event, done, total, cost, error; event_id orders equal times).

    Events are ``create``, ``progress``, ``complete`` and ``fail``; the last of the ending ones decides, progress
    is the latest told, cost adds up, and the duration runs from creation to the end.
    """
    ends = F.col("event").isin("complete", "fail")
    at = F.struct("ts", *(["event_id"] if "event_id" in events.columns else []))
    g = events.groupBy("run_id").agg(
        F.min(F.when(F.col("event") == "create", F.col("ts"))).alias("started_at"), F.max_by(F.when(ends, F.col("event")), F.when(ends, at)).alias("last"), F.max(F.when(ends, F.col("ts"))).alias("ended_at"),
        F.max_by("done", F.when(F.col("event") == "progress", at)).alias("done"), F.max("total").alias("total"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 4).alias("cost"), F.max_by("error", F.when(F.col("event") == "fail", at)).alias("error"),
    )
    status = F.when(F.col("last") == "complete", "completed").when(F.col("last") == "fail", "failed").otherwise("running")
    seconds = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return g.select("run_id", status.alias("status"), "started_at", (seconds / 1000).cast("long").alias("duration_ms"), "done", "total", "cost", F.when(F.col("last") == "fail", F.col("error")).alias("error"))


def poll(stream: DataFrame, handle, checkpoint: str, every: str | None = "5 seconds"):
    """Hands each batch of a job or request stream to ``handle``; without ``every`` what is there, once."""
    w = stream.writeStream.foreachBatch(lambda batch, _: handle(batch)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


class Cancelled(RuntimeError):
    pass


class Phases:
    """Runs named phases as Spark job groups; a cancelled run stops before its next phase."""

    def __init__(self, spark: SparkSession, run: str, is_cancelled):
        self.spark, self.run, self.is_cancelled = spark, run, is_cancelled

    def phase(self, name: str, work):
        if self.is_cancelled():
            raise Cancelled(f"{self.run} before {name}")
        sc = self.spark.sparkContext
        sc.setJobGroup(f"{self.run}/{name}", name, interruptOnCancel=True)
        try:
            return work()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self, name: str) -> None:
        self.spark.sparkContext.cancelJobGroup(f"{self.run}/{name}")


# --- lookups

def by_key(projects: DataFrame, slug: str) -> DataFrame:
    """Projects by their slug, without regard to case and outer blanks."""
    return projects.where(F.lower(F.trim("slug")) == F.lower(F.trim(F.lit(slug))))


def has_active(jobs: DataFrame) -> DataFrame:
    """(project_id, active): whether a project has a pending or running job."""
    return jobs.groupBy("project_id").agg(F.bool_or(F.col("status").isin("pending", "running")).alias("active"))


# Kinds of symbols and levels of summaries that may be asked for.
KINDS = ("function", "class", "interface", "type", "enum", "variable", "export", "import")
LEVELS = ("function", "file", "module", "system", "intent", "doc")


def of_kind(rows: DataFrame, column: str, asked: str | None, allowed: tuple[str, ...], default: str | None = None) -> DataFrame:
    """Rows of one kind or level; what is not allowed falls back to the default, or to all (C14)."""
    value = asked if asked in allowed else default
    return rows if value is None else rows.where(F.col(column) == value)


def in_focus(rows: DataFrame, path: str, focus: str | None) -> DataFrame:
    """Rows whose path starts with the focus."""
    return rows if not focus else rows.where(F.startswith(path, F.lit(focus)))


def modules_in_focus(modules: DataFrame, focus: str) -> DataFrame:
    """The focused module and those under it."""
    return modules.where((F.col("module") == focus) | F.startswith("module", F.lit(focus.rstrip("/") + "/")))


def selected_files(files: DataFrame, schemas: int = 3, routes: int = 5, types: int = 100, tests: int = 50) -> DataFrame:
    """(part, no, path, text): what a purpose document quotes of (path, content).

    Schema files (first characters), route files (first lines), exported type names and test titles, each
    up to its cap in the order of paths.
    """
    def first(df: DataFrame, part: str, most: int, text: Column) -> DataFrame:
        top = df.orderBy("path", "pos").limit(most) if "pos" in df.columns else df.orderBy("path").limit(most)
        by = ["path", "pos"] if "pos" in df.columns else ["path"]
        return top.withColumn("no", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*by)).cast("long")).select(F.lit(part).alias("part"), "no", "path", text.alias("text"))

    low = F.lower("path")
    listed = lambda df, pattern: df.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("pos", "name"))
    return (
        first(files.where(low.rlike(r"schema|migration|models?\.")), "schema", schemas, F.substring("content", 1, 3000))
        .unionByName(first(files.where(low.rlike(r"route|controller|endpoint|api")), "route", routes, F.array_join(F.slice(F.split("content", "\n"), 1, 50), "\n")))
        .unionByName(first(listed(files, r"export (?:interface|type|enum) (\w+)"), "type", types, F.col("name")))
        .unionByName(first(listed(files.where(low.rlike(r"\.(test|spec)\.")), r"(?:describe|it|test)\(['\"]([^'\"]+)"), "test", tests, F.col("name")))
    )


def most_common(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group; the one met first on ties."""
    n = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    w = W.partitionBy(group).orderBy(F.desc("n"), "__first")
    return n.withColumn("__k", F.row_number().over(w)).where("__k = 1").select(group, value, "n")


def modules_with_summary(modules: DataFrame, summaries: DataFrame) -> DataFrame:
    """Modules with the text of their summary, null without one."""
    s = summaries.select(F.col("target_id").alias("__t"), F.col("content").alias("summary"))
    return modules.join(s, F.concat(F.lit("module:"), "module") == F.col("__t"), "left").drop("__t")
