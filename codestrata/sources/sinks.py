"""Where results go: appended tables, documents, tables for a terminal, and feeds of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Appends rows to a Parquet table in a folder that all executors share."""
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def upsert(spark, df: DataFrame, path: str, keys: list[str], ord_col: str, version: str) -> str:
    """Writes the next snapshot of a keyed table beside the last one and returns its folder.

    A reader of the old folder is not disturbed, and a failed write leaves the old snapshot as it is.
    """
    from codestrata.operators.merge import upsert_keep_last

    out = f"{path.rstrip('/')}-{version}"
    upsert_keep_last(spark.read.parquet(path), df, keys, ord_col).write.mode("overwrite").parquet(out)
    return out


# --- plans

def nested_plans(plans: DataFrame, phases: DataFrame, milestones: DataFrame) -> DataFrame:
    """Plans with their phases and those with their milestones, children in their order.

    ``plans`` (id, title, summary, non_goals, acceptance_criteria, risks), ``phases`` (id, plan_id, phase_order,
    title, intent), ``milestones`` (phase_id, milestone_order, title, intent, details, key_files, verification).
    """
    none = F.array().cast("array<string>")
    inner = F.struct("milestone_order", "title", F.coalesce("intent", F.lit("")).alias("intent"), F.coalesce("details", F.lit("")).alias("details"), F.coalesce("key_files", none).alias("key_files"), F.coalesce("verification", F.lit("")).alias("verification"))
    m = milestones.groupBy("phase_id").agg(F.array_sort(F.collect_list(inner)).alias("milestones"))
    p = phases.join(m, F.col("id") == F.col("phase_id"), "left").groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("phase_order", "title", F.coalesce("intent", F.lit("")).alias("intent"), F.coalesce("milestones", F.from_json(F.lit("[]"), dict(m.dtypes)["milestones"])).alias("milestones")))).alias("phases"))
    return plans.join(p, F.col("id") == F.col("plan_id"), "left").drop("plan_id")


def _bullets(head: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"## {head}\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n")))


def _milestone(m: Column, i: Column) -> Column:
    part = lambda c, before="", after="": F.when(c != "", F.concat(F.lit(before), c, F.lit(after + "\n")))
    return F.concat_ws("\n", F.concat(F.lit("## Milestone "), (i + 1).cast("string"), F.lit(": "), m["title"]), part(m["intent"]), part(m["details"]), part(F.array_join(m["key_files"], ", "), "**Key files**: "), part(m["verification"], "**Verification**:\n```bash\n", "\n```"))


def _phase(p: Column, i: Column) -> Column:
    said = F.exists(p["milestones"], lambda m: (m["intent"] != "") | (m["details"] != "") | (F.size(m["key_files"]) > 0) | (m["verification"] != ""))
    brief = F.concat(F.array_join(F.transform(p["milestones"], lambda m, k: F.concat((k + 1).cast("string"), F.lit(". "), m["title"])), "\n"), F.lit("\n"))
    head = F.concat(F.lit("# Phase "), (i + 1).cast("string"), F.lit(": "), p["title"], F.lit("\n**Milestones: "), F.size(p["milestones"]).cast("string"), F.lit("**\n"))
    return F.concat_ws("\n", head, F.when(p["intent"] != "", F.concat(p["intent"], F.lit("\n"))), F.when(said, F.array_join(F.transform(p["milestones"], _milestone), "\n")).otherwise(brief))


def plan_markdown(nested: DataFrame) -> DataFrame:
    """(id, markdown): each nested plan as one document, the overview first."""
    phases = F.coalesce("phases", F.from_json(F.lit("[]"), dict(nested.dtypes)["phases"]))
    risks = F.transform("risks", lambda r: F.concat(F.lit("**["), r["severity"], F.lit("]** "), r["risk"], F.lit(" — *Mitigation: "), r["mitigation"], F.lit("*")))
    overview = F.array_join(F.transform(phases, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". **"), p["title"], F.lit("** — "), F.size(p["milestones"]).cast("string"), F.lit(" milestones"))), "\n")
    master = F.concat_ws(
        "\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("**Phases: "), F.size(phases).cast("string"), F.lit("**\n")), F.concat(F.lit("## Summary\n"), "summary", F.lit("\n")),
        _bullets("Non-Goals", F.col("non_goals")), _bullets("Acceptance Criteria", F.col("acceptance_criteria")), _bullets("Risks", risks), F.concat(F.lit("## Phase Overview\n"), overview, F.lit("\n")),
    )
    return nested.select("id", F.concat_ws("\n---\n\n", master, F.when(F.size(phases) > 0, F.array_join(F.transform(phases, _phase), "\n---\n\n"))).alias("markdown"))


def plan_json(nested: DataFrame) -> DataFrame:
    """(id, json): each nested plan as one JSON text."""
    return nested.select("id", F.to_json(F.struct(*nested.columns)).alias("json"))


# --- terminal and feed

def table_lines(results: DataFrame) -> DataFrame:
    """(rank, line): search results (score, path, symbol, kind, summary) as lines of a text table.

    Ranks follow score and path: rows are dealt by ranges, sorted, and counted on from the rows of the ranges before,
    so no task holds all of them.
    """
    from pyspark.sql import Window as W

    from codestrata.operators.graph import _cut

    pad = lambda c, n: F.rpad(F.coalesce(c, F.lit("?")), F.greatest(F.lit(n), F.char_length(F.coalesce(c, F.lit("?")))), F.lit(" "))
    short = F.when(F.char_length("summary") > 60, F.concat(F.substring("summary", 1, 60), F.lit("..."))).otherwise(F.col("summary"))
    keys = [F.desc("score"), F.asc("path"), F.asc("symbol")]
    dealt = results.select("score", "path", "symbol", "kind", short.alias("summary")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # written once, as places depend on how the rows were dealt
    placed = _cut(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = placed.join(F.broadcast(starts), "part").withColumn("rank", (F.col("start") + F.col("at") - F.shiftleft("part", 33) + 1).cast("int"))
    share = F.format_string("%5.1f%%  ", F.col("score") * 100)
    line = F.concat(F.lit("  "), F.rpad(F.col("rank").cast("string"), 4, " "), share, pad(F.col("kind"), 12), pad(F.col("symbol"), 30), pad(F.col("path"), 40), "summary")
    return ranked.select("rank", line.alias("line"))


def feed(logs: DataFrame, **filters) -> DataFrame:
    """(value): filtered log rows as JSON lines, in batch and in a stream."""
    from codestrata.streaming.events import filter_logs

    return filter_logs(logs, **filters).select(F.to_json(F.struct("level", "component", "message", "task_id", "time")).alias("value"))
