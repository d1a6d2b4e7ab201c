"""Change capture, staleness and queues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changed_files(disk: DataFrame, known: DataFrame) -> DataFrame:
    """Paths that are new or whose hash differs (H1)."""
    k = known.select("path", F.col("content_hash").alias("__old"))
    return disk.join(k, "path", "left").where(~F.col("content_hash").eqNullSafe(F.col("__old"))).select("path", F.when(F.col("__old").isNull(), "added").otherwise("changed").alias("change"))


def deleted_files(disk: DataFrame, known: DataFrame) -> DataFrame:
    """Known paths that are not on disk."""
    return known.join(disk.select("path"), "path", "left_anti").select("path")


def files_to_index(disk: DataFrame, known: DataFrame, diff: DataFrame | None = None, full: bool = False) -> DataFrame:
    """All files, the files of a diff, or those whose hash changed, in this order of preference (H2)."""
    if full:
        return disk.select("path")
    if diff is not None and not diff.isEmpty():
        return disk.join(diff.select("path").distinct(), "path", "left_semi").select("path")
    return changed_files(disk, known).select("path")


def drop_deleted(children: DataFrame, deleted: DataFrame, path: str = "file_path") -> DataFrame:
    """Children of deleted files go (H3)."""
    return children.join(deleted.select(F.col("path").alias(path)), path, "left_anti")


def unseen_inputs(prompts: DataFrame, known: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """Prompts whose hash was not answered yet; hashes of stale files don't count (H4, H5)."""
    k = known if stale is None else known.join(stale.select("file_path"), "file_path", "left_anti")
    return prompts.withColumn("input_hash", F.sha2("prompt", 256)).join(k.select("input_hash"), "input_hash", "left_anti")


def edit_ratio(a: Column, b: Column, samples: int = 50) -> Column:
    """Length difference plus mismatches at sampled positions, at most 1 (H7)."""
    la, lb = F.char_length(a), F.char_length(b)
    most, least = F.greatest(la, lb), F.least(la, lb)
    step = F.greatest(F.floor(least / samples), F.lit(1))
    spots = F.when(least > 0, F.sequence(F.lit(0).cast("long"), least.cast("long") - 1, step.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    miss = F.aggregate(spots, F.lit(0), lambda s, p: s + F.when(F.substring(a, (p + 1).cast("int"), F.lit(1)) == F.substring(b, (p + 1).cast("int"), F.lit(1)), 0).otherwise(1))
    rate = F.when(F.size(spots) > 0, miss / F.greatest(F.size(spots), F.lit(1))).otherwise(F.lit(0.0))
    return F.when(most == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (most - least) / F.greatest(most, F.lit(1)) + rate))


def summary_delta(old: DataFrame, new: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Share of summaries that are new or changed beyond the threshold; 1 for none (H6)."""
    o = old.select("target_id", F.col("content").alias("__old"), F.col("input_hash").alias("__h"))
    j = new.join(o, "target_id", "left")
    moved = F.col("__old").isNull() | (~F.col("input_hash").eqNullSafe(F.col("__h")) & (edit_ratio(F.col("content"), F.col("__old")) > threshold))
    return j.agg(F.count("*").alias("total"), F.sum(F.when(moved, 1).otherwise(0)).alias("changed")).select("total", F.coalesce("changed", F.lit(0).cast("long")).alias("changed"), F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("changed") / F.greatest("total", F.lit(1)), 6)).alias("delta"))


def dirname(path: Column) -> Column:
    """Directory of a path, null at the root."""
    return F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit(""))


def dirty_modules(dirty: DataFrame) -> DataFrame:
    """Modules above dirty files, and the system if there is any (F8)."""
    m = dirty.select(dirname(F.col("path")).alias("m")).where("m is not null").distinct().select(F.lit("module").alias("level"), F.concat(F.lit("module:"), "m").alias("target_id"))
    return m.union(dirty.limit(1).select(F.lit("system").alias("level"), F.lit("system:project").alias("target_id")))


#: Items of a piece that one task folds.
PIECE = 4096


def batches(items: DataFrame, group: str, largest: int = 10, chars: int = 16000) -> DataFrame:
    """Greedy batches of (group, ord, id, size): at most ``largest`` items and ``chars`` characters (H8).

    A batch begins where the one before ends, so the fold is sequential; but after the first break in a piece of
    ``PIECE`` items the rest depends on where that break is, and it is among the first ``largest`` items, or the one after
    them where a group begins.  Each piece tells for every such place how many batches follow and what is left open; these are chained over a
    group's pieces, and then all pieces are folded at once.  Equal ``ord`` are ordered by id.  Gives (group, ord, id, size, batch).
    """
    from codestrata.operators.graph import _cut

    kind = dict(items.dtypes)
    keys = [F.col(group), F.col("ord"), F.col("id")]
    rows = items.select(group, "ord", "id", F.col("size").cast("long").alias("size"))
    # written once, as places depend on how the rows were dealt
    rows = _cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    pieces = rows.groupBy(group, F.floor(F.col("at") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("at", "ord", "id", "size"))).alias("items"))

    def fold(sizes, count: int = 0, total: int = 0, no: int = 0) -> tuple[list[int], int, int, int]:
        out = []
        for size in sizes:
            if count and (count >= largest or total + size > chars):
                no, count, total = no + 1, 0, 0
            count, total = count + 1, total + int(size)
            out.append(no)
        return out, count, total, no

    @F.pandas_udf("array<array<long>>")
    def told(sizes: pd.Series) -> pd.Series:
        return pd.Series([[list(map(int, s[: largest + 1]))] + [list(fold(s[p:])[1:]) for p in range(min(largest + 1, len(s)))] for s in sizes], dtype=object)

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        out, no, count, total = [], 0, 0, 0
        for piece, facts in sorted(zip(g["piece"], g["told"], strict=True)):
            out.append((g[group].iloc[0], piece, no, count, total))
            first, *after = facts
            for p, size in enumerate(first):
                if count and (count >= largest or total + size > chars):
                    count, total, more = (int(x) for x in after[p])
                    no += 1 + more
                    break
                count, total = count + 1, total + int(size)
        return pd.DataFrame(out, columns=[group, "piece", "no", "count", "total"])

    @F.pandas_udf("array<long>")
    def numbered(sizes: pd.Series, count: pd.Series, total: pd.Series, no: pd.Series) -> pd.Series:
        return pd.Series([fold(*x)[0] for x in zip(sizes, count, total, no, strict=True)], dtype=object)

    facts = pieces.select(group, "piece", told(F.col("items.size")).alias("told"))
    carried = facts.groupBy(group).applyInPandas(chain, f"{group} {kind[group]}, piece long, no long, count long, total long").withColumnRenamed(group, "__g").withColumnRenamed("piece", "__p")
    both = pieces.join(carried, F.col(group).eqNullSafe(F.col("__g")) & (F.col("piece") == F.col("__p")))
    each = both.select(group, F.explode(F.arrays_zip("items", numbered(F.col("items.size"), F.col("count"), F.col("total"), F.col("no")).alias("batch"))).alias("x"))
    return each.select(group, F.col("x.items.ord").alias("ord"), F.col("x.items.id").alias("id"), F.col("x.items.size").alias("size"), F.col("x.batch").alias("batch"))


def claim_next(jobs: DataFrame, k: int = 1) -> DataFrame:
    """The oldest pending jobs; the caller is the only writer."""
    return jobs.where("status = 'pending'").orderBy("created_at", "id").limit(k)


def drain_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Oldest request of each project without an active job."""
    active = jobs.where(F.col("status").isin("pending", "running")).select("project_id").distinct()
    free = requests.join(active, "project_id", "left_anti")
    return free.groupBy("project_id").agg(F.min("requested_at").alias("requested_at"))


def job_states(events: DataFrame) -> DataFrame:
    """Folds job events (job_id, seq, status) to the latest state."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def running_total(df: DataFrame, order: str, amount: str, into: str, ranges: int = 200) -> DataFrame:
    """Adds the sum of ``amount`` over all rows before, in the order of a number.

    Rows are cut into ranges at quantiles; sums within ranges and over the totals of at most ``ranges``
    of them together give the total, so no task holds all rows.
    """
    shares = ",".join(repr(i / ranges) for i in range(1, ranges))
    cuts = sorted(set(df.agg(F.expr(f"percentile_approx({order}, array({shares}), {10 * ranges})")).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    dealt = df.withColumn("__part", part)
    before = W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("__part").agg(F.sum(amount).alias("__t")).withColumn("__t", F.coalesce(F.sum("__t").over(before), F.lit(0.0)))
    within = W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum(amount).over(within), F.lit(0.0))
    return dealt.join(F.broadcast(totals), "__part").withColumn(into, own + F.col("__t")).drop("__part", "__t")


def rollup_levels(files: DataFrame, previous: DataFrame, render) -> DataFrame:
    """Summaries of files, modules and the system, hash-equal ones reused (H9).

    ``files`` is (path, content) of file summaries, ``previous`` (level, target_id, input_hash, content) of the
    last run, ``render`` makes a summary from a column of input text.  A module's input is its files'
    lines, the system's the modules', each in the order of targets.  Returns (level, target_id, input_hash,
    content, reused); modules may be many, and only the system is one row.
    """
    def level(items: DataFrame, name: str, target: Column) -> DataFrame:
        line = F.concat(F.lit("- "), "target", F.lit(": "), "content")
        lines = F.array_join(F.array_sort(F.collect_list(F.struct("target", line.alias("line"))))["line"], "\n")
        told = items.groupBy(target.alias("target_id")).agg(lines.alias("input")).withColumn("input_hash", F.sha2("input", 256))
        old = previous.where(F.col("level") == name).select("target_id", "input_hash", F.col("content").alias("old"))
        both = told.join(old, ["target_id", "input_hash"], "left")
        return both.select(F.lit(name).alias("level"), "target_id", "input_hash", F.coalesce("old", render(F.col("input"))).alias("content"), F.col("old").isNotNull().alias("reused"))

    own = files.where("content <> ''").select(F.col("path").alias("target"), "content")
    modules = level(own.where(dirname(F.col("target")).isNotNull()), "module", F.concat(F.lit("module:"), dirname(F.col("target"))))
    system = level(modules.select(F.col("target_id").alias("target"), "content"), "system", F.lit("system:project"))
    return modules.unionByName(system)


def budget_cutoff(items: DataFrame, group: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """Items until the budget is spent; the one that crosses it still runs."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return items.withColumn("spent", F.coalesce(F.sum(F.coalesce(cost, F.lit(0.0))).over(w), F.lit(0.0))).where(F.col("spent") < budget)
