"""Context documents: signals of one file or one span of history, ordered into sections and cut to a token budget.

A signal is a frame (heading, priority, ord, content, relevance).  Only the rows that a budget can hold are
gathered into a section, so a long history never reaches one task whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators import context as C
from codestrata.operators import history as H
from codestrata.operators import match as M

HOTSPOT = 10
# Section headings with their priorities.
COMMITS, FREQUENCY, TOGETHER, AUTHORS = ("Recent Commits", 1), ("Change Frequency", 2), ("Co-Change Patterns", 3), ("Author Distribution", 4)
SUMMARY, USED_BY, USES, EXPORTS, HISTORY, FINDINGS = ("File & Module Context", 1), ("Blast Radius (imported by)", 2), ("Dependencies (imports)", 3), ("Exported Symbols", 4), ("Change History", 4), ("Findings", 5)

PURPOSE, SYSTEM, MODULES, LINKS, CRITICAL, HOTSPOTS = ("Purpose", 1), ("System Architecture", 1), ("Module Map", 2), ("Inter-Module Dependencies", 3), ("Critical Findings", 3), ("Change Hotspots", 5)

# More section headings with their priorities.
MODULE, IN_MODULE, OUTSIDE, KEY_EXPORTS = ("Module & System Context", 1), ("Files in Module", 2), ("External Dependencies", 3), ("Key Exports", 4)
CHANGES, CHANGED, HOT, AFFECTED, CLUSTERS, BASELINE = ("Change Summary", 1), ("Changed Files with Context", 2), ("Hotspots", 3), ("Findings Affecting Changed Files", 3), ("Co-Change Clusters", 4), ("Architecture Alignment Baseline", 5)
MENTIONED, NEEDED, SHARED, CODE, READING, RADIUS, SCOPED, LATEST = ("Mentioned Files", 1), ("Dependencies of Mentioned Files", 2), ("Shared Dependencies", 2), ("Relevant Code", 2), ("Relevant Documentation", 2), ("Blast Radius", 3), ("Commits for Relevant Files", 3), ("Recent Commits", 4)


def signal(df: DataFrame, section: tuple[str, int], content: Column, relevance: Column | float, order: Column | None = None) -> DataFrame:
    """One signal: ``order`` (a number, ascending) breaks ties of relevance, the content breaks its ties."""
    return df.select(F.lit(section[0]).alias("heading"), F.lit(section[1]).alias("priority"), (F.lit(0) if order is None else order).cast("long").alias("ord"), content.alias("content"), (relevance if isinstance(relevance, Column) else F.lit(relevance)).cast("double").alias("relevance"))


def assemble(signals: list[DataFrame], budget: int) -> DataFrame:
    """Sections (heading, priority, content, tokens, truncated) of all signals within ``budget`` tokens.

    A section takes its first 2 x ``budget`` items: with the blank lines between they overflow any budget, so
    items beyond cannot show.
    """
    best = [s.where("content <> ''").orderBy(F.desc("relevance"), "ord", "content").limit(2 * budget) for s in signals]
    return C.truncate(C.build_sections(reduce(DataFrame.unionByName, best)), budget)


def _commit_line() -> Column:
    return F.concat(F.lit("`"), F.substring("sha", 1, 7), F.lit("` "), F.col("message"), F.coalesce(F.concat(F.lit(" — "), "author_name"), F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.date_format("committed_at", "yyyy-MM-dd"), F.lit(")")), F.lit("")))


def _together(commit_files: DataFrame, file_id, k: int, section: tuple[str, int], before: str, between: str, after: str) -> DataFrame:
    line = F.concat(F.lit(before), "file_path", F.lit(between), F.col("co_changes").cast("string"), F.lit(after))
    return signal(H.co_changed(commit_files, file_id, k), section, line, F.least(F.lit(1.0), F.col("co_changes") / 10), -F.col("co_changes"))


def _frequency(commit_files: DataFrame, file_id, section: tuple[str, int], note: str) -> DataFrame:
    n = commit_files.where(F.col("file_id") == file_id).agg(F.count("*").alias("n")).where("n > 0")
    hot = F.col("n") > HOTSPOT
    return signal(n, section, F.concat(F.lit("Changed "), F.col("n").cast("string"), F.lit(" times"), F.when(hot, F.lit(note)).otherwise(F.lit(""))), F.when(hot, 0.9).otherwise(0.5))


def change_context(commits: DataFrame, commit_files: DataFrame, budget: int = 4000, file_id=None, module: str | None = None, since: str | None = None, until: str | None = None, most: int = 20) -> DataFrame:
    """What changed in a file, between two dates, or lately; ``module`` keeps commits that touch it, after the limit."""
    extra = []
    if file_id is not None:
        scope = commits.join(commit_files.where(F.col("file_id") == file_id), F.col("id") == F.col("commit_id"), "left_semi").orderBy(F.desc("committed_at"), F.desc("id")).limit(most)
        extra = [_together(commit_files, file_id, 8, TOGETHER, "**", "** — changed together ", " times"), _frequency(commit_files, file_id, FREQUENCY, " (**hotspot** — consider refactoring)")]
    elif since and until:
        scope = commits.where(F.col("committed_at").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))
    else:
        scope = commits.orderBy(F.desc("committed_at"), F.desc("id")).limit(most)
    if module is not None:
        inside = commit_files.where(F.startswith("file_path", F.lit(module.rstrip("/") + "/")))
        scope = scope.join(inside, F.col("id") == F.col("commit_id"), "left_semi").orderBy(F.desc("committed_at"), F.desc("id")).limit(most)
    authors = H.author_distribution(scope)
    told = signal(scope, COMMITS, _commit_line(), 0.7, -F.unix_micros(F.col("committed_at").cast("timestamp")))
    who = signal(authors, AUTHORS, F.concat("author", F.lit(": "), F.col("commits").cast("string"), F.lit(" commits")), 0.4, -F.col("commits"))
    return assemble([told, *extra, who], budget)


def file_context(file_id, summaries: DataFrame, users: DataFrame, uses: DataFrame, symbols: DataFrame, findings: DataFrame, commit_files: DataFrame, budget: int = 4000) -> DataFrame:
    """All that is known of one file.

    ``summaries`` (content, relevance); ``users`` and ``uses`` (path, depth, summary or null); ``symbols``
    (signature, kind); ``findings`` (severity, content).
    """
    def reached(df: DataFrame, section: tuple[str, int]) -> DataFrame:
        line = F.concat(F.lit("**"), "path", F.lit("** (depth "), F.col("depth").cast("string"), F.lit(")"), F.coalesce(F.concat(F.lit("\n"), "summary"), F.lit("")))
        return signal(df, section, line, F.lit(1.0) / F.col("depth"), F.col("depth"))

    return assemble([
        signal(summaries, SUMMARY, F.col("content"), F.col("relevance")),
        reached(users, USED_BY), reached(uses, USES),
        signal(symbols, EXPORTS, F.concat(F.lit("`"), "signature", F.lit("` ("), "kind", F.lit(")")), 0.6),
        signal(findings, FINDINGS, F.col("content"), C.severity_relevance(F.col("severity"))),
        _frequency(commit_files, file_id, HISTORY, " (**hotspot**)"),
        _together(commit_files, file_id, 5, HISTORY, "Co-changes with **", "** (", " times)"),
    ], budget)


def architecture_context(summaries: DataFrame, links: DataFrame, findings: DataFrame, commit_files: DataFrame, budget: int = 5000) -> DataFrame:
    """The project as a whole.

    ``summaries`` (id, level, target_id, content), of which the smallest id of a kind counts; ``links`` (source,
    target) between modules; ``findings`` (severity, content), critical and high ones only (J14).
    """
    purpose = F.contains(F.lower("target_id"), F.lit("purpose"))
    kind = F.when(F.col("level") == "intent", "intent").when((F.col("level") == "system") & purpose, "purpose").when(F.col("level") == "system", "system")
    first = summaries.select("id", "content", kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.min_by("content", "id").alias("content"))
    # one text that serves as purpose and as intent is told once, as purpose
    aims = first.where("kind <> 'system'").groupBy("content").agg(F.max(F.when(F.col("kind") == "purpose", 1.0).otherwise(0.9)).alias("relevance"))
    modules = summaries.where("level = 'module'")
    apart = links.where("source <> target").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("target")), ", ").alias("targets"))
    no_links = apart.agg(F.count("*").alias("n")).where("n = 0")
    return assemble([
        signal(aims, PURPOSE, F.col("content"), F.col("relevance")),
        signal(first.where("kind = 'system'"), SYSTEM, F.col("content"), 1.0),
        signal(modules, MODULES, F.concat(F.lit("**"), F.regexp_replace("target_id", "^module:", ""), F.lit("**\n"), C.sentence_cut(F.col("content"), 200)), 0.7, F.col("id")),
        signal(apart, LINKS, F.concat("source", F.lit(" → "), "targets"), 0.6),
        signal(no_links, LINKS, F.lit("No cross-module dependencies detected."), 0.3),
        signal(findings.where(F.col("severity").isin("critical", "high")), CRITICAL, F.col("content"), C.severity_relevance(F.col("severity"))),
        signal(H.hotspots(commit_files, 10), HOTSPOTS, F.concat(F.lit("**"), "file_path", F.lit("** — "), F.col("changes").cast("string"), F.lit(" changes")), F.least(F.lit(1.0), F.col("changes") / 20), -F.col("changes")),
    ], budget)


def with_summary(paths: DataFrame, summaries: DataFrame, most: int = 150) -> DataFrame:
    """Adds ``summary``: the file summary of each ``path``, cut, or null."""
    # estimated by its file's size a table of texts may seem small enough for the driver
    own = summaries.select(F.col("target_id").alias("__t"), C.sentence_cut(F.col("content"), most).alias("summary")).hint("merge")
    return paths.join(own, F.concat(F.lit("file:"), "path") == F.col("__t"), "left").drop("__t")


def leaving_edges(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(dst) of the edges that leave a set of nodes."""
    out = edges.where("dst is not null").join(inside.select(F.col("id").alias("src")), "src", "left_semi")
    return out.join(inside.select(F.col("id").alias("dst")), "dst", "left_anti").select("dst").distinct()


def _metrics(*parts: Column) -> Column:
    listed = F.concat_ws(", ", *parts)
    return F.when(listed != "", F.concat(F.lit("("), listed, F.lit(")"))).otherwise(F.lit(""))


def _some(c: Column, text: Column) -> Column:
    return F.when(c.isNotNull() & (c != 0), text)


def _file_line() -> Column:
    metrics = _metrics(_some(F.col("complexity"), F.concat(F.lit("complexity: "), F.col("complexity").cast("string"))), _some(F.col("line_count"), F.concat(F.col("line_count").cast("string"), F.lit(" lines"))))
    return F.concat(F.lit("**"), "path", F.lit("** "), metrics, F.lit("\n"), F.coalesce("summary", F.lit("")))


def module_context(module: str, files: DataFrame, summaries: DataFrame, edges: DataFrame, symbols: DataFrame, findings: DataFrame, budget: int = 3000) -> DataFrame:
    """A directory and what it holds and needs.

    ``files`` (id, path, complexity, line_count), ``summaries`` (id, level, target_id, content), ``edges`` (src, dst),
    ``symbols`` (file_id, name, kind, exported), ``findings`` (severity, evidence, content).
    """
    inside = files.where(F.startswith("path", F.lit(module.rstrip("/") + "/")))
    own = summaries.where(F.col("target_id") == f"module:{module}").select(F.concat(F.lit("**Module Summary**\n"), "content").alias("content"), F.lit(1.0).alias("relevance"))
    system = summaries.where("level = 'system'").agg(F.min_by("content", "id").alias("content")).where("content is not null").select(F.concat(F.lit("**System Context**\n"), "content").alias("content"), F.lit(0.8).alias("relevance"))
    outside = leaving_edges(edges, inside).join(files.select(F.col("id").alias("dst"), "path"), "dst").select("path").distinct()
    exports = symbols.where("exported").join(inside.select(F.col("id").alias("file_id"), "path"), "file_id")
    return assemble([
        signal(own.unionByName(system), MODULE, F.col("content"), F.col("relevance")),
        signal(with_summary(inside, summaries), IN_MODULE, _file_line(), 0.7),
        signal(outside, OUTSIDE, F.concat(F.lit("→ "), "path"), 0.5),
        signal(exports, KEY_EXPORTS, F.concat(F.lit("`"), "name", F.lit("` from "), "path", F.lit(" ("), "kind", F.lit(")")), 0.5),
        signal(findings.where(F.contains("evidence", F.lit(module))), FINDINGS, F.col("content"), C.severity_relevance(F.col("severity"))),
    ], budget)


def review_context(commits: DataFrame, commit_files: DataFrame, summaries: DataFrame, findings: DataFrame, since: str, until: str, budget: int = 8000) -> DataFrame:
    """What happened between two dates (J12).  ``findings`` (severity, title, description, evidence)."""
    scope = commits.where(F.col("committed_at").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))
    # a span may hold many commits and paths: neither goes to the driver
    touched = commit_files.join(scope.select(F.col("id").alias("commit_id")).hint("merge"), "commit_id", "left_semi")
    paths = touched.select(F.col("file_path").alias("path")).distinct()
    n = scope.agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    m = paths.agg(F.count("*").alias("m")).withColumn("k", F.lit(1))
    top = H.author_distribution(scope).orderBy(F.desc("commits"), "author").limit(5)
    who = top.agg(F.array_join(F.array_sort(F.collect_list(F.struct((-F.col("commits")).alias("c"), F.concat("author", F.lit(" ("), F.col("commits").cast("string"), F.lit(")")).alias("t"))))["t"], ", ").alias("who")).withColumn("k", F.lit(1))
    told = F.concat(F.lit("**"), F.col("n").cast("string"), F.lit(" commits**, **"), F.col("m").cast("string"), F.lit(" files changed**\nTop authors: "), "who", F.lit(f"\nPeriod: {since[:10]} to {until[:10]}"))
    summary = n.join(m, "k").join(who, "k").select(F.when(F.col("n") > 0, told).otherwise(F.lit("No commits found in the specified date range.")).alias("content"))
    shown = with_summary(paths.orderBy("path").limit(30), summaries.withColumn("content", F.substring("content", 1, 150)))
    hot = H.hotspots(commit_files, 10).join(paths.select(F.col("path").alias("file_path")).hint("merge"), "file_path", "left_semi")
    texts = findings.select("evidence").distinct().select(F.sha2("evidence", 256).alias("id"), F.col("evidence").alias("text"))
    held = M.containing(texts, paths.select(F.col("path").alias("pattern"))).select("id").distinct()
    named = findings.where("evidence is not null").withColumn("id", F.sha2("evidence", 256)).join(held, "id", "left_semi").select("severity", "title", "description").distinct()
    sized = touched.groupBy("commit_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("file_path")), "|").alias("cluster")).where("n between 2 and 10")
    clusters = sized.groupBy("cluster").agg(F.count("*").alias("times")).where("times >= 2").orderBy(F.desc("times"), "cluster").limit(5)
    listed = F.array_join(F.transform(F.split("cluster", "[|]"), lambda p: F.concat(F.lit("  - "), p)), "\n")
    purpose = F.contains(F.lower("target_id"), F.lit("purpose"))
    base = summaries.where("level = 'system'").groupBy(purpose.alias("aim")).agg(F.min_by("content", "id").alias("content"))
    return assemble([
        signal(summary, CHANGES, F.col("content"), 1.0),
        signal(shown, CHANGED, F.concat(F.lit("**"), "path", F.lit("**\n"), F.coalesce("summary", F.lit("(no summary)"))), 0.7),
        signal(hot, HOT, F.concat(F.lit("**"), "file_path", F.lit("** — "), F.col("changes").cast("string"), F.lit(" total changes (potential instability)")), F.least(F.lit(1.0), F.col("changes") / 20), -F.col("changes")),
        signal(named, AFFECTED, F.concat(F.lit("**"), F.upper("severity"), F.lit(":** "), "title", F.lit("\n"), F.coalesce("description", F.lit(""))), F.when(F.col("severity") == "critical", 1.0).when(F.col("severity") == "high", 0.85).otherwise(0.6)),
        signal(clusters, CLUSTERS, F.concat(F.lit("Changed together "), F.col("times").cast("string"), F.lit(" times:\n"), listed), F.least(F.lit(1.0), F.col("times") / 5), -F.col("times")),
        signal(base, BASELINE, F.concat(F.when(F.col("aim"), F.lit("**Purpose Document**\n")).otherwise(F.lit("**System Architecture**\n")), "content"), F.when(F.col("aim"), 0.8).otherwise(0.7)),
    ], budget)


def commits_of_files(commits: DataFrame, commit_files: DataFrame, files: DataFrame, each: int = 10, most: int = 15) -> DataFrame:
    """The latest commits of some files (id): at most ``each`` of a file, each commit once, ``most`` in all."""
    touched = commit_files.select("file_id", "commit_id").distinct().join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    w = W.partitionBy("file_id").orderBy(F.desc("committed_at"), F.desc("id"))
    own = touched.join(commits, F.col("commit_id") == F.col("id")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= each)
    return own.select(*commits.columns).dropDuplicates(["sha"]).orderBy(F.desc("committed_at"), F.desc("id")).limit(most)


def without_shown(commits: DataFrame, shown: DataFrame) -> DataFrame:
    """Commits that are not shown elsewhere, by sha."""
    return commits.join(shown.select("sha"), "sha", "left_anti")


def task_context(mentioned: DataFrame, found: DataFrame, files: DataFrame, summaries: DataFrame, edges: DataFrame, commits: DataFrame, commit_files: DataFrame, budget: int = 16000) -> DataFrame:
    """All that helps with one task.

    ``mentioned`` (id) are files that the task names, ``found`` (kind, target, content, relevance) what a search gives
    (:func:`codestrata.operators.vector.partitioned_search`); the other tables are as in the other contexts.
    """
    code, docs = found.where("kind = 'code'"), found.where("kind = 'doc'")
    # what one task names and finds is few; tables of files go to no driver, however small their file is
    named = files.join(F.broadcast(mentioned.select("id").distinct()), "id", "left_semi")
    best = F.broadcast(code).join(files.select("id", F.col("path").alias("target")), "target").groupBy("id").agg(F.max("relevance").alias("r")).orderBy(F.desc("r"), "id").limit(5)
    around = named.select("id").unionByName(best.select("id")).distinct()
    path = files.select("id", "path")
    needs = edges.where("dst is not null").join(F.broadcast(named.select(F.col("id").alias("src"), F.col("path").alias("by"))), "src").join(F.broadcast(named.select(F.col("id").alias("dst"))), "dst", "left_anti")
    needs = needs.groupBy("dst").agg(F.count_distinct("src").alias("n"), F.array_join(F.array_sort(F.collect_set("by")), ", ").alias("by"))
    needs = with_summary(needs.join(path.withColumnRenamed("id", "dst").hint("merge"), "dst"), summaries)
    told = F.coalesce("summary", F.lit(""))
    users = edges.join(F.broadcast(around.select(F.col("id").alias("dst"))), "dst", "left_semi").join(F.broadcast(around.select(F.col("id").alias("src"))), "src", "left_anti")
    users = users.join(path.select(F.col("id").alias("dst"), F.substring_index("path", "/", -1).alias("of")).hint("merge"), "dst").groupBy("src").agg(F.count_distinct("dst").alias("n"), F.array_join(F.array_sort(F.collect_set("of")), ", ").alias("of"))
    users = users.join(path.withColumnRenamed("id", "src").hint("merge"), "src").orderBy(F.desc("n"), "path").limit(25)
    total = around.agg(F.count("*").alias("total")).withColumn("k", F.lit(1))
    users = users.withColumn("k", F.lit(1)).join(total, "k")
    scoped = commits_of_files(commits, commit_files, best)
    latest = without_shown(commits.orderBy(F.desc("committed_at"), F.desc("id")).limit(10), scoped)
    purpose = F.contains(F.lower("target_id"), F.lit("purpose"))
    kind = F.when(F.col("level") == "intent", "intent").when((F.col("level") == "system") & purpose, "purpose").when(F.col("level") == "system", "system")
    first = summaries.select("id", "content", kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.min_by("content", "id").alias("content"))
    aims = first.where("kind <> 'system'").groupBy("content").agg(F.max(F.when(F.col("kind") == "purpose", 1.0).otherwise(0.9)).alias("relevance"))
    newest = -F.unix_micros(F.col("committed_at").cast("timestamp"))
    return assemble([
        signal(with_summary(named, summaries), MENTIONED, _file_line(), 1.0),
        signal(aims, PURPOSE, F.col("content"), F.col("relevance")),
        signal(first.where("kind = 'system'"), SYSTEM, F.col("content"), 1.0),
        signal(needs, NEEDED, F.concat(F.lit("**"), "path", F.lit("** (imported by: "), "by", F.lit(")\n"), told), F.when(F.col("n") > 1, 0.85).otherwise(0.6)),
        signal(needs.where("n >= 2"), SHARED, F.concat(F.lit("**"), "path", F.lit("** — shared by "), "by", F.lit("\n"), told), F.least(F.lit(1.0), 0.7 + F.col("n") * 0.1)),
        signal(code, CODE, F.col("content"), F.col("relevance")),
        signal(docs, READING, F.col("content"), F.col("relevance")),
        signal(users, RADIUS, F.concat(F.lit("**"), "path", F.lit("** (depends on "), "of", F.lit(")")), F.least(F.lit(1.0), F.col("n") / F.col("total") + 0.3), -F.col("n")),
        signal(scoped, SCOPED, _commit_line(), 0.8, newest),
        signal(latest, LATEST, _commit_line(), 0.6, newest),
    ], budget)
