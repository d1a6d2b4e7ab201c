"""Ranking and budgeting of context documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import text as T

CHARS_PER_TOKEN = 4
# What stands under a cut section and under a cut document.
MARK = "\n\n*(truncated)*"
NOTE = ("*Context truncated to ~", " tokens. Increase maxTokens for more detail.*")


def relevance(score: Column, path: Column, words: list[str], include_tests: bool = False) -> Column:
    """Base score, cut for test paths and lifted for intent words in the path, in [0, 1]."""
    s = score if include_tests else F.when(T.is_test(path), score * 0.3).otherwise(score)
    hits = sum((F.when(F.contains(F.lower(path), F.lit(w.lower())), 1).otherwise(0) for w in words), F.lit(0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s * (1 + 0.15 * hits)))


def merge_ranked(a: DataFrame, b: DataFrame, wa: float = 0.6, wb: float = 0.4, both: float = 0.15, order: str = "id") -> DataFrame:
    """Two ranked lists merged on their first 100 characters.

    The last row of a key in the first list counts; rows of the second add up, each with the bonus where
    the key is known already, from the first list or from an earlier row of the second.
    """
    key = F.substring("content", 1, 100).alias("key")
    x = a.groupBy(key).agg(F.max_by("relevance", order).alias("ra"))
    y = b.groupBy(key).agg(F.sum("relevance").alias("rb"), F.count("*").alias("n"))
    j = x.join(y, "key", "full")
    known = F.coalesce("n", F.lit(0)) - F.when(F.col("ra").isNull(), 1).otherwise(0)
    s = F.coalesce(F.col("ra") * wa, F.lit(0.0)) + F.coalesce(F.col("rb") * wb, F.lit(0.0)) + known * both
    return j.select("key", F.round(s, 6).alias("relevance"))


def build_sections(items: DataFrame, budget: int | None = None) -> DataFrame:
    """Sections from items (heading, priority, ord, content, relevance): most relevant first, a blank line between.

    With a ``budget`` only the items that so many tokens can show are gathered: a section is then a little longer
    than the budget at most, whatever its heading holds, and :func:`truncate` cuts it as it would the whole.
    """
    kept = items.where("content is not null and content <> ''")
    if budget is not None:
        w = W.partitionBy("heading", "priority").orderBy(F.desc("relevance"), "ord", "content")
        # an item takes three characters at least, with the blank line: the first rows of a heading are found before the shuffle
        kept = kept.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= budget * CHARS_PER_TOKEN // 3 + 2)
        used = F.sum(F.char_length("content") + 2).over(w.rowsBetween(W.unboundedPreceding, -1))
        kept = kept.withColumn("__used", F.coalesce(used, F.lit(0))).where(F.col("__used") <= budget * CHARS_PER_TOKEN).drop("__k", "__used")
    parts = F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "ord", "content")))
    g = kept.groupBy("heading", "priority").agg(F.array_join(parts["content"], "\n\n").alias("content"))
    return g.withColumn("tokens", F.ceil(F.char_length("content") / CHARS_PER_TOKEN))


def truncate(sections: DataFrame, budget: int, group: str | None = None) -> DataFrame:
    """Sections by priority within a token budget; the first that overflows is cut, later ones go."""
    w = W.partitionBy(*([group] if group else [F.lit(0)])).orderBy("priority", "heading").rowsBetween(W.unboundedPreceding, -1)
    s = sections.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0))).where(F.col("before") < budget)
    left = F.lit(budget) - F.col("before")
    fits = F.col("tokens") <= left
    cut = F.concat(F.substring(F.col("content"), F.lit(1), (left * CHARS_PER_TOKEN).cast("int")), F.lit(MARK))
    return s.select(*([group] if group else []), "heading", "priority", F.when(fits, F.col("content")).otherwise(cut).alias("content"), F.when(fits, F.col("tokens")).otherwise(left).cast("long").alias("tokens"), (~fits).alias("truncated"))


def sentence_cut(text: Column, most: int) -> Column:
    """Cut to a length; back to the last full stop if that keeps over half, else with an ellipsis."""
    head = F.substring(text, 1, most)
    stop = F.char_length(head) - F.instr(F.reverse(head), ".") + 1
    good = F.contains(head, F.lit(".")) & (stop > most * 0.5)
    return F.when(F.char_length(text) <= most, text).when(good, F.substring(head, F.lit(1), stop.cast("int"))).otherwise(F.concat(head, F.lit("...")))


def related_files(semantic: DataFrame, graph: DataFrame, together: DataFrame, k: int = 20) -> DataFrame:
    """Fuses semantic score, graph depth and co-change count of each path."""
    z = F.lit(None).cast("double")
    u = semantic.select("path", F.col("score").alias("sem"), z.alias("depth"), z.alias("cc"))
    u = u.unionByName(graph.select("path", z.alias("sem"), F.col("depth").cast("double").alias("depth"), z.alias("cc"))).unionByName(together.select("path", z.alias("sem"), z.alias("depth"), F.col("co_changes").cast("double").alias("cc")))
    g = u.groupBy("path").agg(F.max("sem").alias("sem"), F.min("depth").alias("depth"), F.max("cc").alias("cc"))
    has = lambda c: F.col(c).isNotNull()
    s = 0.5 * F.coalesce("sem", F.lit(0.0)) + F.coalesce(0.3 / F.col("depth"), F.lit(0.0)) + 0.2 * F.least(F.lit(1.0), F.coalesce(F.col("cc") / 10, F.lit(0.0)))
    s = s + F.when(has("sem") & has("depth"), 0.1).otherwise(0.0) + F.when(has("cc") & (has("sem") | has("depth")), 0.05).otherwise(0.0)
    label = F.concat_ws("+", F.when(has("sem"), F.lit("semantic")), F.when(has("depth"), F.lit("dependency")), F.when(has("cc"), F.lit("co-change")))
    return g.select("path", F.round(s, 6).alias("score"), label.alias("relationship")).orderBy(F.desc("score"), "path").limit(k)


def severity_relevance(severity: Column) -> Column:
    """Fixed relevance of a severity."""
    return F.when(severity == "critical", 1.0).when(severity == "high", 0.85).when(severity == "medium", 0.6).when(severity == "low", 0.4).otherwise(0.2)


def render_markdown(sections: DataFrame) -> DataFrame:
    """One markdown document from sections, with a note if any was cut."""
    parts = F.array_sort(F.collect_list(F.struct("priority", "heading", "content")))
    body = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("## "), p["heading"], F.lit("\n\n"), p["content"], F.lit("\n"))), "\n")
    note = F.concat(F.lit("\n---\n" + NOTE[0]), F.sum("tokens").cast("string"), F.lit(NOTE[1]))
    return sections.agg(F.concat(body, F.when(F.bool_or("truncated"), note).otherwise(F.lit(""))).alias("markdown"))
