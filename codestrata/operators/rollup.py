"""Summaries of files from their symbols, of modules from files, and of the system, by a language model (H9).

What did not change keeps its summary: files that are not dirty, files of whose symbols less than a tenth changed, and whatever
has the same prompt as before.  The rest is asked level by level in waves (:mod:`codestrata.operators.summaries`), files of few
symbols in batches.  A prompt is one text by nature, so a module's lines and the system's are gathered into a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.semantic import split_batch_answer
from codestrata.operators import incremental as I
from codestrata.operators.graph import _cut
from codestrata.operators.summaries import Ask, asked

#: The prompts, and how files of a batch are told apart.
TEMPLATES = {
    "file": "Summarise the following file based on its symbol summaries:\n\nFile: {{filePath}}\n\n{{symbolSummaries}}",
    "module": "Summarise the following module based on its file summaries:\n\nModule: {{modulePath}}\n\n{{fileSummaries}}",
    "system": "Summarise the following system based on its module summaries:\n\nProject: {{projectName}}\n\n{{moduleSummaries}}",
}
BATCH = "Summarise each of the following files separately. For each file, write the file path on its own line followed by the summary.\n\n"
#: Files of fewer symbols are batched; a share of changed symbols below the second is no change, an edit up to the third is none.
SMALL, TRIVIAL, EDIT = 5, 0.1, 0.15
#: Changed symbols whose ids' hashes (8 bytes each) are sent to the tasks that read texts; of more, all texts travel.
SENT = 1_000_000
_LEVELS = ("file", "module", "system")


def _filled(template: str, **values: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), kv[1]), values.items(), F.lit(template))


def _lines(order: str = "target_id") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "content"))), lambda x: F.concat(F.lit("- "), x[order], F.lit(": "), x["content"])), "\n")


def changed_share(symbols: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, n, changed): symbols of each file, and those that are new or were edited by more than ``EDIT`` (H6, H7)."""
    old = previous.where(~F.col("level").isin(*_LEVELS))
    told = old.select("target_id", F.col("input_hash").alias("__h"), F.lit(True).alias("__known"))
    other = F.col("__known") & ~F.col("input_hash").eqNullSafe(F.col("__h"))
    of = symbols.select("path", "target_id", "input_hash").join(told, "target_id", "left")
    of = _cut(of.select("path", "target_id", F.col("__known").isNull().alias("new"), F.coalesce(other, F.lit(False)).alias("other")))
    # only texts whose hash changed are compared, so only these travel; the hashes of their ids pick them and decide nothing
    changed = of.where("other").select("target_id").distinct()
    few = changed.count() <= SENT
    ids = F.broadcast(changed.select(F.xxhash64("target_id").alias("__t")).distinct()) if few else None
    def text(of: DataFrame, name: str) -> DataFrame:
        texts = of.select("target_id", F.coalesce("content", F.lit("")).alias(name))
        return texts.join(ids, F.xxhash64("target_id") == F.col("__t"), "left_semi") if few else texts
    both = changed.join(text(symbols, "content"), "target_id").join(text(old, "__c"), "target_id")
    edited = both.where(I.edit_ratio(F.col("__c"), F.col("content")) > EDIT).select("target_id", F.lit(True).alias("edited")).distinct()
    moved = F.col("new") | (F.col("other") & F.col("edited").isNotNull())
    return of.join(edited, "target_id", "left").groupBy("path").agg(F.count("*").alias("n"), F.sum(F.when(moved, 1).otherwise(0)).alias("changed"))


def _decided(items: DataFrame, previous: DataFrame, level: str, clean: Column, key: str) -> DataFrame:
    """Adds the old summary, and whether it stays: what is ``clean`` or has the same prompt.

    ``key`` is the target without its level, by which items were gathered, so prompts need not travel again.
    """
    old = previous.where((F.col("level") == level) & F.col("target_id").startswith(f"{level}:"))
    old = old.select(F.substr("target_id", F.lit(len(level) + 2)).alias(key), F.col("input_hash").alias("old_hash"), F.col("content").alias("old"), F.lit(True).alias("has"))
    j = items.withColumn("input_hash", F.sha2("prompt", 256)).join(old, key, "left")
    return _cut(j.withColumn("reused", F.coalesce(F.col("has") & (clean | F.col("input_hash").eqNullSafe(F.col("old_hash"))), F.lit(False))))


def _kept(d: DataFrame, level: str) -> DataFrame:
    return d.where("reused").select(F.lit(level).alias("level"), "target_id", F.col("old_hash").alias("input_hash"), F.col("old").alias("content"), F.lit(0.0).alias("cost"), "reused")


def _new(d: DataFrame, told: DataFrame, level: str) -> DataFrame:
    a = told.where("error is null").select(F.col("id").alias("target_id"), F.col("answer").alias("content"), "cost")
    return d.where("not reused").select("target_id", "input_hash").join(a, "target_id").select(F.lit(level).alias("level"), "target_id", "input_hash", "content", "cost", F.lit(False).alias("reused"))


def rollup(symbols: DataFrame, previous: DataFrame, folder: str, budget: float, ask: Ask, run: str = "1", dirty: DataFrame | None = None, files: DataFrame | None = None, project: str = "project", templates: dict[str, str] | None = None) -> DataFrame:
    """(level, target_id, input_hash, content, cost, reused) of files, modules and the system.

    ``symbols`` is (path, target_id, input_hash, content), one row a target; ``previous`` the (level, target_id, input_hash, content) of
    the last run, its symbols under a level of their own; ``dirty`` (path) the files to look at, all without it; ``files`` optionally
    (path, language, symbol_count); ``folder`` is shared and holds the logs of ``run``.  A summary that failed, or for
    which the budget did not reach, is absent; of the system, the old one stays.  A batch whose call fails is asked file by file.
    """
    t = TEMPLATES | (templates or {})
    s = symbols.where("path <> ''").select("path", "target_id", "input_hash", F.coalesce("content", F.lit("")).alias("content"))
    by_file = s.groupBy("path").agg(_lines().alias("lines")).join(changed_share(s, previous), "path")
    about = files.select("path", "language", "symbol_count") if files is not None else symbols.sparkSession.createDataFrame([], "path string, language string, symbol_count long")
    by_file = by_file.join(about, "path", "left")
    prompt = _filled(t["file"], filePath=F.col("path"), language=F.coalesce("language", F.lit("unknown")), symbolCount=F.coalesce("symbol_count", "n").cast("string"), symbolSummaries=F.col("lines"))
    items = by_file.select("path", "n", (F.col("changed") / F.col("n") < TRIVIAL).alias("slight"), F.concat(F.lit("file:"), "path").alias("target_id"), prompt.alias("prompt"))
    if dirty is not None:
        items = items.join(dirty.select("path", F.lit(True).alias("dirty")).distinct(), "path", "left").withColumn("slight", F.col("slight") | F.col("dirty").isNull())
    d = _decided(items, previous, "file", F.col("slight"), "path")

    todo = d.where("not reused")
    few = todo.where(F.col("n") < SMALL)
    dealt = I.batches(few.select(F.lit("file").alias("g"), F.col("path").alias("ord"), F.col("path").alias("id"), F.char_length("prompt").alias("size")), "g")
    grouped = few.join(dealt.select(F.col("id").alias("path"), "batch"), "path").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("path", "prompt"))).alias("f"))
    block = F.array_join(F.transform("f", lambda x, i: F.concat(F.lit("--- FILE "), (i + 1).cast("string"), F.lit(": "), x["path"], F.lit(" ---\n"), x["prompt"])), "\n\n")
    one = F.size("f") == 1
    unit = F.when(one, F.concat(F.lit("file:"), F.col("f")[0]["path"])).otherwise(F.concat(F.lit("batch:"), F.col("batch").cast("string")))
    small = _cut(grouped.select(unit.alias("id"), F.when(one, F.col("f")[0]["prompt"]).otherwise(F.concat(F.lit(BATCH), block)).alias("prompt"), F.col("f.path").alias("paths")))
    together, spent = asked(small.select("id", "prompt"), f"{folder}/batches", budget, ask, run)
    told = small.select("id", "paths").join(together, "id")
    parts = F.when(F.size("paths") == 1, F.array("answer")).otherwise(split_batch_answer(F.col("answer"), F.col("paths")))
    split = told.where("error is null").select((F.col("cost") / F.size("paths")).alias("cost"), "error", F.explode(F.arrays_zip(F.col("paths").alias("path"), parts.alias("answer"))).alias("x"))
    split = split.select(F.concat(F.lit("file:"), "x.path").alias("id"), F.col("x.answer").alias("answer"), "cost", "error")
    failed = _cut(told.where("error is not null and size(paths) > 1").select(F.explode("paths").alias("path")))
    alone = todo.where(F.col("n") >= SMALL).select(F.col("target_id").alias("id"), "prompt")
    if not failed.isEmpty():  # prompts are looked up only if some are wanted
        alone = _cut(alone.union(todo.join(failed, "path", "left_semi").select("target_id", "prompt")))
    single, more = asked(alone, f"{folder}/files", budget - spent, ask, run)
    spent += more
    fresh = _cut(_new(d, split.unionByName(single), "file"))
    own = _kept(d, "file").unionByName(fresh)

    module = I.dirname(F.substr(F.col("target_id"), F.lit(6)))
    lines = own.withColumn("module", module).where("module is not null")
    of = lines.groupBy("module").agg(_lines().alias("lines"), F.count("*").alias("n"), F.bool_or(~F.col("reused")).alias("moved"))
    prompt = _filled(t["module"], modulePath=F.col("module"), fileCount=F.col("n").cast("string"), fileSummaries=F.col("lines"))
    d = _decided(of.select("module", F.concat(F.lit("module:"), "module").alias("target_id"), prompt.alias("prompt"), "moved"), previous, "module", ~F.col("moved") if dirty is not None else F.lit(False), "module")
    told, more = asked(d.where("not reused").select(F.col("target_id").alias("id"), "prompt"), f"{folder}/modules", budget - spent, ask, run)
    spent += more
    modules = _kept(d, "module").unionByName(_cut(_new(d, told, "module")))

    of = modules.agg(_lines().alias("lines"), F.count("*").alias("n"), F.coalesce(F.bool_or(~F.col("reused")), F.lit(False)).alias("moved")).where("n > 0")
    prompt = _filled(t["system"], projectName=F.lit(project), moduleCount=F.col("n").cast("string"), moduleSummaries=F.col("lines"))
    d = _decided(of.select(F.lit(project).alias("project"), F.lit(f"system:{project}").alias("target_id"), prompt.alias("prompt"), "moved"), previous, "system", ~F.col("moved") if dirty is not None else F.lit(False), "project")
    told, _ = asked(d.where("not reused").select(F.col("target_id").alias("id"), "prompt"), f"{folder}/system", budget - spent, ask, run)
    system = _cut(_new(d, told, "system"))
    stays = previous.where((F.col("level") == "system") & (F.col("target_id") == f"system:{project}")).join(system, "target_id", "left_anti")
    return own.unionByName(modules).unionByName(system).unionByName(stays.select("level", "target_id", "input_hash", "content", F.lit(0.0).alias("cost"), F.lit(True).alias("reused")))


def digest_model(prompt: str) -> tuple[str, float]:
    """An offline model that costs nothing: the digest of a prompt, of each file's in a batch."""
    import hashlib
    import re

    def of(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    if not prompt.startswith(BATCH):
        return of(prompt), 0.0
    _, *parts = re.split(r"(?:^|\n\n)--- FILE \d+: (.*) ---\n", prompt[len(BATCH):])
    return "\n".join(f"{path}\n{of(text)}" for path, text in zip(parts[::2], parts[1::2], strict=True)), 0.0
