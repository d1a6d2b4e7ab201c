"""Summaries by a language model, asked in waves under a budget, with a durable log of answers.

A folder holds one log.  A run numbers its unanswered prompts once and writes them sorted (``todo``); each wave reads the
next of them, asks, and writes its answers before another starts, so a prompt is evaluated by one write and by
nothing else.  A wave starts only if the budget, less what was spent in fact, is not used up, and is as
large as the mean cost so far lets the rest pay for, up to what was asked before it, so waves double; with ``wave=1`` that is the cutoff after each call.
A run that was stopped goes on after its last whole wave.  A prompt that fails is a row with its error, and is
asked again by another run.  Equal prompts are asked once and answer all their ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions.semantic import DEMOTED, checked_score, extractive_summariser, parse_answer

#: What is added to a prompt, and to that of a second try.
SUFFIX = "\n\nAfter your summary, on a new line write CONFIDENCE: followed by a number from 0.0 to 1.0 rating how confident you are that this summary accurately captures the symbol's purpose."
NEIGHBOURS = "\n\nAdditional context — neighboring symbols in the same file:\n"
AGAIN = "\n\nPlease provide a more specific and accurate summary."
NO_SIGNATURE = "no signature"
#: Prompts of a wave at most, unless more were asked before it, and of a task.
WAVE, TASK = 20_000, 200

Ask = Callable[[str], tuple[str, float]]
_One = Callable[[str, str], tuple[str | None, float, int, str | None]]
_ANSWERS = "seq long, id {id}, input_hash string, name string, lines int, answer string, cost double, calls int, error string, run string"


def neighbour_context(symbols: DataFrame, most: int = 5) -> DataFrame:
    """(path, name, context): the first other symbols of each symbol's file; ``symbols`` is (path, name, kind, start_line, signature)."""
    line = F.concat(F.lit("  - "), "name", F.lit(" ("), "kind", F.lit("): "), F.coalesce("signature", F.lit(NO_SIGNATURE)))
    of = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "name", line.alias("line")))).alias("all"))
    own = symbols.select("path", "name").distinct().join(of, "path")
    return own.select("path", "name", F.array_join(F.slice(F.transform(F.filter("all", lambda s: s["name"] != F.col("name")), lambda s: s["line"]), 1, most), "\n").alias("context"))


def _score(answer: str) -> float:
    stated = re.search(r"CONFIDENCE:\s*(\d+(?:\.\d*)?|\.\d+)", answer)
    return min(1.0, float(stated[1])) if stated else 0.5


def _read(spark, folder: str) -> DataFrame | None:
    try:
        return spark.read.option("recursiveFileLookup", "true").parquet(folder)
    except AnalysisException:  # nothing is written yet
        return None


def _todo(chunks: DataFrame, known: DataFrame | None, log: DataFrame | None, run: str) -> DataFrame:
    """(id, input_hash, rows, at) of distinct prompts without an answer, numbered in the order of their first id, no task holding all."""
    asked = chunks.select("id", F.sha2("prompt", 256).alias("input_hash"))
    for old in (known, log.where(F.col("error").isNull() | (F.col("run") == run)) if log is not None else None):
        if old is not None:
            asked = asked.join(old.select("input_hash"), "input_hash", "left_anti")
    each = asked.groupBy("input_hash", "id").agg(F.count("*").alias("rows"))
    first = each.groupBy("input_hash").agg(F.min(F.struct("id", "rows")).alias("p")).select("p.id", "input_hash", "p.rows")
    return first.repartitionByRange("id", "input_hash").sortWithinPartitions("id", "input_hash").withColumn("at", F.monotonically_increasing_id())


def _prompts(chunks: DataFrame, numbered: DataFrame) -> DataFrame:
    """The rows of numbered prompts: a prompt travels once, and only where an id has it in several rows one of these is chosen."""
    context = F.col("context") if "context" in chunks.columns else F.lit("")
    rows = chunks.select("id", "prompt", F.coalesce(context, F.lit("")).alias("context"), "name", F.col("lines").cast("int").alias("lines"), F.sha2("prompt", 256).alias("input_hash"))

    def of(n: DataFrame) -> DataFrame:
        n = n.select(F.col("id").alias("__id"), F.col("input_hash").alias("__hash"), "seq")
        return rows.join(n, F.col("id").eqNullSafe(F.col("__id")) & (F.col("input_hash") == F.col("__hash"))).drop("__id", "__hash")

    several = numbered.where("rows > 1")
    if several.isEmpty():
        return of(numbered)
    one = of(several).groupBy("seq").agg(F.min_by(F.struct("id", "prompt", "context", "name", "lines", "input_hash"), F.struct("name", "context")).alias("p"))
    return of(numbered.where("rows = 1")).unionByName(one.select("p.*", "seq"))


def _numbered(todo: DataFrame) -> DataFrame:
    """Dense numbers from the places of a table that was written sorted."""
    part = F.shiftright("at", 33)
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    starts = todo.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return todo.withColumn("part", part).join(starts, "part").withColumn("seq", F.col("start") + F.col("at") - F.shiftleft("part", 33)).drop("at", "part", "start")


def _waves(chunks: DataFrame, folder: str, budget: float, answerer: Callable[[float], _One], run: str, known: DataFrame | None, wave: int | None) -> DataFrame | None:
    """The log's rows of ``run``; ``answerer`` makes, of the budget that is left, what answers one (prompt, context)."""
    spark = chunks.sparkSession
    base = folder.rstrip("/")
    log = _read(spark, f"{base}/answers")
    plan = f"{base}/todo/{run}"
    if _read(spark, plan) is None:
        _todo(chunks, known, log, run).write.parquet(f"{plan}-sorted", mode="overwrite")
        _prompts(chunks, _numbered(spark.read.parquet(f"{plan}-sorted"))).sortWithinPartitions("seq").write.parquet(plan, compression="zstd")
    todo = spark.read.parquet(plan)
    total = todo.count()
    kind = dict(chunks.dtypes)["id"]

    def asker(left: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        one = answerer(left)

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                told = pd.DataFrame([one(p, c) for p, c in zip(b["prompt"], b["context"], strict=True)], columns=["answer", "cost", "calls", "error"])
                yield pd.concat([b[["seq", "id", "input_hash", "name", "lines"]].reset_index(drop=True), told], axis=1).assign(run=run)
        return rows

    def told(rows: DataFrame | None) -> tuple[int, float, int]:
        return (0, 0.0, 0) if rows is None else tuple(rows.where(F.col("run") == run).agg(F.coalesce(F.max("seq") + 1, F.lit(0)), F.coalesce(F.sum("cost"), F.lit(0.0)), F.count("*")).first())

    done, spent, asked = told(log)
    while done < total and spent < budget:
        most = wave or max(WAVE, asked)
        size = most if asked == 0 or spent == 0 else max(1, min(most, int((budget - spent) * asked / spent)))
        # with costs unknown the first wave is a small one
        size = min(size, TASK) if asked == 0 else size
        part = todo.where((F.col("seq") >= done) & (F.col("seq") < done + size)).repartition(max(1, -(-size // TASK)), "seq")
        own = f"{base}/answers/{run}/{done}"
        part.mapInPandas(asker(budget - spent), _ANSWERS.format(id=kind)).write.parquet(own, mode="overwrite")
        end, cost, n = told(spark.read.parquet(own))  # of this wave only, as the log grows
        done, spent, asked = max(done, end), spent + cost, asked + n
    log = _read(spark, f"{base}/answers")
    return log.where(F.col("run") == run) if log is not None else None


def summarise(chunks: DataFrame, folder: str, budget: float, ask: Ask = extractive_summariser, run: str = "1", known: DataFrame | None = None, wave: int | None = None) -> DataFrame:
    """(id, input_hash, summary, quality_score, demoted, cost, calls, error) of prompts that ``run`` answered.

    ``chunks`` is (id, prompt, name, lines) and optionally context, see :func:`neighbour_context`; ``known`` (input_hash) are
    prompts answered elsewhere; ``folder`` must be shared by driver and executors.  A stated confidence below
    ``DEMOTED`` asks once more with the context, and the second answer stays; the checks of the answer follow.
    Costs of equal prompts are on the smallest id.  A task that Spark repeats asks its prompts again.
    """
    def answerer(left: float) -> _One:
        def one(prompt: str, context: str) -> tuple[str | None, float, int, str | None]:
            spent, calls = 0.0, 0
            try:
                calls += 1
                answer, cost = ask(prompt + SUFFIX)
                spent += cost
                if _score(answer) < DEMOTED and spent < left:
                    calls += 1
                    answer, cost = ask(prompt + NEIGHBOURS + context + AGAIN + SUFFIX)
                    spent += cost
                return answer, spent, calls, None
            except Exception as e:  # whatever the model raises is this prompt's result
                return None, spent, calls, f"{type(e).__name__}: {e}"
        return one

    return answers(chunks, _waves(chunks, folder, budget, answerer, run, known, wave))


def asked(prompts: DataFrame, folder: str, budget: float, ask: Ask, run: str = "1", wave: int | None = None) -> tuple[DataFrame, float]:
    """(id, answer, cost, error) of the prompts (id, prompt), as they are and once, and what was spent; see :func:`summarise`."""
    def answerer(left: float) -> _One:
        def one(prompt: str, context: str) -> tuple[str | None, float, int, str | None]:
            try:
                answer, cost = ask(prompt)
            except Exception as e:  # whatever the model raises is this prompt's result
                return None, 0.0, 1, f"{type(e).__name__}: {e}"
            return answer, float(cost), 1, None
        return one

    chunks = prompts.select("id", "prompt", F.lit("").alias("name"), F.lit(0).alias("lines"))
    log = _waves(chunks, folder, budget, answerer, run, None, wave)
    if log is None:
        log = prompts.sparkSession.createDataFrame([], _ANSWERS.format(id=dict(prompts.dtypes)["id"]))
    own = prompts.select("id", F.sha2("prompt", 256).alias("input_hash"))
    told = own.join(log.select("input_hash", F.col("id").alias("first"), "answer", "cost", "error"), "input_hash")
    return told.select("id", "answer", F.when(F.col("id") == F.col("first"), F.col("cost")).otherwise(0.0).alias("cost"), "error"), log.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]


def answers(chunks: DataFrame, log: DataFrame | None) -> DataFrame:
    """The log's answers for every id of ``chunks``, with the checks applied."""
    spark = chunks.sparkSession
    if log is None:
        log = spark.createDataFrame([], _ANSWERS.format(id=dict(chunks.dtypes)["id"]))
    own = chunks.select("id", F.sha2("prompt", 256).alias("input_hash"), "name", "lines")
    j = own.join(log.select("input_hash", F.col("id").alias("first_id"), "answer", "cost", "calls", "error"), "input_hash")
    j = j.withColumn("p", parse_answer(F.col("answer"))).withColumn("score", checked_score(F.col("p.summary"), F.col("name"), F.col("lines"), F.col("p.score")))
    first = F.col("id") == F.col("first_id")
    told = F.col("error").isNull()
    def if_told(c: Column) -> Column:
        return F.when(told, c)
    return j.select("id", "input_hash", if_told(F.col("p.summary")).alias("summary"), if_told(F.col("score")).alias("quality_score"), if_told(F.col("score") < DEMOTED).alias("demoted"),
                    F.when(first, F.col("cost")).otherwise(0.0).alias("cost"), F.when(first, F.col("calls")).otherwise(0).alias("calls"), "error")
