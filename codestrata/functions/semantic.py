"""The semantic layer: chunks of symbols, answers of a summariser, their quality, and plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
# Kinds of symbols worth a summary, and the mark of a cut one.
KINDS = ("function", "class", "interface", "enum")
CUT = "\n// ... [truncated]"
# Answers that say nothing, and parts of names that a summary should not pass over.
VAGUE = (
    r"(?i)this (?:function|method|class) (?:does|handles|performs) (?:things|logic|operations|work|stuff)",
    r"(?i)^(?:a |the )?(?:function|method|class|helper|utility)\s*$",
)
KEY_TERMS = ("auth", "cache", "valid", "encrypt", "decrypt", "parse", "format", "connect", "query", "fetch", "send", "receive")
DEMOTED = 0.4


def symbol_chunks(files: DataFrame, symbols: DataFrame, most: int = 3000) -> DataFrame:
    """(path, name, kind, start_line, end_line, source, tokens) of the symbols worth a summary.

    ``files`` is (path, content), ``symbols`` (path, name, kind, start_line, end_line); a source of more than
    ``most`` tokens is cut and marked.
    """
    own = symbols.where(F.col("kind").isin(*KINDS)).join(files.select("path", F.split("content", "\n").alias("lines")), "path")
    first, last = F.greatest(F.lit(0), F.coalesce("start_line", F.lit(1)) - 1), F.least(F.size("lines"), F.coalesce("end_line", F.size("lines")))
    source = F.when(last > first, F.array_join(F.slice("lines", (first + 1).cast("int"), (last - first).cast("int")), "\n")).otherwise(F.lit(""))
    own = own.withColumn("source", source).withColumn("tokens", F.ceil(F.char_length("source") / CHARS_PER_TOKEN))
    long = F.col("tokens") > most
    return own.select(
        "path", "name", "kind", F.coalesce("start_line", F.lit(1)).alias("start_line"), F.coalesce("end_line", F.lit(1)).alias("end_line"),
        F.when(long, F.concat(F.substring("source", 1, most * CHARS_PER_TOKEN), F.lit(CUT))).otherwise(F.col("source")).alias("source"), F.when(long, F.lit(most).cast("long")).otherwise(F.col("tokens")).alias("tokens"),
    )


def parse_answer(answer: Column) -> Column:
    """struct(summary, score): the stated confidence, 0.5 without one, and the text without it."""
    stated = F.regexp_extract(answer, r"CONFIDENCE:\s*(\d+(?:\.\d*)?|\.\d+)", 1).try_cast("double")
    score = F.when(stated.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), stated)))
    return F.struct(F.regexp_replace(F.regexp_replace(answer, r"\n?CONFIDENCE:\s*[\d.]+\s*$", ""), r"^\s+|\s+$", "").alias("summary"), score.alias("score"))


def checked_score(content: Column, name: Column, lines: Column, score: Column) -> Column:
    """The score after the checks for short, vague and off-topic answers."""
    low = F.when((F.char_length(content) < 20) & (lines > 50), F.least(score, F.lit(0.3))).otherwise(score)
    vague = content.rlike(VAGUE[0]) | content.rlike(VAGUE[1])
    low = F.when(vague, F.least(low, F.lit(0.3))).otherwise(low)
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z]{4,}"), F.lit(0))
    keys = F.array(*map(F.lit, KEY_TERMS))
    told = F.filter(words, lambda w: F.exists(keys, lambda k: F.contains(w, k)))
    missing = (F.size(told) > 0) & F.forall(told, lambda w: ~F.contains(F.lower(content), w))
    return F.when(missing, F.greatest(F.lit(0.0), low - 0.2)).otherwise(low)


def quality_gate(summaries: DataFrame, least: float = DEMOTED) -> DataFrame:
    """Summaries that are good enough to be embedded."""
    return summaries.where(F.coalesce("quality_score", F.lit(0.0)) >= least)


def extractive_summariser(prompt: str) -> tuple[str, float]:
    """The offline default: the prompt's first line that says something; costs nothing."""
    line = next((x.strip() for x in prompt.split("\n") if len(x.strip()) >= 20), prompt.strip())
    return f"{line[:300]}\nCONFIDENCE: 0.6", 0.0


def split_batch_answer(answer: Column, paths: Column) -> Column:
    """array of one text for each of the paths: what an answer to a batch says between its markers."""
    def part(path: Column, i: Column) -> Column:
        at = F.instr(answer, path)
        rest = F.substring(answer, at, F.char_length(answer))
        line = F.instr(rest, "\n")
        body = F.substring(rest, line + 1, F.char_length(rest))
        following = F.get(paths, i + 1)
        stop = F.when(following.isNotNull(), F.instr(body, following)).otherwise(F.lit(0))
        # the line that names the next path is the next part's
        own = F.when(stop > 0, F.regexp_replace(F.substring(body, F.lit(1), stop - 1), r"(^|\n)[^\n]*\z", "")).otherwise(body)
        return F.when((at == 0) | (line == 0), F.lit("")).otherwise(F.regexp_replace(own, r"^\s+|\s+$", ""))

    return F.transform(paths, part)


PLAN = "struct<title:string,summary:string,nonGoals:array<string>,acceptanceCriteria:array<string>,risks:array<struct<risk:string,severity:string,mitigation:string>>,phases:array<struct<title:string,intent:string,milestones:array<struct<title:string,details:string,filePaths:array<string>>>>>>"


def parse_plan(answer: Column) -> Column:
    """A plan from an answer's JSON, with defaults for what is missing; null without phases."""
    none = F.array().cast("array<string>")

    def told(p: Column) -> Column:
        risks = F.coalesce(F.transform(p["risks"], lambda r: F.struct(F.coalesce(r["risk"], F.lit("")).alias("risk"), F.coalesce(r["severity"], F.lit("medium")).alias("severity"), F.coalesce(r["mitigation"], F.lit("")).alias("mitigation"))), F.array().cast("array<struct<risk:string,severity:string,mitigation:string>>"))
        return F.when(F.size(p["phases"]) > 0, F.struct(
            F.coalesce(p["title"], F.lit("Untitled Plan")).alias("title"), F.coalesce(p["summary"], F.lit("")).alias("summary"), F.coalesce(p["nonGoals"], none).alias("non_goals"),
            F.coalesce(p["acceptanceCriteria"], none).alias("acceptance_criteria"), risks.alias("risks"),
            F.transform(p["phases"], lambda x, i: F.struct(F.coalesce(x["title"], F.concat(F.lit("Phase "), (i + 1).cast("string"))).alias("title"), F.coalesce(x["intent"], F.lit("")).alias("intent"), x["milestones"].alias("milestones"))).alias("phases"),
        ))

    return _once(F.from_json(json_in(answer), PLAN), told)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often and in whatever branches it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def json_in(answer: Column) -> Column:
    """The JSON value in an answer, whose fences and surrounding words are left out.

    A fenced value is the text between fences.  Else the value runs from the first opening bracket to the one that
    closes it: the depth is a running fold over brackets, strings and escapes, in which brackets in
    strings don't count.  An answer without brackets, or whose first is not closed, is returned as it is.
    """
    fenced = F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    # only what can change the depth: escaped pairs, quotes and brackets, each with the text before it
    marks = F.regexp_extract_all(answer, F.lit(r'(?s)[^"\\{}\[\]]*(?:\\.|["{}\[\]\\])'), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(s: Column, m: Column) -> Column:
        mark, end = F.right(m, F.lit(1)), s["at"] + F.char_length(m)
        pair = (F.char_length(m) > 1) & (F.substring(m, -2, 1) == "\\")
        open_, close = mark.isin("{", "[") & ~pair & ~s["quoted"], mark.isin("}", "]") & ~pair & ~s["quoted"] & (s["depth"] > 0)
        depth = s["depth"] + F.when(open_, 1).when(close, -1).otherwise(0)
        started = s["first"] > 0
        moved = F.struct(
            end.alias("at"), depth.alias("depth"), F.when((mark == '"') & ~pair & started, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            F.when(~started & open_, end).otherwise(s["first"]).alias("first"), F.when(close & (depth == 0), end).otherwise(s["last"]).alias("last"),
        )
        return F.when(s["last"] > 0, s).otherwise(moved)

    bare = _once(F.aggregate(marks, zero, step), lambda s: F.when(s["last"] > 0, F.substring(answer, s["first"], s["last"] - s["first"] + 1)))
    return F.coalesce(fenced, bare, answer)


def mostly_empty(plans: DataFrame, least: int = 30) -> DataFrame:
    """(plan_id, empty): whether over half of a plan's milestones have details shorter than ``least``."""
    short = F.char_length(F.coalesce("details", F.lit(""))) < least
    return plans.groupBy("plan_id").agg((F.count_if(short) > F.count("*") / 2).alias("empty"))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Dollars of a call from its tokens and prices a million (M-cost)."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1_000_000, 6)
