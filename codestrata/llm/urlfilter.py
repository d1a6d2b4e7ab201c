"""URL filters with nested prefix rules.

Method: sort-merge range join.  A rule's host is reversed label by label and its path appended,
so everything the rule covers on one host level is an interval of keys that starts at the rule's
key.  A url asks at each level of its host (``com``, ``com.example``, ...).  Questions and rules are
sorted, one sweep keeps a stack of the rules whose intervals are open, and the top of the stack is
the longest nested rule.  Among levels the longest rule text wins; block wins a tie.

Up to ``SMALL`` rules (checked by a count) go to every task and each Arrow batch is swept on its
own: no shuffle, so a hot host needs no care.  Beyond that, rules and questions are cut into key
ranges at rule quantiles, long intervals are entered in each range they cover, and each range is
dealt over salts by url, so no task gets more than a bounded share of a hot host.

Defined results: null urls and urls without ``://`` have empty host and path and match nothing;
rules with null host or path are left out; repeated rules count once; the default verdict is allow;
columns host, path, rule and verdict of the table are replaced, all others stay, repeated rows too.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, by position: after the first ``://``, up to ``/ ? #``; then up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    after = F.substring(rest, F.char_length(host) + 1, F.char_length(rest))
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(after, r"(?s)^[^?#]*", 0)


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, text) with text like ``example.com/en/``."""
    rows = [(verdict, text, text.split("/", 1)[0].lower(), "/" + text.split("/", 1)[1] if "/" in text else "") for verdict, text in rules]
    return spark.createDataFrame(rows, "verdict string, rule string, host string, path string")


def level_keys(host: str, path: str) -> list[str]:
    """The canonical key of each level of a host, outermost first."""
    labels = host.split(".")[::-1] if host else []
    return [".".join(labels[: i + 1]) + "\0" + path for i in range(len(labels))]


def _key(host: str, path: str) -> str:
    return ".".join(host.split(".")[::-1]) + "\0" + path


def sweep(keys: list[str], rules: list[tuple[str, str, str]]) -> list[int]:
    """For each of the sorted keys the index of the longest rule (sorted, key first) that is its prefix, or -1."""
    out, stack, r, n = [], [], 0, len(rules)
    for key in keys:
        while r < n and rules[r][0] <= key:
            while stack and not rules[r][0].startswith(rules[stack[-1]][0]):
                stack.pop()
            if key.startswith(rules[r][0]) or not stack or rules[r][0].startswith(rules[stack[-1]][0]):
                stack.append(r)
            r += 1
        while stack and not key.startswith(rules[stack[-1]][0]):
            stack.pop()
        out.append(stack[-1] if stack else -1)
    return out


def _prepared(rows) -> list[tuple[str, str, str]]:
    """Sorted unique (key, rule, verdict); for one key the last one is the one that wins: longest text, then block."""
    best: dict[str, tuple] = {}
    for host, path, rule, verdict in rows:
        key = _key(host, path)
        rank = (len(rule), verdict == "block", rule)
        if key not in best or rank > best[key][0]:
            best[key] = (rank, rule, verdict)
    return sorted((k, v[1], v[2]) for k, v in best.items())


def _answer(urls: list[tuple[str, str]], rules: list[tuple[str, str, str]]) -> list[tuple[str | None, str | None]]:
    asked = sorted((key, i) for i, (host, path) in enumerate(urls) for key in level_keys(host, path))
    best: list[tuple | None] = [None] * len(urls)
    for (_, i), r in zip(asked, sweep([k for k, _ in asked], rules), strict=True):
        if r >= 0:
            rank = (len(rules[r][1]), rules[r][2] == "block", rules[r][1], rules[r][2])
            if best[i] is None or rank > best[i]:
                best[i] = rank
    return [(b[2], b[3]) if b else (None, None) for b in best]


def judge(df: DataFrame, rules: DataFrame, url: str = "url", small: int = SMALL, ranges: int = 64, salts: int = 16) -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``df`` (columns of these names are replaced)."""
    host, path = split_url(F.col(url))
    named = df.withColumns({"host": host, "path": path})
    rules = rules.where("host is not null and path is not null and rule is not null").select("host", "path", "rule", "verdict").distinct()
    head = rules.limit(small + 1).collect()
    if len(head) <= small:
        found = _judge_small(named, _prepared(head))
    else:
        found = _judge_ranges(named, rules, ranges, salts)
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(DEFAULT)))


def _judge_small(named: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    @F.pandas_udf("rule string, verdict string")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            yield pd.DataFrame(_answer(list(zip(hosts, paths, strict=True)), rules), columns=["rule", "verdict"])

    others = [c for c in named.columns if c not in ("rule", "verdict")]
    found = ask("host", "path")
    return named.select(*others, found.alias("rule and verdict")).select(*others, F.col("`rule and verdict`.rule").alias("rule"), F.col("`rule and verdict`.verdict").alias("verdict"))


def _judge_ranges(named: DataFrame, rules: DataFrame, ranges: int, salts: int) -> DataFrame:
    reversed_host = F.array_join(F.reverse(F.split("host", "[.]")), ".")
    keyed = rules.withColumn("key", F.concat(reversed_host, F.lit("\0"), "path"))
    share = min(1.0, 200 * ranges / max(1, rules.count()))
    sample = sorted(r[0] for r in keyed.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)).select("key").collect())
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []

    @F.pandas_udf("array<int>")
    def covered(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: list(range(bisect_right(bounds, k), bisect_right(bounds, k + "\U0010ffff") + 1)))

    @F.pandas_udf("array<struct<part:int,key:string>>")
    def levels(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([[(bisect_right(bounds, k), k) for k in level_keys(h, p)] for h, p in zip(hosts, paths, strict=True)])

    salt = F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int")
    urls = named.select("host", "path").distinct()
    asked = urls.select("host", "path", salt.alias("salt"), F.explode(levels("host", "path")).alias("q")).select("host", "path", "salt", "q.part", "q.key")
    spread = keyed.select("key", "host", "path", "rule", "verdict", F.explode(covered("key")).alias("part")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = _prepared(zip(right["host"], right["path"], right["rule"], right["verdict"], strict=True))
        asked_for = sorted(zip(left["key"], left["host"], left["path"], strict=True))
        hit = sweep([key for key, _, _ in asked_for], own)
        return pd.DataFrame([(h, p, own[i][1], own[i][2]) for (_, h, p), i in zip(asked_for, hit, strict=True) if i >= 0], columns=["host", "path", "rule", "verdict"], dtype=object)

    hits = asked.groupBy("part", "salt").cogroup(spread.groupBy("part", "salt")).applyInPandas(merge, "host string, path string, rule string, verdict string")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("n"), (F.col("verdict") == "block").alias("block"), "rule", "verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    others = [c for c in named.columns if c not in ("rule", "verdict")]
    return named.select(*others).join(best, ["host", "path"], "left").select(*others, "rule", "verdict")
