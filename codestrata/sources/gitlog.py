"""Version-control logs as DataFrames."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks between commits and between header fields in a dumped log.
COMMIT, FIELD = "\x1ecommit\x1e", "\x1f"
FORMAT = f"{COMMIT}%H{FIELD}%an{FIELD}%ae{FIELD}%aI{FIELD}%B{FIELD}"


def dump(repo: str, most: int = 200) -> str:
    """The log of a local repository in the format that :func:`parse` reads."""
    return subprocess.run(["git", "-C", repo, "log", f"--format={FORMAT}", "--numstat", "-n", str(most)], capture_output=True, text=True, check=True).stdout


def new_path(path: Column) -> Column:
    """The path after a rename, the part before a brace kept."""
    braced = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    moved = F.when(F.contains(path, F.lit(" => ")), F.regexp_replace(braced, r"^.* => ", "")).otherwise(path)  # most paths need no pattern
    return F.when(F.contains(moved, F.lit("//")), F.regexp_replace(moved, "//+", "/")).otherwise(moved)


def parse(logs: DataFrame, text: str = "value") -> DataFrame:
    """One row for each commit: sha, author, committed_at, message and its changed files.

    Commits with fewer than five fields or a bad date are left out; a dash for a line count is null.
    """
    parts = logs.select(F.explode(F.split(text, COMMIT)).alias("c")).select(F.split("c", FIELD).alias("f")).where(F.size("f") >= 6)
    at = F.try_to_timestamp(F.get("f", F.lit(3)))
    stat = F.filter(F.split(F.element_at("f", -1), "\n"), lambda line: line.rlike(r"^(\d+|-)\t(\d+|-)\t.+$"))

    def change(cell: Column) -> Column:
        added, removed, path = cell[0].try_cast("int"), cell[1].try_cast("int"), cell[2]
        kind = F.when(F.contains(path, F.lit(" => ")), "rename").when(removed.isNull() & (added > 0), "add").otherwise("modify")
        return F.struct(new_path(path).alias("path"), kind.alias("change_type"), added.alias("lines_added"), removed.alias("lines_removed"))

    message = F.trim(F.array_join(F.slice("f", 5, F.size("f") - 5), FIELD))
    return parts.select(F.get("f", F.lit(0)).alias("sha"), F.get("f", F.lit(1)).alias("author_name"), F.get("f", F.lit(2)).alias("author_email"), at.alias("committed_at"), F.regexp_replace(message, r"^\s+|\s+$", "").alias("message"), F.transform(F.transform(stat, lambda line: F.split(line, "\t")), change).alias("files")).where("committed_at is not null")


# What a repository address may look like, and what it must not hold.
ADDRESS = r"^https://[\w.-]+(:\d+)?/[\w.~-]+(/[\w.~-]+)+?(\.git)?/?$"


def valid_address(url: Column) -> Column:
    """Whether an address is a plain HTTPS repository address without credentials."""
    return F.coalesce(url.rlike(ADDRESS), F.lit(False))


def redacted(text: Column) -> Column:
    """A log text without the credentials of addresses."""
    return F.regexp_replace(text, r"://[^/@\s]+@", "://***@")


def clone(url: str, folder: str, token: str | None = None, timeout: int = 300) -> str:
    """A shallow clone of an HTTPS repository into a folder that executors see.

    The token goes with the call only and is cut from errors; a clone that takes too long is an error.
    """
    import re

    if not re.match(ADDRESS, url):
        raise ValueError("only https addresses without credentials are cloned")
    address = url.replace("https://", f"https://x-access-token:{token}@", 1) if token else url
    try:
        done = subprocess.run(["git", "clone", "--depth", "1", address, folder], capture_output=True, text=True, timeout=timeout, env={"GIT_TERMINAL_PROMPT": "0", "PATH": "/usr/bin:/bin:/usr/local/bin"})
    except subprocess.TimeoutExpired:
        raise TimeoutError(f"clone of {url} took over {timeout} s") from None
    if done.returncode:
        raise RuntimeError(re.sub(r"://[^/@\s]+@", "://***@", done.stderr.strip()))
    return folder


def changed_paths(spark, repo: str, old: str, new: str) -> DataFrame:
    """(path) of what differs between two commits of a local repository; none if they can't be compared."""
    done = subprocess.run(["git", "-C", repo, "diff", "--name-only", f"{old}..{new}"], capture_output=True, text=True)
    paths = [(p,) for p in done.stdout.split("\n") if p] if done.returncode == 0 else []
    return spark.createDataFrame(paths, "path string")
