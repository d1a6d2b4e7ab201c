"""Column functions over paths, documents and messages."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Languages by extension.
LANGUAGES = {".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".cs": "c_sharp"}


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob: ``**`` crosses directories, ``*`` and ``?`` don't (A2)."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]", ".": r"\."}.get(c, c), i + 1
    return f"^{out}$"


def language(path: Column) -> Column:
    """Language by extension, else null (A4)."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, F.lit(name)).otherwise(out)
    return out


def is_doc(path: Column) -> Column:
    """Documents by extension or by the name of the file."""
    name = F.lower(F.substring_index(path, "/", -1))
    own = name.rlike(r"^(readme|changelog|contributing)(\.(md|rst|txt|adoc))?$|^(license|code_of_conduct|security|architecture|design)(\.(md|txt))?$|\.(md|rst|adoc)$")
    return own | (path.rlike(r"(^|/)docs?/") & name.rlike(r"\.(md|rst|txt|adoc)$"))


def is_test(path: Column) -> Column:
    """Paths of tests, in the case they are written."""
    return path.rlike(r"\.(test|spec)\.|__tests__|/test/|/tests/|_test\.(py|go)$")


# Endings and parts of lower-case paths by which the index flags files.
DOC_ENDS, DOC_PARTS = (".md", ".rst", ".txt", ".adoc"), ("readme", "changelog", "contributing")
TEST_ENDS, TEST_PARTS = ("_test.py", "_test.go"), (".test.", ".spec.", "__tests__", "/test/", "/tests/")
CONFIG_ENDS, CONFIG_PARTS = (".json", ".yaml", ".yml", ".toml", ".ini", ".env", ".config.js", ".config.ts"), ("tsconfig", "package.json")


def file_flags(path: Column) -> Column:
    """struct(is_doc, is_test, is_config) of an indexed path, in any case of letters (C11).

    These are the flags of the file table; :func:`is_doc` chooses what the documentation layer reads, and
    :func:`is_test` what ranking lowers.
    """
    low = F.lower(path)

    def flag(ends: tuple[str, ...], parts: tuple[str, ...]) -> Column:
        tests = [low.endswith(e) for e in ends] + [F.contains(low, F.lit(p)) for p in parts]
        return reduce(lambda a, b: a | b, tests)

    return F.struct(flag(DOC_ENDS, DOC_PARTS).alias("is_doc"), flag(TEST_ENDS, TEST_PARTS).alias("is_test"), flag(CONFIG_ENDS, CONFIG_PARTS).alias("is_config"))


def commit_tickets(message: Column) -> Column:
    """Distinct ticket ids of a message, in order."""
    return F.array_distinct(F.regexp_extract_all(message, F.lit(r"\b([A-Z]{2,10}-\d+|AB#\d+)\b"), 1))


def commit_issues(message: Column) -> Column:
    """Distinct issue numbers of a message, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(message, F.lit(r"#(\d+)"), 1), lambda x: x.cast("long")))


def markdown_sections(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, section, heading, level, content): headings open sections, text before the first is dropped; a text
    without headings is one section of level 0 (K14).

    The lines of a document stay one array; only its sections become rows.
    """
    lines = F.split(F.col(text), "\n")
    at = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(r"^#{1,6}\s+.+$"), i)), lambda i: i.isNotNull())
    rows = docs.where(F.col(text).isNotNull()).select(doc, lines.alias("lines"), at.alias("at"))
    bare = F.regexp_replace(F.array_join("lines", "\n"), r"^\s+|\s+$", "")
    whole = rows.where(F.size("at") == 0).select(doc, F.lit(0).cast("long").alias("section"), F.lit("").alias("heading"), F.lit(0).cast("long").alias("level"), bare.alias("content")).where("content <> ''")
    rows = rows.select(doc, "lines", F.size("lines").alias("n"), F.posexplode("at").alias("section", "i"), "at")
    stop = F.coalesce(F.get("at", F.col("section") + 1), F.col("n"))
    head = F.get("lines", F.col("i"))
    body = F.slice("lines", F.col("i") + 2, stop - F.col("i") - 1)
    return whole.unionByName(rows.select(doc, F.col("section").cast("long").alias("section"), F.trim(F.regexp_extract(head, r"^#{1,6}\s+(.+)$", 1)).alias("heading"), F.char_length(F.regexp_extract(head, r"^(#{1,6})\s", 1)).cast("long").alias("level"), F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+$", "").alias("content")))


def document_chunks(docs: DataFrame, doc: str = "doc", text: str = "text", most: int = 12_000) -> DataFrame:
    """(doc, chunk, heading, heading_path, content): second-level headings open chunks, third-level ones only
    once the chunk is longer than ``most`` characters (K18).

    The fold runs over the blocks between headings, in one expression; null text has no chunks.
    """
    none = F.lit("")
    path = lambda s: F.when((s["h2"] != "") & (s["h3"] != ""), F.concat(s["h2"], F.lit(" > "), s["h3"])).when(s["h2"] != "", s["h2"]).otherwise(F.lit("Introduction"))
    name = lambda s: F.when(s["h3"] != "", s["h3"]).when(s["h2"] != "", s["h2"]).otherwise(F.lit("Introduction"))
    closed = lambda s: F.concat(s["done"], F.array(F.struct(name(s).alias("heading"), path(s).alias("heading_path"), s["open"].alias("content"))))

    def step(s: Column, block: Column) -> Column:
        second, third = F.startswith(block, F.lit("## ")), F.startswith(block, F.lit("### "))
        opens = second | (third & (F.coalesce(F.char_length(s["open"]), F.lit(0)) > most))
        title = F.trim(F.regexp_extract(block, r"^#+ ([^\n]*)", 1))
        return F.struct(
            F.when(opens & s["open"].isNotNull(), closed(s)).otherwise(s["done"]).alias("done"),
            F.when(second, title).otherwise(s["h2"]).alias("h2"),
            F.when(second, none).when(opens, title).otherwise(s["h3"]).alias("h3"),
            F.when(opens | s["open"].isNull(), block).otherwise(F.concat(s["open"], F.lit("\n"), block)).alias("open"),
        )

    start = F.struct(F.from_json(F.lit("[]"), "array<struct<heading:string,heading_path:string,content:string>>").alias("done"), none.alias("h2"), none.alias("h3"), F.lit(None).cast("string").alias("open"))
    chunks = F.aggregate(F.split(F.col(text), r"\n(?=###? )"), start, step, closed)
    return docs.select(doc, F.posexplode(chunks).alias("chunk", "c")).select(doc, F.col("chunk").cast("long").alias("chunk"), "c.heading", "c.heading_path", "c.content")


def mentions(text: Column) -> Column:
    """Distinct file names of a task text: back-ticked ones, then bare words with an extension."""
    ticked = F.regexp_extract_all(text, F.lit(r"`([^`]+\.[a-zA-Z]+)`"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"(?:^|\s)([\w./-]+/[\w./-]+|[\w-]+\.\w{1,10})(?=\s|$|[,;:!?)}\]])"), F.lit(1))
    return F.array_distinct(F.concat(ticked, F.filter(bare, lambda m: m.rlike(r"\.[a-zA-Z]{1,10}$") & ~m.rlike(r"^\d+\.\d+"))))


def slugify(text: Column) -> Column:
    """Lower case, other characters to dashes, 50 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 50)


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``{{name}}`` replaced by columns; ``{{#if name}}...{{/if}}`` kept where the value isn't empty."""
    import re

    def plain(part: str) -> list[Column]:
        bits = re.split(r"\{\{(\w+)\}\}", part)
        return [F.lit(b) if i % 2 == 0 else F.coalesce(values.get(b, F.lit("")).cast("string"), F.lit("")) for i, b in enumerate(bits)]

    out: list[Column] = []
    bits = re.split(r"\{\{#if (\w+)\}\}(.*?)\{\{/if\}\}", template, flags=re.S)
    for i in range(0, len(bits), 3):
        out += plain(bits[i])
        if i + 2 < len(bits):
            v = F.coalesce(values.get(bits[i + 1], F.lit("")).cast("string"), F.lit(""))
            out.append(F.when(v != "", F.concat(*plain(bits[i + 2]))).otherwise(""))
    return F.concat(*out)


def balanced_json(text: str) -> str | None:
    """The first balanced JSON value of a text that parses, strings respected."""
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    depth, inside, escaped = 0, False, False
    for i in range(at, len(text)):
        c = text[i]
        if inside:
            escaped, inside = (not escaped and c == "\\"), not (c == '"' and not escaped)
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                try:
                    json.loads(text[at : i + 1])
                except ValueError:
                    return None
                return text[at : i + 1]
    return None


def symbol_context(symbols: DataFrame, most: int = 500) -> DataFrame:
    """Signatures of a file in order until the first that passes the token cap."""
    w = W.partitionBy("file_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return symbols.withColumn("used", F.sum(F.ceil(F.char_length("signature") / 4)).over(w)).where(F.col("used") <= most)
