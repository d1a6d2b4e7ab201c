"""Source trees as DataFrames (A1-A4, C11)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as T


@dataclass
class ScanConfig:
    """Fixed defaults: what a scan skips, and the largest file in bytes."""

    skip: list[str] = field(default_factory=lambda: "node_modules/** **/node_modules/** .git/** dist/** **/dist/** build/** vendor/** **/*.min.js **/*.min.css *.lock *.map".split())
    max_bytes: int = 1 << 20


def scan(spark: SparkSession, root: str, config: ScanConfig | None = None) -> DataFrame:
    """Files below ``root``: path, content, language, size_bytes, line_count, content_hash and kind flags.

    Size is filtered before contents are read into rows; skip patterns are one expression.  Spark's file
    sources do not list files of zero bytes, so those are absent.
    """
    config = config or ScanConfig()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= config.max_bytes)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    path = F.substring(F.regexp_replace("path", "^file:/*", "/"), F.char_length(base) + 2, F.lit(1 << 20))
    files = raw.select(path.alias("path"), "length", "content")
    for pattern in config.skip:
        files = files.where(~F.col("path").rlike(T.glob_regex(pattern)))
    text = F.decode("content", "utf-8")
    files = files.select("path", text.alias("content"), T.language(F.col("path")).alias("language"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"))
    return files.withColumn("line_count", F.size(F.split("content", "\n", -1))).select("*", T.file_flags(F.col("path")).alias("f")).select("*", "f.*").drop("f")
