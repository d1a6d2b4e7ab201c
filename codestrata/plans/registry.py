"""The registry of queries: a name maps to (function of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, oracle)
        return f
    return register
