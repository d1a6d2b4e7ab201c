"""Keyed snapshot merges: each returns the new snapshot, nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group under ``order``."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def upsert_keep_last(old: DataFrame, new: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    """New rows replace old ones of their key; among new rows of a key the last wins (B1, B2)."""
    last = latest_per_group(new, keys, [F.col(ord_col).desc()]).drop(ord_col)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    """Only rows whose key is new, the first of each key."""
    return latest_per_group(new.join(old.select(*keys), keys, "left_anti"), keys, [F.col(ord_col).asc()]).drop(ord_col)


def replace_by_parent(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All old rows of the parents that occur in ``new`` go, the new rows come."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_project(old: DataFrame, project) -> DataFrame:
    """Rows of other projects."""
    return old.where(~F.col("project_id").eqNullSafe(F.lit(project)))


def update_column(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """One column updated by key, to null as well; unmatched rows stay as they are."""
    n = latest_per_group(new, [key], [F.col(column).desc_nulls_last()]).select(key, F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    return old.join(n, key, "left").withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__hit").select(*old.columns)


def latest_request(requests: DataFrame) -> DataFrame:
    """The latest reindex request of each project."""
    return requests.groupBy("project_id").agg(F.max_by("layers", "requested_at").alias("layers"), F.max("requested_at").alias("requested_at"))
