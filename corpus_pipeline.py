"""A training-data pipeline over ``documents``: five stages, each read from the Parquet of the one before.

Stages keep what is clean: quality rejects junk, language ID rejects texts without a recognisable
language, near-dedup keeps one document of each class of texts whose five-word shingles are similar by 0.8
or more, decontamination drops documents that contain a benchmark item, and the last stage returns the
token ids' digests of what is left.  Rows that share an id are judged by their texts; null ids are kept;
an empty table passes through as one.  Folders of a run stay for its reader, named by the run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import decontam, langid, quality, simhash
from codestrata.llm.common import shared_folder, table
from codestrata.llm.queries import KEEP_QUALITY, token_digests

#: A text goes if its best language has less than this share of the posterior.
KEEP_LANGUAGE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("__quality") >= KEEP_QUALITY).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(docs, langid.fit(docs))
    return found.where((F.col("__lang.lang_pred") != "und") & (F.col("__lang.score") >= KEEP_LANGUAGE)).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("simhash_near_dedup", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each writes Parquet to the shared folder and the next one reads it."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
