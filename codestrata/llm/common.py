"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: texts may be long, so a Python worker holds few of them at once.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


_ASCII, _ALNUM = re.compile("[a-z]+"), re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _odd_numbers() -> tuple[re.Pattern, dict[int, str]]:
    """Numbers that count as alphanumeric but are no letters, such as superscripts and circled digits.

    The pattern finds those of the basic plane, and any character beyond it; the table makes them blanks.
    """
    numbers = [c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
    low = "".join(c for c in numbers if c <= "\uffff")
    return re.compile(f"[{low}\U00010000-\U0010ffff]"), dict.fromkeys(map(ord, numbers), " ")


def letter_runs(text: str | None) -> list[str]:
    """Runs of letters (general category L) of a text in lower case."""
    low = (text or "").lower()
    if low.isascii():
        return _ASCII.findall(low)
    odd, blank = _odd_numbers()
    return _ALNUM.findall(low.translate(blank) if odd.search(low) else low)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only on a local master that names none, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codestrata-checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends and a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the Arrow batches of the session; a bound that the caller has set stays.

    A table of fewer files than there are cores is dealt out, so that Python does not run in one task
    (a file of one row group is never split); any larger table is not shuffled.
    """
    spark = df.sparkSession
    settings = spark._jsparkSession.sessionState().conf()
    for key, value in ARROW.items():
        if not settings.contains(key):
            spark.conf.set(key, value)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df._jdf.inputFiles()) < cores else df


def release_tokens() -> None:
    """Empties the token cache that an earlier stage left in this Python worker, which Spark reuses."""
    if (bpe := sys.modules.get("codestrata.llm.bpe")) is not None and bpe.vocabulary.cache_info().currsize:
        bpe.vocabulary.cache_clear()
        gc.collect()


def unit_hash(*cols: Column, salt: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(1 << 24)) / F.lit(float(1 << 24))


def bounded_sample(df: DataFrame, key: str, bound: int, stratum: str | None = None, total: int | None = None) -> DataFrame:
    """About ``bound`` rows (of each stratum), or all of them where there are fewer, chosen by a hash of ``key``.

    The row count is read first (column-pruned), so the expected size does not grow with the input;
    ``total`` bounds the sum over strata, whose number may grow.
    """
    u = unit_hash(F.col(key), salt=17)
    if stratum is None:
        n = df.select(key).count()
        return df if n <= bound else df.where(u < bound / n)
    counts = {r[0]: r[1] for r in df.groupBy(stratum).count().collect() if r[0] is not None}
    if total is not None:
        bound = min(bound, max(1, total // max(1, len(counts))))
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(stratum) == F.lit(value), F.lit(min(1.0, bound / n))).otherwise(share)
    return df.where(u < share)


def not_held_out(doc_id: Column, folds: int, held: int) -> Column:
    """True for rows that may be learned from: crc32 of the id as text, modulo ``folds``, is not ``held``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) != F.lit(held)
