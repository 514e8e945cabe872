"""Helpers used by several corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, written  # noqa: F401

#: A table of at most this many narrow rows may be broadcast; above it the
#: operators take a shuffle join instead.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of one Arrow batch of documents, for sessions that have not chosen their own number.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Fewer rows per Arrow batch: documents are long, and a Python worker holds a batch in several forms."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) == 10_000:  # Spark's default
        spark.conf.set(setting, str(BATCH_ROWS))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z that never turns another letter into an ASCII one.

    lower() maps only U+212A to an ASCII letter, so that sign is set aside first.
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))


def rolling_hashes(hashes: Column, k: int) -> Column:
    """64-bit hashes of all runs of k neighbours in an array of word hashes."""
    starts = F.when(F.size(hashes) >= k, F.sequence(F.lit(0), F.size(hashes) - k)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
