"""Reading the tables of a data directory, and their documented cleaning rules as declarative plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``directory/name.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def distinct_by(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each non-null ``key``: rows delivered again are counted once.

    Deliveries of one key agree in all columns but the time of delivery, so any of them may stay; the
    choice is made by the map side before the shuffle. Rows without a key are not rows of anything and go.
    """
    return df.where(F.col(key).isNotNull()).select(key, *columns).dropDuplicates([key])


def latest_by(df: DataFrame, key: str, time: str, *columns: str) -> DataFrame:
    """The newest row of each non-null ``key``; of equal times the greatest row by the other columns, so
    the result doesn't depend on file order. A null time is older than any other."""
    newest = F.max(F.struct(F.col(time), *[F.col(c) for c in columns])).alias("newest")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, *[F.col(f"newest.{c}") for c in columns])


def current_transcripts(spark: SparkSession, directory: str) -> DataFrame:
    """One row per transcript: the one with the latest ``created_at`` holds."""
    t = table(spark, directory, "transcripts")
    return latest_by(t, "transcript_id", "created_at", "source_key", "language", "method")
