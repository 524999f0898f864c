"""Tumbling buckets, modes and last-in-bucket, all as hash aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_bucket(df: DataFrame, ts: str = "snapshot_time", width: str = "15 minutes",
                start: str = "bucket_start", day: str | None = "gold_date") -> DataFrame:
    """Add the start of the tumbling window (and its date); null times drop out."""
    out = df.withColumn(start, F.window(F.col(ts), width).start)
    return out.withColumn(day, F.to_date(start)) if day else out


def truncate_hour(df: DataFrame, ts: str = "snapshot_time", name: str = "hour_ts") -> DataFrame:
    """Add the hour; rows with a null time stay."""
    return df.withColumn(name, F.date_trunc("hour", F.col(ts)))


def mode_in_group(df: DataFrame, keys: Sequence[str], column: str, name: str | None = None) -> DataFrame:
    """Mode per group for a column of any cardinality.

    Counts are aggregated per (group, value) before the shuffle, then the best
    (count, smallest value) is kept, so no task ever holds a whole group.
    """
    counts = df.groupBy(*keys, column).agg(F.count(column).alias("_n"))
    best_first = F.when(F.col(column).isNotNull(), F.struct(-F.col("_n"), F.col(column)))
    return counts.groupBy(*keys).agg(F.min_by(column, best_first).alias(name or f"mode_{column}"))


def last_in_bucket(df: DataFrame, keys: Sequence[str], bucket: str, value: str, order: Sequence[str],
                   name: str | None = None) -> DataFrame:
    """Value of the row with the highest order key in each bucket."""
    rank = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys, bucket).agg(F.max_by(value, rank).alias(name or f"last_{value}"))
