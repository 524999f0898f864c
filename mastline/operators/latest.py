"""Latest state per key and data-clock filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_by_pattern(df: DataFrame, keys: Sequence[str], order: Column, name: str = "_row") -> DataFrame:
    """Per key, and per pattern of known columns, the newest row as a struct of its
    order ``_o`` and its columns.

    The newest known value of any column is in one of these rows, and they are few:
    an aggregate of each column on its own then need not see every reading, which
    costs a comparison a reading and column.
    """
    rest = [c for c in df.columns if c not in keys]
    # Whole numbers of up to 62 flags: groups compare by few of them.
    known = [sum((F.when(F.col(f"`{c}`").isNotNull(), 1 << i).otherwise(0).cast("long") for i, c in enumerate(rest[k:k + 62])), F.lit(0)).alias(f"_known{k}")
             for k in range(0, len(rest), 62)]
    row = F.struct(order.alias("_o"), *[F.col(f"`{c}`") for c in rest])
    flags = [f"_known{k}" for k in range(0, len(rest), 62)]
    return df.select("*", *known).groupBy(*keys, *flags).agg(F.max_by(row, order).alias(name)).drop(*flags)


def latest_snapshot(df: DataFrame, keys: Sequence[str], ts: str = "ingested_at",
                    mode: str = "per_column", tie: Sequence[str] = ()) -> DataFrame:
    """Newest state per key, as a mergeable aggregate (no sort, no window).

    ``per_column`` takes the last non-null value of every column on its own;
    ``whole_row`` takes the newest row as it is. A null time sorts last, so it
    counts as newest; rows with a null key are dropped.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(ts).isNull(), F.col(ts), *[F.col(t) for t in tie])
    known = df.dropna(subset=list(keys))
    if mode == "whole_row":
        row = F.max_by(F.struct(*[F.col(c) for c in rest]), order)
        return known.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*df.columns)
    if mode != "per_column":
        raise ValueError(f"unknown mode: {mode}")
    picks = [
        # A null order value is skipped by max_by, and with it the null reading.
        F.max_by(F.col(f"_row.{c}"), F.when(F.col(f"_row.{c}").isNotNull(), F.col("_row._o"))).alias(c)
        for c in rest
    ]
    return newest_by_pattern(known, keys, order).groupBy(*keys).agg(*picks).select(*df.columns)


def last_span(df: DataFrame, ts: str = "ingested_at", span: str = "1 hour") -> DataFrame:
    """Rows within ``span`` of the newest row, by the data's own clock.

    The newest time is a scalar subquery; when no row has a time, all stay.
    """
    newest = df.agg(F.max(ts).alias("newest")).scalar()
    return df.where(newest.isNull() | (F.col(ts) >= newest - F.expr(f"interval {span}")))
