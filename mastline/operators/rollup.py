"""Two-step aggregation for groups that need both means and modes.

Spark's fast hash aggregate only keeps fixed-width buffers; a mode, or the
maximum of a text, makes it sort the raw rows instead. So labels become
grouping columns of a first, purely numeric aggregate, which combines before
the shuffle and leaves one row per combination of labels; modes and text
maxima are then taken over those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduce_rows(rows: DataFrame, keys: Sequence[str], labels: Sequence[str], numbers: Sequence[str] = (),
                peaks: Sequence[str] = (), firsts: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, labels) with sums and counts of ``numbers``, maxima of
    ``peaks`` and minima of ``firsts``.

    The result is not spread anew: rows that lie by some of the keys, as
    snapshots lie by site, need no shuffle here, nor for later steps on those keys.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in numbers:
        aggs += [F.sum(c).alias(f"_sum_{c}"), F.count(c).alias(f"_cnt_{c}")]
    aggs += [F.max(c).alias(f"_max_{c}") for c in peaks]
    aggs += [F.min(c).alias(f"_min_{c}") for c in firsts]
    unique = list(dict.fromkeys([*keys, *labels]))
    reduced = rows.groupBy(*unique).agg(*aggs)
    # Modes read these copies, as their results may bear the labels' own names.
    return reduced.withColumns({f"_of_{c}": F.col(c) for c in labels})


def mean_of(c: str) -> Column:
    return F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_cnt_{c}"))


def sum_of(c: str) -> Column:
    return F.sum(f"_sum_{c}")


def peak_of(c: str) -> Column:
    return F.max(f"_max_{c}")


def mode_of(label: str, labels: Sequence[str] | None = None) -> Column:
    """Most frequent non-null label, smallest on ties.

    Works on reduced rows, so the list holds one entry per combination of
    labels in the group, not one per reading. Modes of one aggregation should
    name the same ``labels``: they then share a single list.
    """
    seen = F.collect_list(F.struct(*[F.col(f"_of_{c}") for c in (labels or [label])], F.col("_n").alias("n")))
    of = f"_of_{label}"
    values = F.array_distinct(F.filter(F.transform(seen, lambda s: s[of]), lambda v: v.isNotNull()))
    votes = F.transform(values, lambda v: F.struct(
        (-F.aggregate(seen, F.lit(0).cast("long"),
                      lambda acc, s: acc + F.when(s[of] == v, s["n"]).otherwise(0))).alias("n"),
        v.alias("v")))
    # Most groups hold one value only, which needs no counting.
    return F.when(F.size(values) <= 1, F.get(values, 0)).otherwise(F.array_min(votes)["v"])


def earliest_of(value: str, by: str) -> Column:
    """Value of the combination seen first (smallest value on equal times)."""
    return F.min_by(value, F.struct(F.col(f"_min_{by}"), F.col(value)))
