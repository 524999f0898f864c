"""Slot numbering and slot pivot.

Components of a group are numbered by id, then laid out as columns. The input
must already hold one row per (group, component): raw readings are aggregated
first, so the window sorts a handful of components. A wide row has a fixed
number of slots; components beyond them are counted there and kept, row by
row, in the long companion table of ``surplus_rows``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_slots(components: DataFrame, group: Sequence[str], component: str, name: str = "slot") -> DataFrame:
    """Components of each group, numbered from 1 by id."""
    return components.withColumn(name, F.dense_rank().over(Window.partitionBy(*group).orderBy(component)))


def surplus_rows(components: DataFrame, group: Sequence[str], component: str, slots: int,
                 name: str = "slot") -> DataFrame:
    """The components that found no slot, one row each with their number."""
    return number_slots(components, group, component, name).where(F.col(name) > slots)


def slot_columns(slots: int, columns: Mapping[str, str], slot: str = "slot") -> list[Column]:
    """``max`` per slot and column; ``columns`` maps a "{slot}" name pattern to a column."""
    return [
        F.max(F.when(F.col(slot) == i, F.col(source))).alias(pattern.format(slot=i))
        for i in range(1, slots + 1)
        for pattern, source in columns.items()
    ]


def slot_pivot(components: DataFrame, group: Sequence[str], component: str, slots: int,
               columns: Mapping[str, str], surplus: str | None = None) -> DataFrame:
    """One wide row per group with every column repeated for each slot, and the
    number of components without a slot under the name ``surplus``.

    The pivot aggregates on the window's own keys: numbering and pivot share
    a single shuffle.
    """
    numbered = number_slots(components, group, component)
    if surplus is None:  # nobody asks for the rest: a group limit stops it before the shuffle
        numbered = numbered.where(F.col("slot") <= slots)
    beyond = [F.greatest(F.max("slot") - slots, F.lit(0)).cast("long").alias(surplus)] if surplus else []
    return numbered.groupBy(*group).agg(*slot_columns(slots, columns), *beyond)
