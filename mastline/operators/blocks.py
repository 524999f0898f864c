"""Ordered per-key computations that survive a hot key.

A window partitioned by key sorts the whole key in one task. Here the key's
series is cut into blocks of a fixed number of rows instead:

1. ``with_positions`` gives every row its position in the series. Rows are
   ranked inside (key, time chunk) and shifted by the number of rows in earlier
   chunks, which comes from a small per-chunk count table.
2. ``blocked`` sends each row to its block, and the last ``lookback`` rows of a
   block also to the next one, so any backward-looking frame up to that length
   sees all the rows it needs.
3. Forward-looking needs (the next known value) and whole-series totals come
   from one summary row per block.

The results equal those of plain windows; only the grouping differs. A chunk is
either a span of time, right where one key's rows in one span fit a task, or a
range of ``range_cut``, which cuts a key that is hot inside one span as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastline.session import scratch_path

RANGE = "_range"


def range_cut(df: DataFrame, order: Sequence[str | Column], ranges: int | None = None) -> DataFrame:
    """``df`` with a range number that rises with ``order`` (nulls first).

    Spark samples the order for cuts of about equal numbers of rows, so a range's
    size depends on neither keys nor times. The rows are written once: the cuts
    are the same for all who read them, and for tasks that are run again; in order,
    so that like rows lie side by side and later shuffles of them compress well. Rows
    equal in all of ``order`` stay together; end it with something that tells
    them apart. Without ``ranges`` there are as many as shuffle partitions.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranges")
    cut = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(RANGE, F.spark_partition_id())
    cut.write.parquet(path)
    return spark.read.schema(cut.schema).parquet(path)


def plain_keys(df: DataFrame, keys: Sequence[str], prefix: str = "_key") -> tuple[DataFrame, list[str]]:
    """Null-free stand-ins for ``keys``: per key a value and an is-null flag.

    Aggregates, windows and joins over the stand-ins treat nulls as one value
    and compare with plain equality, so they share one hash partitioning.
    """
    blank = {"string": F.lit(""), "boolean": F.lit(False), "date": F.lit("1970-01-01").cast("date"),
             "timestamp": F.lit(0).cast("timestamp"), "timestamp_ntz": F.lit("1970-01-01").cast("timestamp_ntz")}
    made: dict[str, Column] = {}
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType.simpleString()
        made[f"{prefix}{i}"] = F.coalesce(F.col(f"`{k}`"), blank.get(kind, F.lit(0)).cast(kind))
        made[f"{prefix}{i}_null"] = F.col(f"`{k}`").isNull()
    return df.withColumns(made), list(made)


def chunk_of(ts: str, unit: str = "day") -> Column:
    return F.date_trunc(unit, F.col(ts))


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                   name: str = "_pos", total: str | None = None) -> DataFrame:
    """Add each row's 1-based position in its key's order.

    ``chunk`` must rise with the first order column; a null chunk sorts first,
    as nulls do in the order itself. Keys and chunk may be null: both sides of
    the inner join use their null-free stand-ins.
    """
    tagged, plain = plain_keys(df.withColumn("_chunk", chunk), [*keys, "_chunk"])
    series = plain[:-2]
    counts = tagged.groupBy(*plain).agg(F.count(F.lit(1)).alias("_n"))
    chunk_order = [F.desc(plain[-1]), F.col(plain[-2])]
    earlier = Window.partitionBy(*series).orderBy(*chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*series)
    offsets = counts.select(
        *plain, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(everything).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*plain).orderBy(*order)
    ranked = tagged.withColumn("_rank", F.row_number().over(inside))
    placed = ranked.join(offsets, plain)
    return placed.withColumn(name, F.col("_before") + F.col("_rank")).drop("_chunk", "_rank", "_before", *plain)


def blocked(positioned: DataFrame, block_rows: int, lookback: int, pos: str = "_pos") -> DataFrame:
    """Add ``_block`` and ``_home``; border rows appear a second time as context."""
    if lookback > block_rows:
        raise ValueError("a block must hold at least the look-back rows")
    block = F.floor((F.col(pos) - 1) / block_rows)
    row_in_block = F.pmod(F.col(pos) - 1, F.lit(block_rows))
    home = F.struct(block.alias("_block"), F.lit(True).alias("_home"))
    context = F.struct((block + 1).alias("_block"), F.lit(False).alias("_home"))
    homes = F.when(row_in_block >= block_rows - lookback, F.array(home, context)).otherwise(F.array(home))
    return positioned.select("*", F.explode(homes).alias("_at")).select(
        *positioned.columns, "_at._block", "_at._home")


def block_window(keys: Sequence[str], pos: str = "_pos"):
    return Window.partitionBy(*keys, "_block").orderBy(pos)


def carry_between_chunks(df: DataFrame, keys: Sequence[str], chunk: str, value: Column,
                         order: Column, name: str) -> DataFrame:
    """Per (key, chunk): the newest non-null ``value`` of all earlier chunks."""
    last = df.groupBy(*keys, chunk).agg(
        F.max_by(value, F.when(value.isNotNull(), order)).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return last.select(*keys, chunk, F.last("_last", ignorenulls=True).over(earlier).alias(name))


def following_chunk(df: DataFrame, keys: Sequence[str], chunk: str, value: Column, order: Column, name: str) -> DataFrame:
    """Per (key, chunk): the first non-null ``value`` of all later chunks."""
    first = df.groupBy(*keys, chunk).agg(F.min_by(value, F.when(value.isNotNull(), order)).alias("_first"))
    later = Window.partitionBy(*keys).orderBy(F.desc(chunk)).rowsBetween(Window.unboundedPreceding, -1)
    return first.select(*keys, chunk, F.last("_first", ignorenulls=True).over(later).alias(name))
