"""Rolling statistics, lags, deltas, as-of join and gap detection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastline.operators import blocks as B

ROLL_STATS = ("mean", "std", "max", "min")


def rolling_columns(w, columns: Sequence[str], sizes: Sequence[int]) -> dict[str, Column]:
    """``{col}_roll{N}_{stat}`` over the last N rows; nulls are skipped, a
    standard deviation of fewer than two values is 0."""
    out: dict[str, Column] = {}
    for n in sizes:
        frame = w.rowsBetween(-(n - 1), Window.currentRow)
        for c in columns:
            stats = {
                "mean": F.avg(c).over(frame),
                "std": F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0)),
                "max": F.max(c).over(frame),
                "min": F.min(c).over(frame),
            }
            out.update({f"{c}_roll{n}_{stat}": stats[stat] for stat in ROLL_STATS})
    return out


def delta_columns(w, columns: Sequence[str], steps: Sequence[int]) -> dict[str, Column]:
    """``{col}_delta{k}``: change against k rows before, 0 where unknown."""
    return {
        f"{c}_delta{k}": F.coalesce(F.col(c) - F.lag(c, k).over(w), F.lit(0.0))
        for c in columns for k in steps
    }


def add_series_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    roll: Sequence[str] = (), roll_sizes: Sequence[int] = (3, 6, 12, 24),
    lag: Sequence[str] = (), lag_steps: Sequence[int] = (1, 3, 6, 12),
    delta: Sequence[str] = (), delta_steps: Sequence[int] = (1, 3),
    backfill: bool = True,
    block_rows: int | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Append rolling, lag and delta columns of each key's series.

    A lag's missing values are filled with the next known lagged value, then
    with the series mean (``backfill=False`` leaves them null).

    Without ``block_rows`` all features share one window per key: right when a
    series is bounded, such as one row per hour. With ``block_rows`` the series
    is cut into blocks (see ``blocks``), which keeps a hot key spread out. Places
    in the series come from ranges of equal size, or from ``chunk``, a column
    that rises with the order.
    """
    if block_rows is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        made = {**rolling_columns(w, roll, roll_sizes), **delta_columns(w, delta, delta_steps)}
        raw = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in lag for k in lag_steps}
        if not (backfill and raw):
            out = df.withColumns({**made, **raw})
        else:
            out = df.withColumns({**made, **raw, "_row": F.row_number().over(w)})
            whole = Window.partitionBy(*keys)
            out = out.withColumns({
                f"{c}_lag{k}": F.coalesce(next_known(f"{c}_lag{k}", keys, "_row"), F.avg(c).over(whole))
                for c in lag for k in lag_steps
            })
        return out.select(*df.columns, *feature_names(roll, roll_sizes, lag, lag_steps, delta, delta_steps))

    lookback = max([n - 1 for n in roll_sizes if roll] + [k for k in lag_steps if lag]
                   + [k for k in delta_steps if delta])
    cut = df if chunk is not None else B.range_cut(df, [*keys, *order])
    placed = B.with_positions(cut, keys, order, chunk if chunk is not None else F.col(B.RANGE))
    spread = B.blocked(placed, block_rows, lookback)
    w = B.block_window(keys)
    lags = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in lag for k in lag_steps}
    made = {**rolling_columns(w, roll, roll_sizes), **lags, **delta_columns(w, delta, delta_steps)}
    computed = spread.withColumns(made).where("_home").drop("_home")
    if backfill and lags:
        computed = _backfill_blocks(computed, keys, lag, list(lags), lag_steps)
    return computed.select(
        *df.columns, *feature_names(roll, roll_sizes, lag, lag_steps, delta, delta_steps))


def _backfill_blocks(computed: DataFrame, keys: Sequence[str], columns: Sequence[str],
                     lag_names: Sequence[str], steps: Sequence[int]) -> DataFrame:
    """Fill null lags from later rows: first inside the block, then from the
    summaries of later blocks, then with the series mean."""
    firsts = [
        F.min_by(n, F.when(F.col(n).isNotNull(), F.col("_pos"))).alias(f"_first_{n}") for n in lag_names
    ]
    totals = [x for c in columns for x in (
        F.sum(c).alias(f"_sum_{c}"), F.count(c).alias(f"_cnt_{c}"))]
    computed, plain = B.plain_keys(computed, [*keys, "_block"])
    summary = computed.groupBy(*plain, "_block").agg(*firsts, *totals)
    by_block = Window.partitionBy(*plain[:-2]).orderBy(F.desc("_block"))
    later = by_block.rowsBetween(Window.unboundedPreceding, -1)  # descending: the blocks behind this one
    whole = Window.partitionBy(*plain[:-2])
    summary = summary.select(
        *plain,
        *[F.last(f"_first_{n}", ignorenulls=True).over(later).alias(f"_next_{n}") for n in lag_names],
        *[F.try_divide(F.sum(f"_sum_{c}").over(whole), F.sum(f"_cnt_{c}").over(whole)).alias(f"_avg_{c}")
          for c in columns],
    )
    joined = computed.join(summary, plain)
    return joined.withColumns({
        f"{c}_lag{k}": F.coalesce(
            next_known(f"{c}_lag{k}", plain, "_pos"), F.col(f"_next_{c}_lag{k}"), F.col(f"_avg_{c}"))
        for c in columns for k in steps
    })


def next_known(column: str, keys: Sequence[str], order: str) -> Column:
    """The value at or after this row: looking back in descending order keeps
    the frame growing by one row, where a frame of all following rows is rescanned for each."""
    behind = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(column, ignorenulls=True).over(behind)


def feature_names(roll, roll_sizes, lag, lag_steps, delta, delta_steps) -> list[str]:
    """Window-major rolling names, then lags, then deltas."""
    return [
        *[f"{c}_roll{n}_{s}" for n in roll_sizes for c in roll for s in ROLL_STATS],
        *[f"{c}_lag{k}" for c in lag for k in lag_steps],
        *[f"{c}_delta{k}" for c in delta for k in delta_steps],
    ]


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str,
              columns: Sequence[str], tie: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Each left row with the newest right row at or before it (left outer).

    Null keys match nothing, as in SQL. Both sides are merged into one series and
    cut into ranges of equal size by (key, time), so a key is split however hot
    it is, and within one instant too. The state entering a range comes from a
    summary with one row per key and range. ``columns`` are the right columns to
    attach; ``tie`` orders right rows of equal time.
    """
    payload = F.struct(*[F.col(c).alias(c) for c in columns], F.col(right_ts).alias("_matched_ts"),
                       *[F.col(t).alias(f"_tie_{i}") for i, t in enumerate(tie)])
    known = lambda ts: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*on, ts)])
    ties = [f"_right._tie_{i}" for i in range(len(tie))]
    r = right.where(known(right_ts)).select(
        *[F.col(k) for k in on], F.col(right_ts).alias("_ts"), payload.alias("_right"), F.lit(0).cast("long").alias("_side"))
    # At one time right rows come first; left rows follow, told apart by a number that is never 0.
    whole_row = F.struct(*[F.col(c) for c in left.columns]).alias("_left")
    spread = F.xxhash64(*left.columns).bitwiseAND(F.lit((1 << 62) - 1)) + 1
    l = left.where(known(left_ts)).select(*[F.col(k) for k in on], F.col(left_ts).alias("_ts"), whole_row, spread.alias("_side"))
    merged = B.range_cut(l.unionByName(r, allowMissingColumns=True), [*on, "_ts", "_side", *ties], ranges)
    carry = B.carry_between_chunks(merged, on, B.RANGE, F.col("_right"), F.struct("_ts", *ties), "_carried")
    inside = Window.partitionBy(*on, B.RANGE).orderBy("_ts", "_side", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = merged.withColumn("_seen", F.last("_right", ignorenulls=True).over(inside))
    both = here.where(F.col("_left").isNotNull()).join(carry, [*on, B.RANGE], "left")
    picked = both.select("_left", F.coalesce("_seen", "_carried").alias("_match"))
    # Rows without a key or a time match nothing and need no series.
    picked = picked.unionByName(left.where(~known(left_ts)).select(whole_row), allowMissingColumns=True)
    return picked.select(
        *[F.col(f"_left.{c}").alias(c) for c in left.columns],
        *[F.col(f"_match.{c}").alias(c) for c in columns],
        F.col("_match._matched_ts").alias("matched_ts"),
    )


def sequence_gaps(df: DataFrame, key: str, sequence: str, block: int = 1_000_000) -> DataFrame:
    """Missing ranges of a per-key sequence number.

    Numbers are cut into blocks by value. Gaps inside a block come from a
    window over that block, gaps between blocks from one summary row per block.
    Repeated numbers count once.
    """
    seen = df.select(key, F.col(sequence).cast("long").alias("_s")).dropna().distinct()
    seen = seen.withColumn("_block", F.floor(F.col("_s") / block))
    inside = Window.partitionBy(key, "_block").orderBy("_s")
    within = seen.select(key, F.lag("_s").over(inside).alias("after"), F.col("_s").alias("before"))
    edges = seen.groupBy(key, "_block").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    by_block = Window.partitionBy(key).orderBy("_block")
    between = edges.select(key, F.lag("_hi").over(by_block).alias("after"), F.col("_lo").alias("before"))
    return (
        within.unionByName(between)
        .where(F.col("before") - F.col("after") > 1)
        .select(
            key,
            (F.col("after") + 1).alias("first_missing"),
            (F.col("before") - 1).alias("last_missing"),
            (F.col("before") - F.col("after") - 1).alias("missing"),
        )
    )
