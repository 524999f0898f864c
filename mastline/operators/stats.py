"""Summary statistics behind the monitoring views, all mergeable aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from mastline.operators.blocks import plain_keys


def first_known(column: str, order: Sequence[str]) -> Column:
    """First non-null value by an explicit order, instead of arrival order."""
    rank = F.struct(*[F.col(c) for c in order])
    return F.min_by(column, F.when(F.col(column).isNotNull(), rank))


# Site attributes carried along in the site roll-up.
SITE_CARRY = [
    "weather_temperature_c", "weather_humidity_pct", "weather_rainfall_mm", "weather_wind_speed_kmh",
    "weather_condition", "is_raining", "rain_intensity", "battery_status", "battery_charge", "alert_severity",
]


def site_insights(merged: DataFrame, order: Sequence[str] = ("cell_id",)) -> DataFrame:
    return merged.groupBy("site_id", "site_name").agg(
        F.coalesce(F.sum("users"), F.lit(0)).alias("users"),
        F.count("cell_id").alias("cells"),
        F.avg("sinr").alias("avg_sinr"), F.avg("rsrp").alias("avg_rsrp"), F.avg("cqi").alias("avg_cqi"),
        F.avg("downlink_mbps").alias("avg_downlink_mbps"),
        F.count_if(F.col("signal_quality") == "Poor").alias("poor_cells"),
        *[first_known(c, order).alias(c) for c in SITE_CARRY],
    )


def site_map(cells: DataFrame, order: Sequence[str] = ("cell_id",)) -> DataFrame:
    return cells.groupBy("site_id", "site_name", "lat", "lon").agg(
        F.avg("downlink_mbps").alias("downlink_mbps"),
        F.coalesce(F.sum("users"), F.lit(0)).alias("users"),
        first_known("alert_severity", order).alias("alert_severity"),
    )


def trend(df: DataFrame, ts: str, measure: str, name: str | None = None) -> DataFrame:
    return df.groupBy(ts).agg(F.avg(measure).alias(name or measure))


def network_kpis(cells: DataFrame, feed: DataFrame) -> DataFrame:
    """One row over the latest cells, with the critical alerts of the feed."""
    critical = feed.agg(F.count_if(F.col("severity") == "CRITICAL")).scalar()
    return cells.agg(
        F.coalesce(F.sum("users"), F.lit(0)).alias("active_users"),
        F.count_if(F.col("cell_status") == "UP").alias("cells_up"),
        F.count(F.lit(1)).alias("cells_total"),
        F.avg("sinr").alias("avg_sinr"), F.avg("battery_charge").alias("avg_battery"),
    ).withColumn("critical_alerts", critical)


def overview(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_distinct("site_id").alias("sites"),
        F.coalesce(F.sum("users"), F.lit(0)).alias("users"),
        F.round(F.avg("sinr"), 2).alias("avg_sinr"), F.round(F.avg("rsrp"), 2).alias("avg_rsrp"),
        F.count_if(F.col("alert_severity") == "CRITICAL").alias("critical_alerts"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per value; the total is summed over the value counts."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total")).scalar()
    return counts.withColumn("share", F.col("rows") / total)


def group_means(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(m).alias(name) for name, m in measures.items()])


def linear_trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line of y over x per group, with fit and correlation.

    Null pairs are left out; where x (or y) does not vary, the values that
    would divide by zero are null.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    sums = df.groupBy(*keys).agg(
        F.count_if(both).alias("points"), F.avg(xs).alias("_mx"), F.avg(ys).alias("_my"),
        F.covar_pop(ys, xs).alias("_xy"), F.var_pop(xs).alias("_xx"), F.var_pop(ys).alias("_yy"))
    slope, spread = F.try_divide("_xy", "_xx"), F.col("_xx") * F.col("_yy")
    return sums.select(
        *keys, "points", slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"),
        F.try_divide(F.col("_xy") * F.col("_xy"), spread).alias("r2"),
        F.try_divide(F.col("_xy"), F.sqrt(spread)).alias("correlation"))


#: Value ranges per group of ``quantiles``.
RANGES = 64


def quantiles(df: DataFrame, keys: Sequence[str], column: str, probabilities: Mapping[str, float],
              chunk_width: float | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles per group.

    Rows are first reduced to counts per (group, value), before the shuffle.
    Positions are then running sums over the distinct values. Value ranges
    split a group's values, joined up by one count row per range: ranges of
    ``chunk_width``, or else ``RANGES`` per group with about as many distinct
    values each, found by a sketch. The result does not depend on the ranges.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    values, plain = plain_keys(values, keys)
    if chunk_width:
        values = values.withColumn("_chunk", F.floor(F.col(column) / chunk_width))
    else:
        cuts = F.percentile_approx(column, [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts")
        values = values.join(values.groupBy(*plain).agg(cuts), plain) if keys else values.withColumn("_cuts", values.agg(cuts).scalar())
        values = values.withColumn("_chunk", F.size(F.filter("_cuts", lambda c: c < F.col(column)))).drop("_cuts")
    per_chunk = values.groupBy(*plain, "_chunk").agg(F.sum("_n").alias("_rows"))
    by_chunk = Window.partitionBy(*plain).orderBy("_chunk")
    offsets = per_chunk.select(
        *plain, "_chunk",
        F.coalesce(F.sum("_rows").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*plain)).alias("_total"),
    )
    inside = Window.partitionBy(*plain, "_chunk").orderBy(column).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = values.withColumn("_upto", F.sum("_n").over(inside)).join(offsets, [*plain, "_chunk"])
    end = F.col("_before") + F.col("_upto")
    start = end - F.col("_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < end), F.col(column)))

    picks = []
    for name, p in probabilities.items():
        rank = (F.col("_total") - 1) * F.lit(float(p))
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        picks.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(name))
    return placed.groupBy(*keys).agg(*picks)


def box_stats(df: DataFrame, keys: Sequence[str], column: str, chunk_width: float | None = None) -> DataFrame:
    return quantiles(
        df, keys, column, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}, chunk_width)


def weather_impact(cells_weather: DataFrame, insights: DataFrame, battery: float = 30) -> DataFrame:
    """Matched cells, rain counters and weak-battery sites in one row."""
    rainy = F.col("rain_intensity").isin("Moderate", "Heavy")
    cells = cells_weather.where(F.col("weather_temperature_c").isNotNull()).agg(
        F.count(F.lit(1)).alias("matched_cells"),
        F.avg("weather_temperature_c").alias("avg_temperature_c"),
        F.count_if(rainy).alias("heavy_rain_cells"),
        F.count_if(rainy & (F.col("signal_quality") == "Poor")).alias("poor_in_rain"),
    )
    low = insights.agg(F.count_if(F.col("battery_charge") < battery).alias("n")).scalar()
    return cells.withColumn("low_battery_sites", low)


def top_k(df: DataFrame, keys: Sequence[str], agg: Column, name: str, k: int) -> DataFrame:
    """The k groups with the highest aggregate (ties by key)."""
    return df.groupBy(*keys).agg(agg.alias(name)).orderBy(F.desc(name), *keys).limit(k)


def latest_rows(df: DataFrame, order: Sequence[str], k: int = 10) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(k)


def drill_down(df: DataFrame, site: str | None = None, cell: str | None = None) -> DataFrame:
    """Rows of one site, of one cell, or of one cell at one site."""
    for column, value in (("site_id", site), ("cell_id", cell)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def count_by(df: DataFrame, keys: Sequence[str], name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Row count as a by-product of the write, without a count job."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
