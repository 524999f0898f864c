"""Star schema: seven dimensions and three facts.

The wide equipment fact is declared as a list of parts. Every part is reduced
to one row per (site, bucket) before anything is joined:

* readings -> one aggregate per component (means, modes, maxima), combined before
  its shuffle; a mode's state is a count per state name, of which there are few;
* one shuffle of the result by (site, bucket), on which everything else runs:
  slot numbering, pivot, and the left joins of all parts.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mastline.functions import scalars as S
from mastline.operators import slots as slot_ops
from mastline.operators.blocks import RANGE, plain_keys, range_cut
from mastline.operators.joins import assemble_wide
from mastline.operators import rollup as R
from mastline.operators.timebuckets import time_bucket
from mastline.operators.timeseries import asof_join

SITE_BUCKET = ["site_id", "bucket_start"]


# ---------------------------------------------------------------------------
# Dimensions
# ---------------------------------------------------------------------------
def build_dimension(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], surrogate: str,
                    order: Sequence[str] = ("snapshot_time", "sequence_number", "message_id"),
                    latest: bool = True) -> DataFrame:
    """One row per natural key with its newest attributes and an md5 key.

    ``latest=False`` keeps every distinct attribute combination instead.
    """
    if latest:
        row = F.max_by(F.struct(*attributes), F.struct(*order))
        kept = df.groupBy(*keys).agg(row.alias("_a")).select(*keys, "_a.*")
    else:
        kept = df.select(*keys, *attributes).distinct()
    return kept.select(S.surrogate_key(*keys).alias(surrogate), *keys, *attributes)


def dimension_history(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], surrogate: str, ts: str = "snapshot_time",
                      order: Sequence[str] = ("sequence_number", "message_id"), ranges: int | None = None) -> DataFrame:
    """Effective-dated versions: keys, attributes, ``valid_from``, ``valid_to``, ``is_current``.

    A version begins where a key's attributes differ from those before (nulls are
    values) and holds until the next one begins, exclusively; the newest has no
    end. Of several readings at one time the last by ``order`` counts. Readings
    without a time or a key date nothing. The surrogate is an md5 of the keys and
    the version's start.

    A key's readings are cut into ranges and shuffled once more, to the windows
    inside their range; what enters a range, and what follows it, comes from
    summaries with one row per key and range.
    """
    now = F.struct(*attributes)
    known = df.dropna(subset=[*keys, ts])
    read = known.groupBy(*keys, F.col(ts).alias("valid_from")).agg(F.max_by(now, F.struct(*order)).alias("_a"))
    cut = range_cut(read, [*keys, "valid_from"], ranges)
    inside = Window.partitionBy(*keys, RANGE).orderBy("valid_from")
    back = Window.partitionBy(*keys, RANGE).orderBy(F.desc("valid_from"))
    # Whether the first reading of a range begins a version shows only beside the range before.
    seen = cut.withColumns({"_first": F.row_number().over(inside) == 1, "_begins": ~F.lag("_a").over(inside).eqNullSafe(F.col("_a"))})
    begun = F.when(~F.col("_first") & F.col("_begins"), F.col("valid_from"))
    rows = seen.withColumns({
        "_next": F.last(begun, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
        "_last": F.first("_a").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    }).where(F.col("_first") | F.col("_begins"))
    chain = Window.partitionBy(*keys).orderBy(RANGE)
    later = Window.partitionBy(*keys).orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.where("_first").withColumn("_opens", ~F.lag("_last").over(chain).eqNullSafe(F.col("_a")))
    start = F.when(F.col("_opens"), F.col("valid_from")).otherwise(F.col("_next"))
    borders = heads.select(*keys, RANGE, "_opens", F.last(start, ignorenulls=True).over(later).alias("_after"))
    dated = rows.join(borders, [*keys, RANGE]).where(~F.col("_first") | F.col("_opens"))
    until = F.coalesce("_next", "_after")
    stamp = F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return dated.select(S.surrogate_key(*keys, stamp).alias(surrogate), *keys, "_a.*", "valid_from", until.alias("valid_to"), until.isNull().alias("is_current"))


def join_version(fact: DataFrame, history: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Each fact row with ``columns`` of the version valid at its time: versions of a
    key leave no gap, so it is the newest one begun by then. No row is multiplied
    or lost; rows before the first version, or without a key or time, get nulls."""
    return asof_join(fact, history, keys, ts, "valid_from", columns, ranges=ranges).drop("matched_ts")


ANTENNA = ["sector_id", "mimo_layers", "azimuth_degree", "tilt_degree"]


def dim_antenna_history(antennas: DataFrame) -> DataFrame:
    return dimension_history(antennas, ["site_id", "antenna_id"], ANTENNA, "antenna_version_sk")


def dim_site(site_snapshot: DataFrame) -> DataFrame:
    return build_dimension(
        site_snapshot, ["site_id"], ["site_name", "region", "vendor", "latitude", "longitude"], "site_sk")


def dim_cell(cells: DataFrame) -> DataFrame:
    out = build_dimension(
        cells, ["site_id", "cell_id"], ["technology", "bandwidth_mhz", "carrier_frequency_mhz", "sector_id"],
        "cell_sk")
    return out.select("cell_sk", "cell_id", "site_id", "technology", "bandwidth_mhz",
                      "carrier_frequency_mhz", "sector_id")


def dim_radio_unit(radio_units: DataFrame) -> DataFrame:
    return build_dimension(radio_units, ["site_id", "ru_id"], ["sector_id"], "RU_sk")


def dim_antenna(antennas: DataFrame) -> DataFrame:
    return build_dimension(antennas, ["site_id", "antenna_id"], ANTENNA, "antenna_sk")


def dim_link(links: DataFrame) -> DataFrame:
    return build_dimension(links, ["site_id", "link_id"], ["link_type"], "link_sk")


# Attribute names and formats of the date dimension.
def calendar(days: DataFrame, day: str = "day") -> DataFrame:
    """Calendar attributes for a frame of distinct days."""
    d = F.col(day)
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_sk"), d.alias("Date"),
        F.date_format(d, "EEEE").alias("DaySuffix"), F.year(d).alias("Year"),
        F.date_format(d, "EEE").alias("DayOfWeek"), F.dayofmonth(d).alias("DayOfMonth"),
        F.weekofyear(d).alias("WeekOfYear"), F.ceil(F.dayofmonth(d) / 7).cast("int").alias("WeekOfMonth"),
        F.month(d).alias("Month"), F.date_format(d, "MMMM").alias("MonthName"),
        F.quarter(d).alias("quarter"), F.concat(F.lit("Q"), F.quarter(d)).alias("quarterName"),
        F.date_format(d, "yyyy-MM-dd").alias("standardDate"))


def dim_date(spark: SparkSession, first: str = "2026-01-01", last: str = "2027-12-31") -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(
        F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("day"))
    return calendar(days)


def dim_date_spanning(df: DataFrame, ts: str) -> DataFrame:
    """Calendar from the first to the last day found in ``df``."""
    ends = df.agg(F.min(F.to_date(ts)).alias("a"), F.max(F.to_date(ts)).alias("b"))
    return calendar(ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day")))


# Day parts, working hours and label formats.
def clock_slots(slots: DataFrame, second_of_day: str = "sec") -> DataFrame:
    """Attributes of 30-second slots given their start second.

    ``time_key`` (HHmm) is set on the row that starts a minute only, so joining
    facts on it stays many-to-one.
    """
    s = F.col(second_of_day)
    hour, minute, second = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return slots.select(
        (hour * 10000 + minute * 100 + second).cast("int").alias("datetime_sk"),
        F.format_string("%02d:%02d:%02d", hour, minute, second).alias("time_label"),
        hour.cast("int").alias("hour"), minute.cast("int").alias("minute"), second.cast("int").alias("second"),
        S.ladder([(hour < 6, "Night"), (hour < 12, "Morning"), (hour < 18, "Afternoon")], "Evening")
        .alias("day_part"),
        F.when((hour >= 8) & (hour < 18), "Business Hours").otherwise("Off Hours").alias("business_hours"),
        F.floor(s / 30).cast("int").alias("slot_30s_index"),
        F.when(second == 0, hour * 100 + minute).cast("int").alias("time_key"))


def dim_time(spark: SparkSession) -> DataFrame:
    return clock_slots(spark.range(0, 86400, 30).withColumnRenamed("id", "sec"))


# ---------------------------------------------------------------------------
# Equipment fact
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Part:
    """A group of columns of the wide fact.

    ``slots`` > 0 lays the part's components out side by side; names then hold
    "{slot}". ``first`` takes the maximum, ``modes`` the most frequent value,
    ``means`` the average rounded to the given digits.
    """

    table: str
    component: str | None = None
    slots: int = 0
    where: tuple[str, str] | None = None
    first: Mapping[str, str] = field(default_factory=dict)
    modes: Mapping[str, str] = field(default_factory=dict)
    means: Mapping[str, tuple[str, int]] = field(default_factory=dict)
    whole: tuple[str, ...] = ()
    surplus: str | None = None

    def names(self) -> list[str]:
        patterns = [*self.first, *self.modes, *self.means]
        if not self.slots:
            return patterns
        return [p.format(slot=i) for i in range(1, self.slots + 1) for p in patterns]

    def aggregates(self) -> list[Column]:
        """One aggregate over the readings; ties of a mode take the smallest value."""
        out = [F.max(source).alias(name) for name, source in self.first.items()]
        out += [F.mode(source, deterministic=True).alias(name) for name, source in self.modes.items()]
        for name, (source, digits) in self.means.items():
            mean = F.round(F.avg(source), digits)
            out.append((mean.cast("int") if name in self.whole else mean).alias(name))
        return out


# Fact columns and the readings they come from, in table order.
RADIO_PART = Part(
    table="radio_units", component="ru_id", slots=3, surplus="RU_surplus",
    first={
        "RU{slot}_Sk": "ru_id", "RU{slot}_sector_key": "sector_id",
    },
    modes={
        "RU{slot}_status": "status", "RU{slot}_op_state": "op_state",
    },
    means={
        "RU{slot}_temperature_c": ("temperature_c", 2),
        "RU{slot}_tx_power_watts": ("tx_power_watts", 2),
        "RU{slot}_rx_signal_strength_dbm": ("rx_signal_dbm", 2),
        "RU{slot}_vswr": ("vswr", 2),
        "RU{slot}_current_ampere": ("current_ampere", 2),
        "RU{slot}_voltage_volt": ("voltage_volt", 2),
        "RU{slot}_packet_error_rate": ("packet_error_rate", 4),
        "RU{slot}_throughput_mbps": ("throughput_mbps", 2),
    },
)
BASEBAND_PART = Part(
    table="baseband_units",
    first={
        "BBU_Sk": "bbu_id",
    },
    modes={
        "BBU_status": "status", "BBU_op_state": "op_state",
    },
    means={
        "BBU_cpu_utilization_percent": ("cpu_pct", 2),
        "BBU_memory_utilization_percent": ("memory_pct", 2),
        "BBU_disk_usage_percent": ("disk_pct", 2),
        "BBU_process_latency_ms": ("process_latency_ms", 2),
        "BBU_active_users": ("active_users", 0),
        "BBU_control_plane_latency_ms": ("control_latency_ms", 2),
    },
    whole=("BBU_active_users",),
)
ANTENNA_PART = Part(
    table="antennas", component="antenna_id", slots=3, surplus="antenna_surplus",
    first={
        "antenna{slot}_Sk": "antenna_id", "antenna{slot}_sector_key": "sector_id",
    },
    modes={
        "antenna{slot}_status": "status", "antenna{slot}_opState": "op_state",
    },
    means={
        "antenna{slot}_rssi_dbm": ("rssi_dbm", 2),
        "antenna{slot}_snr_db": ("snr_db", 2),
    },
)
LINK_PART = Part(
    table="transport_links", component="link_id", slots=2, surplus="link_surplus",
    first={
        "link{slot}_Sk": "link_id",
    },
    modes={
        "link{slot}_status": "status", "link{slot}_opState": "op_state",
    },
    means={
        "link{slot}_latency_ms": ("latency_ms", 2),
        "link{slot}_jitter_ms": ("jitter_ms", 2),
        "link{slot}_packet_loss_percent": ("packet_loss_percent", 4),
        "link{slot}_throughput_mbps": ("throughput_mbps", 2),
        "link{slot}_utilization_percent": ("utilization_percent", 2),
    },
)
RECTIFIER_PART = Part(
    table="rectifiers", component="rectifier_id", slots=2, surplus="rect_surplus",
    first={
        "rect{slot}_sk": "rectifier_id",
    },
    modes={
        "rect{slot}_status": "status",
    },
    means={
        "rect{slot}_output_voltage_volt": ("output_voltage_volt", 2),
        "rect{slot}_current_ampere": ("current_ampere", 2),
    },
)
BATTERY_PART = Part(
    table="batteries", component="battery_id", slots=2, surplus="battery_surplus",
    first={
        "battery{slot}_sk": "battery_id",
    },
    modes={
        "battery{slot}_status": "status", "battery{slot}_opState": "op_state",
    },
    means={
        "battery{slot}_charge_percent": ("charge_pct", 2),
        "battery{slot}_temperature_c": ("temperature_c", 2),
    },
)
SITE_PART = Part(
    table="site_snapshot",
    first={
        "generator_status": "gen_status", "door_status": "door_status", "smoke_detected": "smoke_detected",
    },
    modes={
        "env_status": "env_status", "env_opState": "env_op_state",
    },
    means={
        "gen_fuel_level_percent": ("fuel_level_pct", 2),
        "gen_runtime_hours": ("runtime_hours", 2),
    },
)
TEMPERATURE_PART = Part(
    table="environment_sensors", component="sensor_id", slots=2, where=("sensor_type", "TEMPERATURE"),
    surplus="temp_sensor_surplus",
    first={
        "temp_sensor{slot}_Sk": "sensor_id",
    },
    means={
        "temp_sensor{slot}_value_c": ("value", 2),
    },
)
HUMIDITY_PART = Part(
    table="environment_sensors", where=("sensor_type", "HUMIDITY"),
    means={
        "Humd_sensor_value_percent": ("value", 2),
    },
)

JOINED_PARTS = [RADIO_PART, BASEBAND_PART, ANTENNA_PART, LINK_PART, RECTIFIER_PART, BATTERY_PART,
                TEMPERATURE_PART, HUMIDITY_PART]
# The layout of the wide fact.
FACT_RAN_COLUMNS = [
    "RAN_sk", "date_key", "timestamp", "time_key", "site_id",
    *RADIO_PART.names(), *BASEBAND_PART.names(), *ANTENNA_PART.names(), *LINK_PART.names(),
    "power_status", *RECTIFIER_PART.names(), *BATTERY_PART.names(),
    "generator_status", "gen_fuel_level_percent", "gen_runtime_hours", "env_status", "env_opState",
    *TEMPERATURE_PART.names(), *HUMIDITY_PART.names(), "door_status", "smoke_detected", "gold_date",
    "RAN_key",
]
# Ours: components beyond the fixed slots, counted here and listed by ``surplus_components``.
SURPLUS_COLUMNS = [p.surplus for p in JOINED_PARTS if p.surplus]


def _readings(silver: DataFrame, part: Part) -> DataFrame:
    rows = silver if part.where is None else silver.where(F.col(part.where[0]) == part.where[1])
    return time_bucket(rows, day=None)


def _per_component(silver: DataFrame, part: Part) -> DataFrame:
    # The component's id is also an output column, so it is grouped under its own name.
    return _readings(silver, part).withColumn("_component", F.col(part.component)).groupBy(
        *SITE_BUCKET, "_component").agg(*part.aggregates())


def build_part(silver: DataFrame, part: Part) -> DataFrame:
    """One row per (site, bucket) with the part's columns."""
    if part.slots:
        columns = {p: p for p in [*part.first, *part.modes, *part.means]}
        return slot_ops.slot_pivot(_per_component(silver, part), SITE_BUCKET, "_component", part.slots, columns, part.surplus)
    return _readings(silver, part).groupBy(*SITE_BUCKET).agg(*part.aggregates())


def fact_ran(silver: Mapping[str, DataFrame]) -> DataFrame:
    """Equipment health per site and 15-minute bucket."""
    base = build_part(silver[SITE_PART.table], SITE_PART)
    parts = [build_part(silver[p.table], p) for p in JOINED_PARTS]
    ts = F.col("bucket_start")
    wide = assemble_wide(base, parts, SITE_BUCKET).withColumns({
        **{c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in SURPLUS_COLUMNS},
        "RAN_sk": S.surrogate_key("site_id", "bucket_start"),
        "RAN_key": S.surrogate_key("site_id"),
        "date_key": S.date_key(ts), "time_key": S.time_key(ts), "timestamp": ts, "gold_date": F.to_date(ts),
        "power_status": F.coalesce("rect1_status", "rect2_status"),
    })
    return wide.select(*FACT_RAN_COLUMNS, *SURPLUS_COLUMNS)


def surplus_components(silver: Mapping[str, DataFrame]) -> DataFrame:
    """Every component without a slot in the wide fact: its part, site, bucket,
    id, number, states and means (as JSON), so that nothing is lost."""
    out = None
    for part in (p for p in JOINED_PARTS if p.slots):
        names = [*part.first, *part.modes, *part.means]
        rows = slot_ops.surplus_rows(_per_component(silver[part.table], part), SITE_BUCKET, "_component", part.slots).select(
            F.lit(part.surplus).alias("part"), "site_id", F.col("bucket_start").alias("timestamp"),
            F.col("_component").alias("component"), F.col("slot").cast("long").alias("slot"),
            F.to_json(F.struct(*[F.col(n).alias(n.format(slot="")) for n in names])).alias("readings"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------------------
# Cell fact
# ---------------------------------------------------------------------------
# KPIs averaged to two digits, counters summed, and the fact's layout.
CELL_MEANS = [
    "prb_utilization_percent", "throughput_downlink_mbps", "throughput_uplink_mbps",
    "rsrp_dbm", "rsrq_db", "sinr_db", "cqi_avg", "spectral_efficiency_bps_per_hz",
    "bler_downlink_percent", "bler_uplink_percent", "harq_retransmission_rate_percent",
    "latency_downlink_ms", "latency_uplink_ms",
    "rrc_success_rate_percent", "erab_setup_success_rate_percent", "call_drop_rate_percent",
    "abnormal_release_rate_percent",
]
CELL_SUMS = ["handover_attempts", "handover_failures", "rrc_connection_attempts"]
FACT_CELLS_COLUMNS = [
    "RAN_msg_Sk", "date_key", "timestamp", "time_key", "gold_date", "cell_key", "RAN_key", "sector_bk",
    "active_users", "connected_users", "peak_users", "prb_utilization_percent", "throughput_downlink_mbps",
    "throughput_uplink_mbps", "rsrp_dbm", "rsrq_db", "sinr_db", "cqi_avg", "spectral_efficiency_bps_per_hz",
    "bler_downlink_percent", "bler_uplink_percent", "harq_retransmission_rate_percent", "latency_downlink_ms",
    "latency_uplink_ms", "handover_attempts", "handover_failures", "handover_success_rate_percent",
    "rrc_connection_attempts", "rrc_success_rate_percent", "erab_setup_success_rate_percent",
    "call_drop_rate_percent", "abnormal_release_rate_percent", "traffic_volume_gb", "congestion_flag",
    "cell_status", "op_state",
]
CONGESTED_PRB = 80
BUCKET_SECONDS = 900


def fact_cells(cells: DataFrame) -> DataFrame:
    """Radio KPIs per cell and 15-minute bucket.

    Three aggregates over pruned columns, each as cheap as its kind allows, are
    joined once they are small: the wide numeric one is a pure hash aggregate;
    status modes belong to (site, cell, bucket), without sector and technology;
    and the earliest message id is text, which needs a (narrow) sort.
    """
    bucketed, plain = plain_keys(time_bucket(cells, day=None), ["site_id", "cell_id", "sector_id", "technology"])
    owner, group = [*plain[:4], "bucket_start"], [*plain, "bucket_start"]
    states = ["cell_status", "cell_op_state"]
    modes = R.reduce_rows(bucketed, owner, states).groupBy(*owner).agg(
        R.mode_of("cell_status", states).alias("cell_status"), R.mode_of("cell_op_state", states).alias("op_state"))

    def mean(c: str) -> Column:
        return F.round(F.avg(c), 3 if c == "spectral_efficiency_bps_per_hz" else 2).alias(c)

    kpis = bucketed.groupBy(*group).agg(
        F.avg("connected_users").cast("int").alias("connected_users"),
        F.avg("active_users").cast("int").alias("active_users"),
        F.max("connected_users").alias("peak_users"),
        *[mean(c) for c in CELL_MEANS],
        *[F.sum(c).alias(c) for c in CELL_SUMS],
        F.max(F.when(F.col("prb_utilization_percent") > CONGESTED_PRB, 1).otherwise(0)).alias("congestion_flag"),
    )
    messages = bucketed.groupBy(*group).agg(
        F.min_by("message_id", F.struct("snapshot_time", "message_id")).alias("RAN_msg_Sk"))
    agg = kpis.join(messages, group).join(modes, owner)
    names = ["site_id", "cell_id", "sector_id", "technology"]
    agg = agg.withColumns({k: F.when(~F.col(f"_key{i}_null"), F.col(f"_key{i}")) for i, k in enumerate(names)})
    ts = F.col("bucket_start")
    both_ways = F.col("throughput_downlink_mbps") + F.col("throughput_uplink_mbps")
    attempts, failures = F.col("handover_attempts"), F.col("handover_failures")
    return agg.withColumns({
        "date_key": S.date_key(ts), "time_key": S.time_key(ts), "timestamp": ts, "gold_date": F.to_date(ts),
        "traffic_volume_gb": F.round(both_ways * BUCKET_SECONDS / 8 / 1024, 3),
        "handover_success_rate_percent": F.round(
            F.when(attempts > 0, (1 - F.try_divide(failures, attempts)) * 100), 2),
        "cell_key": S.surrogate_key("site_id", "cell_id"), "RAN_key": S.surrogate_key("site_id"),
        "sector_bk": F.col("sector_id"),
    }).select(*FACT_CELLS_COLUMNS)


# ---------------------------------------------------------------------------
# Alarm fact
# ---------------------------------------------------------------------------
def fact_alarms(alerts: DataFrame) -> DataFrame:
    """One row per alert; the key depends on the alert alone, not on the run."""
    t = F.col("snapshot_time")
    return alerts.where(F.col("alert_id").isNotNull()).select(
        "message_id", S.surrogate_key("site_id").alias("site_key"),
        S.date_key(t).alias("date_key"), S.time_key(t).alias("time_key"),
        F.col("category").alias("alarm_category"), F.col("component_id").alias("component_key"),
        "severity", F.col("message").alias("alarm_msg"), "snapshot_time",
        F.to_date(t).alias("gold_date"), S.surrogate_key("message_id", "alert_id").alias("alarm_sk"))


# The normalized table that each one is made of; the wide fact reads all but cells and alerts.
SOURCES = {
    "dim_site": "site_snapshot", "dim_cell": "cells", "dim_RU": "radio_units", "dim_Antenna": "antennas",
    "dim_Link": "transport_links", "Fact_Cells": "cells", "Fact_Alarms": "alerts",
}
_MADE = {
    "dim_site": dim_site, "dim_cell": dim_cell, "dim_date": dim_date, "dim_time": dim_time, "dim_RU": dim_radio_unit,
    "dim_Antenna": dim_antenna, "dim_Link": dim_link, "Fact_RAN": fact_ran, "Fact_Cells": fact_cells, "Fact_Alarms": fact_alarms,
}


def build_gold(silver: Mapping[str, DataFrame], only: Collection[str] = tuple(_MADE)) -> dict[str, DataFrame]:
    """Dimensions and facts, or ``only`` some, as lazy plans; write each with one action.

    Where only some are asked for, ``silver`` may hold only what they are made of."""
    spark = next(iter(silver.values())).sparkSession
    given = {"dim_date": spark, "dim_time": spark, "Fact_RAN": silver}
    return {name: make(silver[SOURCES[name]] if name in SOURCES else given[name]) for name, make in _MADE.items() if name in only}
