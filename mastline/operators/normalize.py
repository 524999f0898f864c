"""Nested snapshots to ten flat tables.

Each table is declared as (array path, output column -> source field), and one
function turns the declaration into a projection. A projection reads only its
own array, so on columnar input the scan prunes every other branch.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastline.functions import scalars as S
from mastline.schemas import BASE_COLUMNS

# ---------------------------------------------------------------------------
# Flat column <- nested field, per table.
# ---------------------------------------------------------------------------
SITE_FIELDS = {
    "vendor": "ran_metadata.vendor",
    "technologies": "ran_metadata.technology",
    "latitude": "ran_metadata.location.latitude",
    "longitude": "ran_metadata.location.longitude",
    "env_status": "environment.status",
    "env_op_state": "environment.op_state",
    "smoke_detected": "environment.smoke_detected",
    "door_status": "environment.door_status",
    "gen_status": "power_system.generator.status",
    "fuel_level_pct": "power_system.generator.fuel_level_percent",
    "runtime_hours": "power_system.generator.runtime_hours",
    "power_status": "power_system.status",
    "total_alerts": "alert_summary.total",
    "critical_alerts": "alert_summary.critical",
    "warning_alerts": "alert_summary.warning",
    "info_alerts": "alert_summary.info",
    "highest_severity": "alert_summary.highest_severity",
}
CELL_KPIS = [
    "bandwidth_mhz", "carrier_frequency_mhz", "connected_users", "active_users",
    "throughput_downlink_mbps", "throughput_uplink_mbps",
    "latency_downlink_ms", "latency_uplink_ms", "prb_utilization_percent",
    "sinr_db", "rsrp_dbm", "rsrq_db", "cqi_avg",
    "handover_success_rate_percent", "handover_attempts", "handover_failures",
    "rrc_success_rate_percent", "rrc_connection_attempts",
    "erab_setup_success_rate_percent", "call_drop_rate_percent",
    "abnormal_release_rate_percent", "harq_retransmission_rate_percent",
    "bler_uplink_percent", "bler_downlink_percent", "spectral_efficiency_bps_per_hz",
]


def same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


@dataclass(frozen=True)
class Component:
    """One repeated part of a snapshot and the columns taken from each element."""

    path: str
    fields: dict[str, str]
    upper: tuple[str, ...] = ()
    keep_empty: bool = False
    extra: dict[str, str] = field(default_factory=dict)


COMPONENTS: dict[str, Component] = {
    "cells": Component("cells", {
        **same("cell_id", "sector_id", "technology"),
        "cell_status": "status", "cell_op_state": "op_state", **same(*CELL_KPIS),
    }),
    "antennas": Component("antennas", same(
        "antenna_id", "sector_id", "status", "op_state", "mimo_layers",
        "azimuth_degree", "tilt_degree", "rssi_dbm", "snr_db")),
    "radio_units": Component("radio_units", {
        **same("ru_id", "sector_id", "status", "op_state", "tx_power_watts"),
        "rx_signal_dbm": "rx_signal_strength_dbm",
        **same("current_ampere", "voltage_volt", "temperature_c", "throughput_mbps",
               "packet_error_rate", "vswr"),
    }),
    "baseband_units": Component("baseband_units", {
        **same("bbu_id", "status", "op_state", "active_users"),
        "cpu_pct": "cpu_utilization_percent", "memory_pct": "memory_utilization_percent",
        "disk_pct": "disk_usage_percent", "control_latency_ms": "control_plane_latency_ms",
        "user_latency_ms": "user_plane_latency_ms", **same("process_latency_ms"),
    }),
    "batteries": Component("power_system.batteries", {
        **same("battery_id", "status", "op_state"), "charge_pct": "charge_percent",
        **same("temperature_c"),
    }),
    "rectifiers": Component("power_system.rectifiers", same(
        "rectifier_id", "status", "op_state", "current_ampere", "output_voltage_volt")),
    "transport_links": Component("transport_links", {
        "link_id": "link_id", "link_type": "type",
        **same("status", "op_state", "throughput_mbps", "utilization_percent",
               "latency_ms", "jitter_ms", "packet_loss_percent"),
    }, upper=("link_type",)),
}
ALERT_FIELDS = same("alert_id", "severity", "category", "component_type", "component_id", "code", "message")

SILVER_TABLES = ["site_snapshot", "environment_sensors", *COMPONENTS, "alerts"]


def base_columns() -> list[Column]:
    meta = {c: f"ran_metadata.{c}" for c in ("site_id", "site_name", "region")}
    return [
        S.snapshot_time("timestamp").alias(c) if c == "snapshot_time" else F.col(meta.get(c, c)).alias(c)
        for c in BASE_COLUMNS
    ]


def exploded(raw: DataFrame, path: str, burst: Callable[[str], Column] = F.explode) -> DataFrame:
    """Base columns and one ``item`` per array element.

    The base columns are picked before the array is exploded: a time is then parsed
    once a snapshot, and rows that lie by site are known to do so afterwards too.
    """
    return raw.select(*base_columns(), F.col(path).alias("_items")).select(*BASE_COLUMNS, burst("_items").alias("item"))


def site_snapshot(raw: DataFrame) -> DataFrame:
    return raw.select(*base_columns(), *[F.col(p).alias(n) for n, p in SITE_FIELDS.items()])


def explode_component(raw: DataFrame, spec: Component) -> DataFrame:
    """One row per array element; rows without elements vanish unless kept."""
    burst = F.explode_outer if spec.keep_empty else F.explode
    rows = exploded(raw, spec.path, burst)
    picked = []
    for name, source in spec.fields.items():
        value = F.col(f"item.{source}")
        picked.append((F.upper(value) if name in spec.upper else value).alias(name))
    return rows.select(*BASE_COLUMNS, *picked)


def environment_sensors(raw: DataFrame) -> DataFrame:
    """Temperature and humidity readings as one long table."""
    kinds = [
        ("TEMPERATURE", "temperature_sensors", "value_c", "C", S.temperature_status),
        ("HUMIDITY", "humidity_sensors", "value_percent", "percent", S.humidity_status),
    ]
    parts = []
    for kind, array, reading, unit, classify in kinds:
        rows = exploded(raw, f"environment.{array}")
        value = F.col(f"item.{reading}")
        parts.append(rows.select(
            *BASE_COLUMNS,
            F.lit(kind).alias("sensor_type"), F.col("item.sensor_id").alias("sensor_id"),
            value.alias("value"), F.lit(unit).alias("unit"), classify(value).alias("status"),
        ))
    return parts[0].unionByName(parts[1])


def alerts(raw: DataFrame) -> DataFrame:
    """One row per alert; a snapshot without alerts stays as one null row."""
    rows = exploded(raw, "alerts", F.explode_outer)
    return rows.select(
        *BASE_COLUMNS,
        *[F.col(f"item.{s}").alias(n) for n, s in ALERT_FIELDS.items()],
        S.numeric_value("item.value").alias("alert_value_num"),
        S.token_value("item.value").alias("alert_value_str"),
    )


def normalize_snapshots(raw: DataFrame, only: Collection[str] = SILVER_TABLES) -> dict[str, DataFrame]:
    """All ten tables, or ``only`` some, as lazy plans over ``raw``."""
    whole = {"site_snapshot": site_snapshot, "environment_sensors": environment_sensors, "alerts": alerts}
    return {name: whole[name](raw) if name in whole else explode_component(raw, COMPONENTS[name])
            for name in SILVER_TABLES if name in only}


def stage_snapshots(raw: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Write parsed snapshots once as Parquet and read them back.

    Ten projections over JSON would parse the text ten times; over Parquet
    each one reads only the nested columns it needs. ``by`` keeps the values of
    a field in files of their own, without a shuffle.
    """
    writer = (raw if by is None else raw.withColumn("_by", F.col(by))).write.mode("overwrite")
    (writer if by is None else writer.partitionBy("_by")).parquet(path)
    if by is not None:
        return raw.sparkSession.read.schema(raw.schema).parquet(path).select(*raw.columns)
    return raw.sparkSession.read.schema(raw.schema).parquet(path)


def quarantine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split snapshots into readable ones and ones whose time does not parse."""
    bad = S.snapshot_time("timestamp").isNull()
    return raw.where(~bad), raw.where(bad)
