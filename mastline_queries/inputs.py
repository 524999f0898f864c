"""Telemetry derived from the driver tables.

Every ``lineitem`` row becomes one snapshot of a site (its supplier), every
``orders`` row one weather report and one prediction. All numbers come from
integer arithmetic over the keys, divided by four, so sums are exact and both
engines must agree to the last digit. The expressions below are valid in Spark
SQL and in the oracle's SQL; only date arithmetic differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mastline.schemas import SNAPSHOT_DDL, struct_from_ddl

STATES = (
    "CASE WHEN {x} < 11 THEN 'HEALTHY' WHEN {x} < 13 THEN 'DEGRADED' "
    "WHEN {x} = 13 THEN 'RECOVERING' ELSE 'FAILED' END"
)
#: Follows the state but for one component in thirty: down though not failed, or up though failed.
STATUS = "CASE WHEN {own} = 7 THEN 'DOWN' WHEN {own} = 8 OR {x} < 14 THEN 'UP' ELSE 'DOWN' END"


def state_code(offset: int) -> str:
    return f"((h + {offset} * 13) % 16)"


def state(offset: int) -> str:
    return STATES.format(x=state_code(offset))


def status(offset: int) -> str:
    return STATUS.format(x=state_code(offset), own=f"((h + {offset} * 29) % 61)")


def kpi(offset: int, turn: int, span: int, base: float = 0.0) -> str:
    """A quarter-step reading in [base, base + span / 4), null while down."""
    raw = f"({base}e0 + CAST((h + {offset} * 37 + {turn} * 11) % {span} AS DOUBLE) / 4e0)"
    return f"CASE WHEN {state_code(offset)} < 14 THEN {raw} END"


def count(offset: int, turn: int, span: int, base: int = 0) -> str:
    """A counter, 0 while down."""
    raw = f"({base} + (h + {offset} * 37 + {turn} * 11) % {span})"
    return f"CAST(CASE WHEN {state_code(offset)} < 14 THEN {raw} ELSE 0 END AS INT)"


def whole(text: object) -> str:
    return f"CAST({text} AS INT)"


def _cell(i: int) -> dict[str, str]:
    o = 20 + i
    return {
        "cell_id": f"'CELL_{i}'", "sector_id": f"'S{i}'", "technology": "'4G'" if i == 1 else "'5G'",
        "status": status(o), "op_state": state(o),
        "bandwidth_mhz": whole((20, 100, 60)[i - 1]),
        "carrier_frequency_mhz": whole((1800, 3500, 2600)[i - 1]),
        "connected_users": count(o, 1, 150, 50), "active_users": count(o, 2, 120, 20),
        "throughput_downlink_mbps": kpi(o, 3, 1600, 40), "throughput_uplink_mbps": kpi(o, 4, 400, 10),
        "latency_downlink_ms": kpi(o, 5, 120, 4), "latency_uplink_ms": kpi(o, 6, 160, 6),
        "prb_utilization_percent": kpi(o, 7, 380, 5), "sinr_db": kpi(o, 8, 120, -4),
        "rsrp_dbm": kpi(o, 9, 160, -115), "rsrq_db": kpi(o, 10, 60, -18), "cqi_avg": kpi(o, 11, 56, 1),
        "handover_success_rate_percent": kpi(o, 12, 60, 85), "handover_attempts": count(o, 13, 180, 0),
        "handover_failures": count(o, 14, 9, 0), "rrc_success_rate_percent": kpi(o, 15, 40, 90),
        "rrc_connection_attempts": count(o, 16, 2500, 200),
        "erab_setup_success_rate_percent": kpi(o, 17, 36, 91),
        "call_drop_rate_percent": kpi(o, 18, 16, 0), "abnormal_release_rate_percent": kpi(o, 19, 12, 0),
        "harq_retransmission_rate_percent": kpi(o, 20, 40, 1), "bler_uplink_percent": kpi(o, 21, 24, 0),
        "bler_downlink_percent": kpi(o, 22, 28, 0), "spectral_efficiency_bps_per_hz": kpi(o, 23, 30, 1),
    }


def _radio(i: int) -> dict[str, str]:
    o = 30 + i
    return {
        "ru_id": f"'RU_{i}'", "sector_id": f"'S{i}'", "status": status(o), "op_state": state(o),
        "tx_power_watts": kpi(o, 1, 300, 120), "rx_signal_strength_dbm": kpi(o, 2, 120, -80),
        "current_ampere": kpi(o, 3, 60, 20), "voltage_volt": kpi(o, 4, 20, 46),
        "temperature_c": kpi(o, 5, 170, 24), "throughput_mbps": kpi(o, 6, 800, 50),
        "packet_error_rate": kpi(o, 7, 5, 0), "vswr": kpi(o, 8, 6, 1),
    }


def _antenna(i: int) -> dict[str, str]:
    o = 40 + i
    return {
        "antenna_id": f"'ANT_{i}'", "sector_id": f"'S{i}'", "status": status(o), "op_state": state(o),
        "mimo_layers": whole(4 if i != 2 else 8), "azimuth_degree": whole((i - 1) * 120),
        # The tilt changes over time: a dimension must keep the newest one.
        "tilt_degree": f"(2e0 + CAST((h + {i}) % 9 AS DOUBLE) / 4e0)",
        "rssi_dbm": kpi(o, 1, 100, -75), "snr_db": kpi(o, 2, 100, 10),
    }


def _baseband(i: int) -> dict[str, str]:
    o = 50 + i
    return {
        "bbu_id": "'BBU_MAIN'", "status": status(o), "op_state": state(o), "active_users": count(o, 1, 300, 60),
        "cpu_utilization_percent": kpi(o, 2, 360, 5), "memory_utilization_percent": kpi(o, 3, 320, 10),
        "disk_usage_percent": kpi(o, 4, 280, 15), "control_plane_latency_ms": kpi(o, 5, 60, 2),
        "user_plane_latency_ms": kpi(o, 6, 80, 3), "process_latency_ms": kpi(o, 7, 70, 2),
    }


def _link(i: int) -> dict[str, str]:
    o = 60 + i
    return {
        "link_id": f"'BH_{i}'", "type": "'fiber'" if i == 1 else "'microwave'",
        "status": status(o), "op_state": state(o), "throughput_mbps": kpi(o, 1, 4000, 500),
        "utilization_percent": kpi(o, 2, 400, 0), "latency_ms": kpi(o, 3, 280, 0.5),
        "jitter_ms": kpi(o, 4, 16, 0), "packet_loss_percent": kpi(o, 5, 6, 0),
    }


def _battery(i: int) -> dict[str, str]:
    o = 70 + i
    return {
        "battery_id": f"'BAT_{i}'", "status": status(o), "op_state": state(o),
        "charge_percent": kpi(o, 1, 360, 10), "temperature_c": kpi(o, 2, 80, 15),
    }


def _rectifier(i: int) -> dict[str, str]:
    o = 80 + i
    return {
        "rectifier_id": f"'REC_{i}'", "status": status(o), "op_state": state(o),
        "current_ampere": kpi(o, 1, 60, 35), "output_voltage_volt": kpi(o, 2, 20, 47),
    }


PARTS = {
    "cells": (_cell, 3), "radio_units": (_radio, 3), "antennas": (_antenna, 3),
    "baseband_units": (_baseband, 1), "transport_links": (_link, 2),
    "batteries": (_battery, 2), "rectifiers": (_rectifier, 2),
}
# Snapshots without any components: a missing array, and an empty one.
MISSING, EMPTY = "h % 101 = 0", "h % 101 = 1"
PRESENT = "h % 101 > 1"

TEMPERATURES = [("TEMP_1", "(25e0 + CAST(h % 80 AS DOUBLE) / 4e0)"), ("TEMP_2", "(26e0 + CAST((h + 9) % 72 AS DOUBLE) / 4e0)")]
HUMIDITY = ("HUM_1", "(30e0 + CAST((h + 5) % 240 AS DOUBLE) / 4e0)")

SITE = {
    "vendor": "CASE h % 3 WHEN 0 THEN 'Ericsson' WHEN 1 THEN 'Nokia' ELSE 'Huawei' END",
    "env_status": status(90), "env_op_state": state(90),
    "door_status": "CASE WHEN h % 11 = 0 THEN 'OPEN' ELSE 'CLOSED' END",
    "smoke_detected": "(h % 13 = 0)",
    "gen_status": "CASE WHEN h % 5 = 0 THEN 'ON' ELSE 'OFF' END",
    "fuel_level_pct": "(CAST(h % 400 AS DOUBLE) / 4e0)",
    "runtime_hours": "(CAST((h + 3) % 4000 AS DOUBLE) / 4e0)",
    "power_status": status(91),
}
LATITUDE = "(20e0 + CAST(site % 40 AS DOUBLE) / 4e0)"
LONGITUDE = "(25e0 + CAST((site - site % 40) / 40 AS DOUBLE) / 4e0)"

# Raw alerts: (fires when, fields).
ALERTS = [
    ("h % 6 = 0", {
        "alert_id": "concat(message_id, '-A1')", "severity": "'CRITICAL'", "category": "'power'",
        "component_type": "'battery'", "component_id": "'BAT_1'", "code": "'COMPONENT_DOWN'",
        "message": "'battery BAT_1 is down'",
        "value": "CASE (h / 6) % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN '12.5' WHEN 2 THEN 'true' ELSE '1d' END",
    }),
    ("h % 10 = 3", {
        "alert_id": "concat(message_id, '-A2')",
        "severity": "CASE WHEN h % 3 = 0 THEN 'INFO' ELSE 'WARNING' END", "category": "'radio'",
        "component_type": "'cell'", "component_id": "'CELL_2'", "code": "'CELL_CONGESTION'",
        "message": "'Cell PRB utilization is above 90 percent'",
        "value": "CAST(90e0 + CAST(h % 40 AS DOUBLE) / 4e0 AS {text})",
    }),
]
HASH = "(l_orderkey * 31 + l_partkey * 17 + l_suppkey * 5 + l_linenumber * 7)"
BAD_TIME = "h % 997 = 0"

# Weather per order: site id blank for one report in five, and then placed by
# its coordinates only.
WEATHER = {
    "source_system": "'orders'",
    "weather_temperature_c": "(5e0 + CAST((k * 3) % 140 AS DOUBLE) / 4e0)",
    "weather_humidity_pct": "CAST(20 + (k * 7) % 80 AS INT)",
    "weather_rainfall_mm": "CASE WHEN k % 17 = 0 THEN NULL ELSE CAST((k * 5) % 40 AS DOUBLE) / 4e0 END",
    "weather_wind_speed_kmh": "CASE WHEN k % 19 = 0 THEN NULL ELSE CAST((k * 11) % 200 AS DOUBLE) / 4e0 END",
    "weather_condition": "CASE k % 4 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Cloudy' WHEN 2 THEN 'Rain' ELSE 'Mist' END",
    "weather_location_name": "concat('Place ', CAST(site % 7 AS {text}))",
    "weather_region": "concat('Region ', CAST(site % 3 AS {text}))",
    "weather_country": "'Egypt'",
}
PROBABILITY = "(CAST((k * 37) % 1024 AS DOUBLE) / 1024e0)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Key columns of every snapshot."""
    # A snapshot is about a hundred times the size of its row: spread the narrow
    # rows before they grow, by site, since joins and aggregates that follow work by
    # site too. A given number is not coalesced by AQE, which would judge the rows
    # by their narrow size. This form of the id is known never to be null, and lines
    # without a supplier have no site.
    def site_id(key: str) -> Column:
        return F.concat_ws("", F.lit("SITE_"), key)

    line = table(spark, sf, "lineitem").where("l_suppkey is not null").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice").repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), site_id("l_suppkey")).withColumn("site_id", site_id("l_suppkey"))
    site = (
        table(spark, sf, "supplier").where("s_suppkey is not null")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(site_id("s_suppkey").alias("site_id"), "s_name", "r_name")
    )
    # A merge keeps the lines where they lie; small ones would be broadcast to the sites.
    return line.join(site.hint("merge"), "site_id").select(
        F.expr(HASH).alias("h"), F.col("l_suppkey").alias("site"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd"), F.floor("l_extendedprice")).alias("message_id"),
        F.expr(
            "TIMESTAMP_NTZ '2026-01-01 00:00:00' "
            "+ make_dt_interval(0, 0, datediff(l_shipdate, DATE '1995-01-01'), l_linenumber * 7)").alias("at"),
        F.col("l_orderkey").alias("sequence_number"),
        "site_id", F.col("s_name").alias("site_name"),
        F.col("r_name").alias("region"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Nested snapshots in the raw schema (plus ``source_file``)."""
    m = messages(spark, sf)

    def burst(name: str) -> str:
        make, n = PARTS[name]
        items = ", ".join(_struct(make(i)) for i in range(1, n + 1))
        return (f"CASE WHEN {MISSING} THEN NULL WHEN {EMPTY} THEN slice(array({items}), 1, 0) "
                f"ELSE array({items}) END")

    alerts = "filter(array(" + ", ".join(
        f"CASE WHEN {cond} THEN {_struct({n: e.format(text='string') for n, e in f.items()})} END"
        for cond, f in ALERTS) + "), a -> a IS NOT NULL)"
    level = "size(filter(alerts, a -> a.severity = '{}'))"
    temps = "array(" + ", ".join(f"named_struct('sensor_id', '{i}', 'value_c', {e})" for i, e in TEMPERATURES) + ")"
    hum = f"array(named_struct('sensor_id', '{HUMIDITY[0]}', 'value_percent', {HUMIDITY[1]}))"
    text = (f"CASE WHEN {BAD_TIME} THEN 'not a time' "
            "ELSE date_format(at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END")
    nested = m.select(
        "message_id", F.expr(text).alias("timestamp"), "sequence_number",
        F.expr("named_struct('site_id', site_id, 'site_name', site_name, 'location', "
               f"named_struct('latitude', {LATITUDE}, 'longitude', {LONGITUDE}), 'region', region, "
               f"'vendor', {SITE['vendor']}, 'technology', array('4G', '5G'))").alias("ran_metadata"),
        F.expr(f"named_struct('status', {SITE['env_status']}, 'op_state', {SITE['env_op_state']}, "
               f"'temperature_sensors', {temps}, 'humidity_sensors', {hum}, "
               f"'door_status', {SITE['door_status']}, 'smoke_detected', {SITE['smoke_detected']})")
        .alias("environment"),
        *[F.expr(burst(n)).alias(n) for n in
          ("antennas", "baseband_units", "transport_links", "cells", "radio_units")],
        F.expr(f"named_struct('status', {SITE['power_status']}, 'batteries', {burst('batteries')}, "
               f"'rectifiers', {burst('rectifiers')}, 'generator', named_struct('status', {SITE['gen_status']}, "
               f"'fuel_level_percent', {SITE['fuel_level_pct']}, 'runtime_hours', {SITE['runtime_hours']}))")
        .alias("power_system"),
        F.expr(alerts).alias("alerts"),
    )
    summed = nested.withColumn("alert_summary", F.expr(
        f"named_struct('total', size(alerts), 'critical', {level.format('CRITICAL')}, "
        f"'warning', {level.format('WARNING')}, 'info', {level.format('INFO')}, "
        f"'highest_severity', CASE WHEN {level.format('CRITICAL')} > 0 THEN 'CRITICAL' "
        f"WHEN {level.format('WARNING')} > 0 THEN 'WARNING' WHEN size(alerts) > 0 THEN 'INFO' ELSE 'NONE' END)"))
    wanted = struct_from_ddl(SNAPSHOT_DDL)
    return summed.select(*[F.col(f.name) for f in wanted.fields], F.lit("lineitem").alias("source_file"))


def broker_rows(raw: DataFrame) -> DataFrame:
    """Snapshots as keyed binary JSON messages."""
    body = raw.drop("source_file")
    return body.select(
        F.lit("ran_telemetry").alias("topic"), F.col("ran_metadata.site_id").cast("binary").alias("key"),
        F.to_json(F.struct(*body.columns)).cast("binary").alias("value"))


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Weather reports in the event schema, with an ingest time."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 100).alias("site"),
        F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00' + make_dt_interval(0, 0, "
               "datediff(o_orderdate, DATE '1995-01-01'), o_orderkey % 60)").alias("ingested_at"))
    return o.select(
        F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_timestamp"),
        F.expr(WEATHER["source_system"]).alias("source_system"),
        F.expr(f"concat(CAST({LATITUDE} AS string), ',', CAST({LONGITUDE} AS string))").alias("location_query"),
        F.expr("CASE WHEN k % 5 = 0 OR site % 10 = 3 THEN '' ELSE concat('SITE_', site) END").alias("ran_site_id"),
        F.expr("concat('Tower ', site)").alias("ran_site_name"),
        F.expr("concat('Zone ', site % 5)").alias("ran_region"),
        *[F.expr(WEATHER[c]).alias(c) for c in (
            "weather_temperature_c", "weather_humidity_pct", "weather_rainfall_mm", "weather_wind_speed_kmh",
            "weather_condition")],
        F.date_format("ingested_at", "yyyy-MM-dd HH:mm").alias("weather_observed_at"),
        F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("weather_fetched_at"),
        *[F.expr(WEATHER[c].format(text="string")).alias(c) for c in (
            "weather_location_name", "weather_region", "weather_country")],
        F.expr(LATITUDE).alias("weather_latitude"), F.expr(LONGITUDE).alias("weather_longitude"),
        "ingested_at", "k",
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """One failure probability per order; ``label`` follows it loosely."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00' + make_dt_interval(0, "
               "datediff(o_orderdate, DATE '1995-01-01') DIV 8)").alias("timestamp"),
        F.concat(F.lit("SITE_"), F.col("o_custkey") % 100).alias("site_id"),
        (F.col("o_orderkey") % 3 + 1).alias("cell_id"),
    ).withColumn("probability", F.expr(PROBABILITY)).withColumn(
        "label", F.expr("CASE WHEN (k * 37) % 1024 + (k * 101) % 700 > 900 THEN 1 ELSE 0 END"))
