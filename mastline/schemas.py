"""Input schemas and table layouts (fixed values of the telemetry data model)."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The nested snapshot message, in Spark DDL.
# ---------------------------------------------------------------------------
SITE_METADATA = (
    "struct<site_id:string, site_name:string, "
    "location:struct<latitude:double, longitude:double>, "
    "region:string, vendor:string, technology:array<string>>"
)
ENVIRONMENT = (
    "struct<status:string, op_state:string, "
    "temperature_sensors:array<struct<sensor_id:string, value_c:double>>, "
    "humidity_sensors:array<struct<sensor_id:string, value_percent:double>>, "
    "door_status:string, smoke_detected:boolean>"
)
ANTENNA = (
    "struct<antenna_id:string, sector_id:string, status:string, op_state:string, "
    "mimo_layers:int, azimuth_degree:int, tilt_degree:double, rssi_dbm:double, snr_db:double>"
)
BASEBAND = (
    "struct<bbu_id:string, status:string, op_state:string, active_users:int, "
    "cpu_utilization_percent:double, memory_utilization_percent:double, "
    "disk_usage_percent:double, control_plane_latency_ms:double, "
    "user_plane_latency_ms:double, process_latency_ms:double>"
)
LINK = (
    "struct<link_id:string, type:string, status:string, op_state:string, "
    "throughput_mbps:double, utilization_percent:double, latency_ms:double, "
    "jitter_ms:double, packet_loss_percent:double>"
)
CELL = (
    "struct<cell_id:string, sector_id:string, technology:string, status:string, op_state:string, "
    "bandwidth_mhz:int, carrier_frequency_mhz:int, connected_users:int, active_users:int, "
    "throughput_downlink_mbps:double, throughput_uplink_mbps:double, "
    "latency_downlink_ms:double, latency_uplink_ms:double, prb_utilization_percent:double, "
    "sinr_db:double, rsrp_dbm:double, rsrq_db:double, cqi_avg:double, "
    "handover_success_rate_percent:double, handover_attempts:int, handover_failures:int, "
    "rrc_success_rate_percent:double, rrc_connection_attempts:int, "
    "erab_setup_success_rate_percent:double, call_drop_rate_percent:double, "
    "abnormal_release_rate_percent:double, harq_retransmission_rate_percent:double, "
    "bler_uplink_percent:double, bler_downlink_percent:double, "
    "spectral_efficiency_bps_per_hz:double>"
)
RADIO_UNIT = (
    "struct<ru_id:string, sector_id:string, status:string, op_state:string, "
    "tx_power_watts:double, rx_signal_strength_dbm:double, current_ampere:double, "
    "voltage_volt:double, temperature_c:double, throughput_mbps:double, "
    "packet_error_rate:double, vswr:double>"
)
BATTERY = (
    "struct<battery_id:string, status:string, op_state:string, "
    "charge_percent:double, temperature_c:double>"
)
RECTIFIER = (
    "struct<rectifier_id:string, status:string, op_state:string, "
    "current_ampere:double, output_voltage_volt:double>"
)
GENERATOR = "struct<status:string, fuel_level_percent:double, runtime_hours:double>"
ALERT = (
    "struct<alert_id:string, severity:string, category:string, component_type:string, "
    "component_id:string, code:string, message:string, value:string>"
)
ALERT_SUMMARY = "struct<total:int, critical:int, warning:int, info:int, highest_severity:string>"

SNAPSHOT_DDL = (
    "message_id string, timestamp string, sequence_number bigint, "
    f"ran_metadata {SITE_METADATA}, environment {ENVIRONMENT}, "
    f"antennas array<{ANTENNA}>, baseband_units array<{BASEBAND}>, "
    f"transport_links array<{LINK}>, cells array<{CELL}>, radio_units array<{RADIO_UNIT}>, "
    f"power_system struct<status:string, batteries:array<{BATTERY}>, "
    f"rectifiers:array<{RECTIFIER}>, generator:{GENERATOR}>, "
    f"alerts array<{ALERT}>, alert_summary {ALERT_SUMMARY}"
)

# What the two live enrichers read; a narrow schema keeps JSON parsing cheap.
LIVE_SNAPSHOT_DDL = (
    "message_id string, timestamp string, "
    "ran_metadata struct<site_id:string, site_name:string, "
    "location:struct<latitude:double, longitude:double>, vendor:string>, "
    "cells array<struct<cell_id:string, technology:string, status:string, active_users:int, "
    "throughput_downlink_mbps:double, rsrp_dbm:double, rsrq_db:double, sinr_db:double, "
    "cqi_avg:double, handover_success_rate_percent:double>>, "
    "radio_units array<struct<temperature_c:double>>, "
    "power_system struct<batteries:array<struct<status:string, charge_percent:double>>>, "
    f"transport_links array<{LINK}>, "
    "alert_summary struct<highest_severity:string>"
)

WEATHER_DDL = (
    "event_timestamp string, source_system string, location_query string, "
    "ran_site_id string, ran_site_name string, ran_region string, "
    "weather_temperature_c double, weather_humidity_pct int, weather_rainfall_mm double, "
    "weather_wind_speed_kmh double, weather_condition string, weather_observed_at string, "
    "weather_fetched_at string, weather_location_name string, weather_region string, "
    "weather_country string, weather_latitude double, weather_longitude double"
)

WEATHER_API_DDL = (
    "current struct<temp_c:double, humidity:int, precip_mm:double, wind_kph:double, "
    "last_updated:string, condition:struct<text:string>>, "
    "location struct<name:string, region:string, country:string, lat:double, lon:double>"
)

PREDICTION_CSV_DDL = (
    "timestamp_col timestamp_ntz, site_id string, cell_id string, "
    "failure_probability double, predicted_failure smallint, risk_level string"
)

SNAPSHOT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"

BASE_COLUMNS = [
    "message_id", "source_file", "snapshot_time", "sequence_number",
    "site_id", "site_name", "region",
]


def struct_from_ddl(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def live_weather_columns() -> list[str]:
    """Columns of the weather serving table: the event, two flags, ingest time."""
    event = [part.strip().split(" ")[0] for part in WEATHER_DDL.split(",")]
    return [*event, "is_raining", "rain_intensity", "ingested_at"]
